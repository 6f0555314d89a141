from __future__ import annotations

import json

from pyspark.sql import functions as F

from tidemart import schemas
from tidemart.functions import scalars
from tidemart.operators import cdc, dims, logs, orders, stats
from tidemart.sources import topics


def raw(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "value string")


def test_dirty_records_are_told_from_good_ones(spark):
    good, dirty = logs.parse_or_dirty(raw(spark, '{"ts": 1}', "{bad", "", None, "123", "[1]", '{"common": {"mid": "a"}}'))
    assert sorted(r.value for r in dirty.collect()) == ["", "123", "[1]", "{bad"]
    assert {(r.ts, r.common.mid if r.common else None) for r in good.collect()} == {(1, None), (None, "a")}


def test_start_logs_and_displays(spark):
    page = {"page": {"page_id": "p"}, "ts": 5}
    show = [{"item": "1", "item_type": "sku_id"}, {"item": "2", "item_type": "x"}, {"item": "3", "item_type": "sku_id"}]
    texts = [page, page | {"start": {}}, page | {"start": {"entry": "icon"}}, page | {"displays": []}, page | {"displays": show}]
    start, pages = logs.split_log(logs.parse_drop_dirty(raw(spark, *map(json.dumps, texts))))
    assert start.count() == 1 and pages.count() == 4
    assert sorted(r.item for r in logs.displays(pages).collect()) == ["1", "2", "3"]
    assert sorted(r.sku_id for r in stats.display_facts(pages).collect()) == [1, 3]


def log_rows(spark, rows):
    return spark.createDataFrame([({"mid": m, "is_new": n}, t) for m, n, t in rows], "common struct<mid: string, is_new: string>, ts long")


def test_only_the_first_claim_is_new(spark):
    out = logs.repaired_is_new(log_rows(spark, [("a", "1", 1), ("a", "1", 2), ("a", "0", 3), ("a", "1", 4), ("b", "0", 1), ("b", "1", 2), (None, "1", 1)]))
    assert [(r.common.mid, r.ts, r.common.is_new) for r in out.orderBy("common.mid", "ts").collect()] == [
        ("a", 1, "1"), ("a", 2, "0"), ("a", 3, "0"), ("a", 4, "0"), ("b", 1, "0"), ("b", 2, "1"),
    ]


def test_change_records_are_normalised_and_routed(spark):
    rows = [("s.shop.t", '{"after": {"id": "1", "x": "a", "y": null}, "op": "c"}'), ("s.shop.t", '{"before": {"id": "1"}, "op": "d"}'), ("s.shop.u", '{"after": {"id": "2"}, "op": "u"}'), ("s.shop.t", '{"after": {"id": "3"}}')]
    changes = cdc.normalized(spark.createDataFrame(rows, "topic string, value string"))
    assert [(r.tableName, r.type) for r in changes.collect()] == [("t", "insert"), ("t", "delete"), ("u", "update"), ("t", None)]
    kept = cdc.without_deletes(changes)
    assert kept.count() == 3
    config = spark.createDataFrame([("t", "insert", "kafka", "out", "id,y,Z", None, None), ("u", "insert", "hbase", "d", "id", None, None)], schemas.ROUTING)
    out = cdc.routed(kept, config).collect()
    assert [(r.sink_table, r.after, r.sink_pk) for r in out] == [("out", {"id": "1", "y": None}, "id")]
    assert sorted((r.tableName, r.type) for r in cdc.unrouted(kept, config).select("tableName", F.coalesce("type", F.lit("")).alias("type")).collect()) == [("t", ""), ("u", "update")]


def test_routing_table_from_its_history(spark):
    rows = [({"source_table": "t", "operate_type": "insert", "sink_table": "a"}, 1), ({"source_table": "t", "operate_type": "insert", "sink_table": "b"}, 2), ({}, 3)]
    out = topics.config_source(spark.createDataFrame(rows, "after map<string,string>, seq long")).collect()
    assert [(r.source_table, r.sink_table) for r in out] == [("t", "b")]


def test_partial_updates_fold_by_column(spark):
    rows = [("1", 1, {"a": "x", "b": "y"}), ("1", 2, {"b": "z"}), ("1", 3, {"a": None}), ("2", 1, {"a": "q"}), (None, 1, {"a": "r"})]
    out = dims.as_table(dims.folded(spark.createDataFrame(rows, "pk string, seq long, values map<string,string>")), ["id", "a", "b"])
    assert sorted(map(str, out.collect())) == ["Row(id='1', a=None, b='z')", "Row(id='2', a='q', b=None)"]


def test_dim_join_left_and_inner(spark):
    facts = spark.createDataFrame([(1, "own"), (2, "own"), (None, "own")], "k long, name string")
    dim = spark.createDataFrame([("1", "dim")], "ID string, NAME string")
    join = lambda how: sorted((r.k or 0, r.name) for r in dims.dim_join(facts, dim, "k", "ID", {"name": "NAME"}, how).collect())
    assert join("left") == [(0, "own"), (1, "dim"), (2, "own")]
    assert join("inner") == [(1, "dim")]


def test_interval_join_bounds_are_inclusive(spark):
    info = spark.sql("SELECT 1L id, 1L province_id, 'x' order_status, 1L user_id, 1.00BD total_amount, 0BD activity_reduce_amount, 0BD coupon_reduce_amount, 0BD original_total_amount, 0BD feight_fee, TIMESTAMP'2024-01-01 00:00:10' et, '' create_time, '' create_date, '' create_hour, '' expire_time, '' operate_time")
    line = lambda i, at: f"SELECT {i}L id, 1L order_id, 1L sku_id, 1BD order_price, 1L sku_num, 'n' sku_name, 1BD split_total_amount, 0BD split_activity_amount, 0BD split_coupon_amount, TIMESTAMP'2024-01-01 00:00:{at}' et"
    lines = spark.sql(" UNION ALL ".join(line(i, at) for i, at in enumerate(["05.000", "15.000", "04.999", "15.001"])))
    wide = orders.order_wide(info, lines)
    assert sorted(r.detail_id for r in wide.collect()) == [0, 1]
    pay = lambda at: spark.sql(f"SELECT 9L id, 's' subject, 't' payment_type, 'c' create_time, 'b' callback_time, 1L order_id, 7L user_id, 5.00BD total_amount, TIMESTAMP'2024-01-01 00:{at}' et")
    got = orders.payment_wide(pay("15:10"), wide).collect()
    assert len(got) == 2 and {(r.user_id, float(r.total_amount)) for r in got} == {(7, 5.0)}
    assert orders.payment_wide(pay("15:11"), wide).count() == 0 and orders.payment_wide(pay("00:09"), wide).count() == 0


def test_scalars(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).head().x
    assert one(scalars.millis(F.lit("1970-01-01 00:00:01"))) == 1000
    assert one(scalars.millis(F.lit("oops"), F.lit(7).cast("long"))) == 7
    assert one(scalars.hour_part(F.lit("2024-01-01 03:04:05"))) == "03" and one(scalars.hour_part(F.lit("x"))) is None
    assert one(scalars.age(F.lit("2000-01-01"), F.lit("2001-12-31").cast("date"))) == 2
    assert one(scalars.age(F.lit("?"), F.current_date())) == 0
    assert one(scalars.keywords(F.lit("Red Widget-2 手机"))) == ["red", "widget", "2", "手", "机"]
    assert one(scalars.keywords(F.lit("!?"))) == [] and one(scalars.as_long(F.lit("x"))) is None
    assert scalars.camel("ORDER_ID") == "orderId"


def test_product_facts_fill_what_is_missing(spark):
    f = stats.product_facts(spark.sql("SELECT 1L sku_id, TIMESTAMP'2024-01-01 00:00:00' et, 1L click_ct"))
    r = f.head()
    assert r.click_ct == 1 and r.cart_ct == 0 and r.order_amount == 0 and r._ordered is None


def test_order_parsers_take_text_numbers_and_bad_times(spark):
    good, bad = '{"id": "7", "total_amount": "1.50", "create_time": "2024-01-01 03:04:05"}', '{"id": 8, "total_amount": "x", "create_time": "soon"}'
    rows = {r.id: r for r in orders.order_infos(raw(spark, good, bad)).collect()}
    assert (float(rows[7].total_amount), rows[7].create_date, rows[7].create_hour) == (1.5, "2024-01-01", "03") and rows[7].et
    assert rows[8].total_amount is None and rows[8].et is None
    assert [r.value for r in orders.without_time(orders.order_details(raw(spark, good, bad))).collect()] == ['{"id":8,"create_time":"soon"}']
    seen = spark.sql(f"SELECT '{good}' value, TIMESTAMP'2024-02-02 00:00:00' at UNION ALL SELECT '{bad}', TIMESTAMP'2024-02-02 00:00:01'")
    assert {r.id: str(r.et) for r in orders.payments(seen, "at").collect()} == {7: "2024-01-01 03:04:05", 8: "2024-02-02 00:00:01"}

"""The queries, each with the same result in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemart import schemas
from tidemart.functions import order
from tidemart.functions.scalars import age, day_text, event_time
from tidemart.operators import cdc, dims, logs, orders, patterns, stats, visits, words
from tidemart.plans.adapters import Tables
from tidemart.sources import handover

HOUR, DAY = "1 hour", "1 day"
#: On these tables visitors' pages are hours apart, lines ship days after the order.
JUMP_MS, LINE_BOUND = 6 * 3_600_000, "5 DAYS"

_queries: dict[str, Callable[[Tables], DataFrame]] = {}
_sql: dict[str, str] = {}


def query(sql: str) -> Callable:
    def add(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        _queries[f.__name__], _sql[f.__name__] = f, sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, sf_dir, f=f: f(Tables(spark, sf_dir))) for name, f in _queries.items()}


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


_E = "e AS (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k, epoch_us(ts) // 1000 AS ms FROM events)"
_PAGES = f"""{_E}, pages AS (
  SELECT event_id, CAST(user_id AS VARCHAR) AS mid, CAST(user_id % 3 AS VARCHAR) AS vc, CAST(user_id % 5 AS VARCHAR) AS ch, CAST(user_id % 7 AS VARCHAR) AS ar,
    CASE WHEN event_type = 'signup' THEN '1' ELSE '0' END AS is_new,
    CASE event_type WHEN 'view' THEN 'home' WHEN 'signup' THEN 'home' WHEN 'click' THEN 'good_detail' WHEN 'error' THEN 'good_list' WHEN 'purchase' THEN 'trade' END AS page_id,
    CASE event_type WHEN 'signup' THEN '' WHEN 'click' THEN 'good_list' WHEN 'error' THEN 'search' WHEN 'purchase' THEN 'cart' END AS last_page_id,
    CASE event_type WHEN 'click' THEN CAST(k AS VARCHAR) WHEN 'error' THEN 'red widget ' || CAST(k AS VARCHAR) END AS item,
    CASE event_type WHEN 'click' THEN 'sku_id' WHEN 'error' THEN 'keyword' END AS item_type,
    CAST(floor(value * 1000) AS BIGINT) AS during_time, k, ms AS ts, coalesce(event_type IN ('view', 'signup'), false) AS entry FROM e)"""
_MONEY = "CAST(CAST(floor(({}) * 100 + 0.5) AS DECIMAL(16,0)) * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(16,2))"
_W = "strftime(make_timestamp(CAST(floor(epoch_us({ts}) / {w}000000.0) AS BIGINT) * {w}000000{plus}), '%Y-%m-%d %H:%M:%S')"


def _bounds(ts: str, w: int) -> str:
    return _W.format(ts=ts, w=w, plus="") + " AS stt, " + _W.format(ts=ts, w=w, plus=f" + {w}000000") + " AS edt"


_SHOWN = "SELECT event_id, page_id, ts, unnest(range(0, k % 3 + 1)) + k AS item FROM pages"
_VISITS = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY mid, strftime(make_timestamp(ts * 1000), '%Y-%m-%d') ORDER BY ts, event_id) AS n FROM pages WHERE entry) WHERE n = 1"
_JUMPS = f"""SELECT * FROM (SELECT *, lead(ts) OVER w AS next_ts, lead(entry) OVER w AS next_entry FROM pages WINDOW w AS (PARTITION BY mid ORDER BY ts, event_id))
  WHERE entry AND (next_ts IS NULL OR next_ts - ts >= {JUMP_MS} OR next_entry)"""
_LINES = f"""o AS (SELECT orders.*, c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey),
wide AS (
  SELECT l_orderkey * 10 + l_linenumber AS detail_id, o_orderkey AS order_id, l_partkey AS sku_id, CAST(l_quantity AS BIGINT) AS sku_num,
    CAST(c_nationkey AS BIGINT) AS province_id, o_orderstatus AS order_status, o_custkey AS user_id, {_MONEY.format('o_totalprice')} AS total_amount,
    {_MONEY.format('l_extendedprice * (1 - l_discount)')} AS split_total_amount, o_orderdate AS et
  FROM o JOIN lineitem ON o_orderkey = l_orderkey AND l_shipdate BETWEEN o_orderdate - INTERVAL 5 DAY AND o_orderdate + INTERVAL 5 DAY),
pay AS (SELECT o_orderkey AS payment_id, o_custkey AS user_id, o_totalprice, o_orderpriority AS payment_type, o_orderdate + to_minutes(CAST(o_orderkey % 20 AS BIGINT)) AS pt FROM orders WHERE o_orderstatus = 'F'),
paid AS (SELECT payment_id, payment_type, pt, wide.* FROM pay JOIN wide ON order_id = payment_id AND et BETWEEN pt - INTERVAL 15 MINUTE AND pt)"""


# Logs -------------------------------------------------------------------------------------------------------------------


@query(
    f"""WITH {_PAGES} SELECT CASE WHEN event_id % 11 = 0 THEN 'start' ELSE 'page' END AS kind, mid, is_new, page_id, last_page_id, item, during_time, ts
    FROM pages WHERE event_id % 97 <> 0"""
)
def log_parse_split(t: Tables) -> DataFrame:
    """Raw logs parsed and split into start and page logs."""
    rows = logs.parse_drop_dirty(t.raw_logs())
    return rows.select("kind", "common.mid", "common.is_new", "page.page_id", "page.last_page_id", "page.item", "page.during_time", "ts")


@query("SELECT CASE WHEN event_id % 194 = 0 THEN '{bad' ELSE '123' END AS value FROM events WHERE event_id % 97 = 0")
def log_dirty(t: Tables) -> DataFrame:
    return logs.parse_or_dirty(t.raw_logs())[1]


@query(
    f"WITH {_PAGES} SELECT CAST(item AS VARCHAR) AS item, CASE WHEN item % 2 = 0 THEN 'sku_id' ELSE 'activity' END AS item_type, page_id, ts FROM ({_SHOWN})"
)
def display_explode(t: Tables) -> DataFrame:
    return logs.displays(t.page_logs())


@query(
    f"""WITH {_PAGES} SELECT event_id, mid, CASE WHEN is_new = '1' AND row_number() OVER (PARTITION BY mid, is_new ORDER BY ts, event_id) > 1 THEN '0' ELSE is_new END AS is_new
    FROM pages"""
)
def is_new_repair(t: Tables) -> DataFrame:
    return logs.repaired_is_new(t.page_logs(), "event_id").select("event_id", "common.mid", "common.is_new")


# Changes ----------------------------------------------------------------------------------------------------------------

_CHANGES = """ch AS (
  SELECT 'order_info' AS t, o_orderkey % 4 AS m, CAST(o_orderkey AS VARCHAR) AS id, o_orderstatus AS status, CAST(NULL AS VARCHAR) AS name FROM orders
  UNION ALL SELECT 'user_info', c_custkey % 4, CAST(c_custkey AS VARCHAR), NULL, c_name FROM customer),
n AS (SELECT *, CASE m WHEN 1 THEN 'update' WHEN 2 THEN 'delete' ELSE 'insert' END AS type FROM ch)"""


@query(f'WITH {_CHANGES} SELECT \'shop\' AS "database", t AS "tableName", type, id FROM n')
def cdc_normalize(t: Tables) -> DataFrame:
    return cdc.normalized(t.raw_changes()).select("database", "tableName", "type", F.try_element_at("after", F.lit("id")).alias("id"))


@query(
    f"""WITH {_CHANGES} SELECT id, status, name, CASE WHEN t = 'user_info' THEN 'dim_user_info' WHEN type = 'update' THEN 'dwd_order_info_update' ELSE 'dwd_order_info' END AS sink_table,
    CASE WHEN t = 'user_info' THEN 'hbase' ELSE 'kafka' END AS sink_type, CAST(2 AS INTEGER) AS n_columns
    FROM n WHERE (t = 'order_info' AND type IN ('insert', 'update')) OR (t = 'user_info' AND type = 'insert')"""
)
def cdc_route(t: Tables) -> DataFrame:
    """Changes without deletes, routed by the routing table, columns cut to its whitelist."""
    out = cdc.routed(cdc.without_deletes(cdc.normalized(t.raw_changes())), t.routing())
    value = lambda k: F.try_element_at("after", F.lit(k)).alias(k)
    return out.select(value("id"), value("status"), value("name"), "sink_table", "sink_type", F.size("after").alias("n_columns"))


@query(
    f"""WITH {_CHANGES} SELECT t AS "tableName", id, status, name, CASE t WHEN 'order_info' THEN 2 ELSE 1 END AS n_columns FROM n"""
)
def column_whitelist(t: Tables) -> DataFrame:
    """Changes cut to listed columns; names that a change doesn't have are no columns of it."""
    after = cdc.whitelisted(F.col("after"), F.lit("id,status,absent"))
    names = F.when(F.col("tableName") == "user_info", cdc.whitelisted(F.col("after"), F.lit("name"))).otherwise(F.create_map().cast("map<string,string>"))
    out = cdc.normalized(t.raw_changes()).select("tableName", after.alias("after"), names.alias("named"))
    value = lambda m, k: F.try_element_at(m, F.lit(k)).alias(k)
    return out.select("tableName", value("after", "id"), value("after", "status"), value("named", "name"), F.size("after").alias("n_columns"))


@query(f"""WITH {_CHANGES} SELECT t AS "tableName", type, count(*) AS n FROM n WHERE type <> 'delete' AND t = 'user_info' AND type <> 'insert' GROUP BY ALL""")
def cdc_unrouted(t: Tables) -> DataFrame:
    out = cdc.unrouted(cdc.without_deletes(cdc.normalized(t.raw_changes())), t.routing())
    return out.groupBy("tableName", "type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_custkey, max(o_orderkey) AS o_orderkey, arg_max(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders GROUP BY o_custkey")
def dim_latest(t: Tables) -> DataFrame:
    """The latest row of each key."""
    return dims.latest_per_key(t.orders.select("o_custkey", "o_orderkey", "o_orderstatus"), "o_custkey", "o_orderkey")


@query(
    """SELECT CAST(o_custkey AS VARCHAR) AS id, arg_max(o_orderstatus, o_orderkey) FILTER (o_orderkey % 2 = 0) AS status,
    arg_max(o_orderpriority, o_orderkey) FILTER (o_orderkey % 3 <> 0) AS priority
    FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 <> 0 GROUP BY o_custkey"""
)
def dim_fold(t: Tables) -> DataFrame:
    """Partial updates of dimension rows folded column by column."""
    pair = lambda name, c, when: F.when(when, F.create_map(F.lit(name), F.col(c))).otherwise(F.create_map().cast("map<string,string>"))
    key = F.col("o_orderkey")
    values = F.map_concat(pair("status", "o_orderstatus", key % 2 == 0), pair("priority", "o_orderpriority", key % 3 != 0))
    changes = t.orders.select(F.col("o_custkey").cast("string").alias("pk"), key.alias("seq"), values.alias("values"))
    return dims.as_table(dims.folded(changes), ["id", "status", "priority"])


@query(
    """WITH u AS (SELECT *, (o_orderkey * 7919 % 12 + 1) * 1000000000000 + o_orderkey AS pos FROM orders)
    SELECT CAST(o_custkey AS VARCHAR) AS id, arg_max(o_orderstatus, pos) FILTER (o_orderkey % 2 = 0) AS status, arg_max(o_orderpriority, pos) FILTER (o_orderkey % 3 <> 0) AS priority
    FROM u GROUP BY o_custkey"""
)
def cdc_ordered_fold(t: Tables) -> DataFrame:
    """Change records in no order, some twice, normalised, routed and folded by their places in the log."""
    names = ", ".join(x.split()[0] for x in schemas.ROUTING.split(", "))
    config = t.spark.sql(f"SELECT * FROM VALUES ('user_info', 'update', 'hbase', 'dim_user_info', 'id,status,priority', 'id', CAST(NULL AS STRING)) AS t({names})")
    rows = cdc.dimensions(cdc.routed(cdc.without_deletes(cdc.normalized(t.positioned_changes())), config))
    changes = rows.select(F.try_element_at("after", F.col("sink_pk")).alias("pk"), "seq", F.col("after").alias("values"))
    return dims.as_table(dims.folded(changes), ["id", "status", "priority"])


@query("SELECT id, part FROM (SELECT l_orderkey AS id, arg_max(l_partkey, CAST(l_linenumber AS BIGINT) * 1000000000 + l_partkey) AS part, max(l_linenumber) AS last FROM lineitem GROUP BY l_orderkey) WHERE last <> 7")
def cdc_handover(t: Tables) -> DataFrame:
    """A table loaded in chunks while it changed, and its log: the rows that are there in the end."""
    keys = t.lineitem.agg(F.min("l_orderkey"), F.max("l_orderkey")).first()
    chunks = handover.Chunks(keys[0], keys[1], max(1, (keys[1] - keys[0]) // 20))
    rows, marks = t.order_load(chunks)
    return handover.state(handover.handed_over(rows, marks, t.order_log(), chunks, "id", order.FIRST), "id")


# Visits -----------------------------------------------------------------------------------------------------------------


@query(f"WITH {_PAGES} SELECT event_id, mid, strftime(make_timestamp(ts * 1000), '%Y-%m-%d') AS day FROM ({_VISITS})")
def unique_visit(t: Tables) -> DataFrame:
    return visits.unique_visits(t.page_logs(), "event_id").select("event_id", "common.mid", day_text(event_time(F.col("ts"))).alias("day"))


@query(f"WITH {_PAGES} SELECT event_id, mid, ts FROM ({_JUMPS})")
def user_jump(t: Tables) -> DataFrame:
    return visits.user_jumps(t.page_logs(), "event_id", within_ms=JUMP_MS).select("event_id", "common.mid", "ts")


_HALF_DAY = 12 * 3_600_000


@query(
    f"""WITH {_E}, r AS (SELECT event_id, user_id, ms, event_type IN ('view', 'click') AS h0, lead(event_type IN ('view', 'click'), 1) OVER w AS h1, lead(ms, 1) OVER w AS t1,
      lead(coalesce(event_type NOT IN ('view', 'click'), false), 2) OVER w AS h2, lead(ms, 2) OVER w AS t2 FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ms, event_id)),
    o AS (SELECT *, CASE WHEN t1 IS NULL OR t1 - ms >= {_HALF_DAY} THEN 'timed_out' WHEN NOT h1 THEN NULL WHEN t2 IS NULL OR t2 - ms >= {_HALF_DAY} THEN 'timed_out' WHEN h2 THEN 'matched' END AS outcome,
      CASE WHEN t1 IS NULL OR t1 - ms >= {_HALF_DAY} THEN 1 WHEN t2 IS NULL OR t2 - ms >= {_HALF_DAY} THEN 2 ELSE 3 END AS met FROM r WHERE h0)
    SELECT event_id, CAST(user_id AS VARCHAR) AS mid, outcome, met, CASE met WHEN 1 THEN ms WHEN 2 THEN t1 ELSE t2 END AS until FROM o WHERE outcome IS NOT NULL"""
)
def pattern_match(t: Tables) -> DataFrame:
    """Two events of looking, right after them one of doing, within half a day; or the time passed before."""
    looks = F.coalesce(F.col("event_type").isin("view", "click"), F.lit(False))
    does = F.coalesce(~F.col("event_type").isin("view", "click"), F.lit(False))
    rows = t.event_rows().select("event_id", F.col("user_id").cast("string").alias("mid"), "ms", looks.alias("looks"), does.alias("does"))
    out = patterns.matched(rows, patterns.Pattern((("looks", 2), ("does", 1)), _HALF_DAY), "mid", "ms", "event_id")
    return out.select("event_id", "mid", F.col("_outcome").alias("outcome"), F.col("_met").alias("met"), F.col("_until").alias("until"))


# Orders -----------------------------------------------------------------------------------------------------------------


def _wide(t: Tables) -> DataFrame:
    return orders.order_wide(t.order_infos(), t.order_details(), LINE_BOUND)


@query(f"WITH {_LINES} SELECT detail_id, order_id, sku_id, sku_num, user_id, province_id, order_status, CAST(total_amount AS DOUBLE) AS total_amount, CAST(split_total_amount AS DOUBLE) AS split_total_amount FROM wide")
def order_interval_join(t: Tables) -> DataFrame:
    double = lambda c: F.col(c).cast("double").alias(c)
    return _wide(t).select("detail_id", "order_id", "sku_id", "sku_num", "user_id", "province_id", "order_status", double("total_amount"), double("split_total_amount"))


@query(
    f"""WITH {_LINES} SELECT detail_id, order_id, strftime(et, '%Y-%m-%d') AS create_date, strftime(et, '%H') AS create_hour, n_name AS province_name,
    'N-' || n_nationkey AS province_iso_code, CASE WHEN user_id % 2 = 0 THEN 'M' ELSE 'F' END AS user_gender,
    CAST(floor(date_diff('day', DATE '1960-01-01' + CAST(user_id % 15000 AS INTEGER), DATE '2024-01-01') / 365.0) AS INTEGER) AS user_age,
    p_name AS sku_name, 'spu ' || (p_partkey % 50) AS spu_name, p_brand AS tm_name, 'size ' || p_size AS category3_name
    FROM wide LEFT JOIN nation ON n_nationkey = province_id LEFT JOIN part ON p_partkey = sku_id"""
)
def order_wide(t: Tables) -> DataFrame:
    """Order lines with their orders and all six dimensions."""
    out = orders.with_all_dims(_wide(t), t.dims(), F.lit("2024-01-01").cast("date"))
    return out.select(
        "detail_id", "order_id", "create_date", "create_hour", "province_name", "province_iso_code", "user_gender", "user_age", "sku_name", "spu_name", "tm_name", "category3_name"
    )


@query(
    f"""WITH {_LINES} SELECT payment_id, payment_type, strftime(pt, '%Y-%m-%d %H:%M:%S') AS payment_create_time, strftime(et, '%Y-%m-%d %H:%M:%S') AS order_create_time,
    detail_id, sku_id, user_id, CAST(split_total_amount AS DOUBLE) AS split_total_amount FROM paid"""
)
def payment_wide(t: Tables) -> DataFrame:
    out = orders.payment_wide(t.payments(), _wide(t))
    return out.select(
        "payment_id", "payment_type", "payment_create_time", "order_create_time", "detail_id", "sku_id", "user_id", F.col("split_total_amount").cast("double").alias("split_total_amount")
    )


@query(
    f"""SELECT o_orderkey AS id, o_custkey AS user_id, CAST({_MONEY.format('o_totalprice')} AS DOUBLE) AS total_amount, strftime(o_orderdate, '%Y-%m-%d') AS create_date,
    strftime(o_orderdate, '%H') AS create_hour, epoch_us(o_orderdate) // 1000 AS ms FROM orders"""
)
def order_json_parse(t: Tables) -> DataFrame:
    """Orders as the JSON of their topic, typed."""
    raw = orders.as_json(t.order_infos(), "et", "create_date", "create_hour")
    out = orders.order_infos(raw)
    return out.select("id", "user_id", F.col("total_amount").cast("double").alias("total_amount"), "create_date", "create_hour", F.unix_millis("et").alias("ms"))


@query(
    f"""SELECT o_orderkey AS id, o_orderkey AS order_id, CAST({_MONEY.format('o_totalprice')} AS DOUBLE) AS total_amount, o_orderpriority AS payment_type,
    epoch_us(o_orderdate + to_minutes(CAST(o_orderkey % 20 AS BIGINT))) // 1000 AS ms FROM orders WHERE o_orderstatus = 'F'"""
)
def payment_json_parse(t: Tables) -> DataFrame:
    """Payments as the JSON of their topic, typed."""
    out = orders.payments(orders.as_json(t.payments(), "et"))
    return out.select("id", "order_id", F.col("total_amount").cast("double").alias("total_amount"), "payment_type", F.unix_millis("et").alias("ms"))


@query("SELECT c_custkey, CAST(floor(date_diff('day', DATE '1960-01-01' + CAST(c_custkey % 15000 AS INTEGER), DATE '2024-01-01') / 365.0) AS INTEGER) AS user_age FROM customer")
def user_age(t: Tables) -> DataFrame:
    born = t.dims()["user"]
    return born.select(F.col("ID").cast("bigint").alias("c_custkey"), age(F.col("BIRTHDAY"), F.lit("2024-01-01").cast("date")).alias("user_age"))


@query(
    """WITH v AS (SELECT l_partkey, l_shipdate AS since, max(l_orderkey * 10 + l_linenumber) AS returned FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL)
    SELECT l_orderkey * 10 + l_linenumber AS detail_id, returned FROM lineitem ASOF LEFT JOIN v ON lineitem.l_partkey = v.l_partkey AND lineitem.l_shipdate >= v.since"""
)
def dim_as_of(t: Tables) -> DataFrame:
    """Each line with the last line of its product that had been sent back when it was shipped."""
    rows = t.lineitem.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("detail_id"), "l_partkey", "l_returnflag", F.col("l_shipdate").cast("timestamp").alias("et"))
    versions = rows.where("l_returnflag = 'R'").withColumn("seq", F.col("detail_id"))
    return dims.as_of_join(rows, versions, "l_partkey", "l_partkey", {"returned": "detail_id"}).select("detail_id", "returned")


# Statistics -------------------------------------------------------------------------------------------------------------

_CLICKS = "SELECT CAST(item AS BIGINT) AS sku_id, make_timestamp(ts * 1000) AS et, 0 AS display_ct, 1 AS click_ct FROM pages WHERE page_id = 'good_detail'"
_DISPLAYS = f"SELECT item AS sku_id, make_timestamp(ts * 1000) AS et, 1 AS display_ct, 0 AS click_ct FROM ({_SHOWN}) WHERE item % 2 = 0"
_REFUNDS = f"SELECT l_partkey AS sku_id, l_shipdate AS et, {_MONEY.format('l_extendedprice * (1 - l_discount)')} AS amount, l_orderkey FROM lineitem WHERE l_returnflag = 'R'"
_FACTS = f"""{_PAGES}, {_LINES}, f AS (
  SELECT sku_id, et, display_ct, click_ct, 0 AS favor_ct, 0 AS cart_ct, 0 AS order_sku_num, 0 AS comment_ct, 0 AS good_comment_ct, 0 AS order_amount, 0 AS payment_amount,
    0 AS refund_amount, NULL AS ordered, NULL AS paid_id, NULL AS refunded FROM ({_CLICKS} UNION ALL {_DISPLAYS})
  UNION ALL SELECT event_id % 200, make_timestamp(ms * 1000), 0, 0, 1, 0, 0, 0, 0, 0, 0, 0, NULL, NULL, NULL FROM e WHERE event_type = 'signup'
  UNION ALL SELECT event_id % 200, make_timestamp(ms * 1000), 0, 0, 0, k % 5 + 1, 0, 0, 0, 0, 0, 0, NULL, NULL, NULL FROM e WHERE event_type = 'purchase'
  UNION ALL SELECT event_id % 200, make_timestamp(ms * 1000), 0, 0, 0, 0, 0, 1, CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END, 0, 0, 0, NULL, NULL, NULL FROM e WHERE event_type = 'error'
  UNION ALL SELECT sku_id, et, 0, 0, 0, 0, sku_num, 0, 0, split_total_amount, 0, 0, order_id, NULL, NULL FROM wide
  UNION ALL SELECT sku_id, pt, 0, 0, 0, 0, 0, 0, 0, 0, split_total_amount, 0, NULL, order_id, NULL FROM paid
  UNION ALL SELECT sku_id, et, 0, 0, 0, 0, 0, 0, 0, 0, 0, amount, NULL, NULL, l_orderkey FROM ({_REFUNDS}))"""
_SUMS = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in ("display_ct", "click_ct", "favor_ct", "cart_ct", "order_sku_num", "comment_ct", "good_comment_ct"))
_AMOUNTS = ", ".join(f"CAST(sum({c}) AS DOUBLE) AS {c}" for c in ("order_amount", "payment_amount", "refund_amount"))


@query(f"WITH {_PAGES} SELECT sku_id, epoch_us(et) // 1000 AS ms, CAST(display_ct AS BIGINT) AS display_ct, CAST(click_ct AS BIGINT) AS click_ct FROM ({_CLICKS} UNION ALL {_DISPLAYS})")
def click_display_facts(t: Tables) -> DataFrame:
    pages = t.page_logs()
    out = stats.product_facts(stats.click_facts(pages), stats.display_facts(pages))
    return out.select("sku_id", F.unix_millis("et").alias("ms"), "display_ct", "click_ct")


def _product_facts(t: Tables) -> DataFrame:
    """The facts of product_facts_union in one pass over events and one over lines with their orders and payments."""
    kind, sku = F.col("event_type"), F.array(F.col("event_id") % 200)
    one = F.lit(1).cast("long")
    shown = F.transform(F.filter("displays", lambda d: d["item_type"] == "sku_id"), lambda d: d["item"].try_cast("long"))
    clicked = (F.col("page.page_id") == "good_detail") & (F.col("page.item_type") == "sku_id")
    of_events = stats.facts_of(
        t.page_logs("event_type", "k", "et"), (F.coalesce(clicked, F.lit(False)), F.array(F.col("page.item").try_cast("long")), {"click_ct": one}), (F.col("displays").isNotNull(), shown, {"display_ct": one}),
        (kind == "signup", sku, {"favor_ct": one}), (kind == "purchase", sku, {"cart_ct": F.col("k") % 5 + 1}),
        (kind == "error", sku, {"comment_ct": one, "good_comment_ct": F.when(F.col("k") % 3 == 0, one).otherwise(0)}),
    )
    paid = t.payments().groupBy("order_id").agg(F.collect_list("et").alias("_paid_at"))  # an order's payments
    infos = t.order_infos().join(paid, F.col("id") == F.col("order_id"), "left").drop("order_id")
    wide = orders.order_wide(infos, t.order_details(), LINE_BOUND, keep=("_paid_at",))
    return stats.product_facts(of_events, stats.order_and_payment_facts(wide, "_paid_at"), stats.refund_facts(t.refunds()))


def _product_topics(t: Tables) -> DataFrame:
    """The same facts as the union of eight kinds, each from a table of its own."""
    pages, wide = t.page_logs(), _wide(t)
    return stats.product_facts(
        stats.click_facts(pages), stats.display_facts(pages), stats.favor_facts(t.favors()), stats.cart_facts(t.carts()), stats.comment_facts(t.comments()),
        stats.order_facts(wide), stats.payment_facts(orders.payment_wide(t.payments(), wide)), stats.refund_facts(t.refunds()),
    )


@query(f"WITH {_FACTS} SELECT {_SUMS}, {_AMOUNTS}, count(*) AS n FROM f")
def product_facts_union(t: Tables) -> DataFrame:
    """Control sums of the union of all product facts."""
    f = _product_topics(t)
    counts = [F.sum(c).alias(c) for c in ("display_ct", "click_ct", "favor_ct", "cart_ct", "order_sku_num", "comment_ct", "good_comment_ct")]
    return f.agg(*counts, *[F.sum(c).cast("double").alias(c) for c in ("order_amount", "payment_amount", "refund_amount")], F.count(F.lit(1)).alias("n"))


_ROWS = ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in ("display_ct", "click_ct", "favor_ct", "cart_ct", "order_sku_num", "comment_ct", "good_comment_ct"))
_WORTH = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in ("order_amount", "payment_amount", "refund_amount"))


@query(f"WITH {_FACTS} SELECT sku_id, epoch_us(et) // 1000 AS ms, {_ROWS}, {_WORTH}, CAST(ordered AS BIGINT) AS ordered, CAST(paid_id AS BIGINT) AS paid, CAST(refunded AS BIGINT) AS refunded FROM f")
def product_facts_rows(t: Tables) -> DataFrame:
    """The union of all product facts, row by row."""
    f = _product_topics(t)
    ids = [F.col(c).alias(c[1:]) for c in ("_ordered", "_paid", "_refunded")]
    counts = ("display_ct", "click_ct", "favor_ct", "cart_ct", "order_sku_num", "comment_ct", "good_comment_ct")
    return f.select("sku_id", F.unix_millis("et").alias("ms"), *counts, *[F.col(c).cast("double").alias(c) for c in ("order_amount", "payment_amount", "refund_amount")], *ids)


@query(
    f"""WITH {_FACTS}, s AS (SELECT {_bounds('et', 86400)}, sku_id, {_SUMS}, {_AMOUNTS}, count(DISTINCT ordered) AS order_ct, count(DISTINCT paid_id) AS paid_order_ct,
      count(DISTINCT refunded) AS refund_order_ct, min(epoch_us(et) // 1000) AS ts FROM f GROUP BY ALL)
    SELECT s.*, p_name AS sku_name, CAST(p_partkey % 50 AS BIGINT) AS spu_id, 'spu ' || (p_partkey % 50) AS spu_name, p_brand AS tm_name, 'size ' || p_size AS category3_name,
      CAST(floor(p_retailprice * 100 + 0.5) / 100 AS DOUBLE) AS sku_price FROM s LEFT JOIN part ON p_partkey = sku_id"""
)
def product_stats(t: Tables) -> DataFrame:
    """Eight kinds of facts, a day's statistics of each product, and its dimensions."""
    out = stats.product_stats(_product_facts(t), t.dims(), DAY)
    return out.drop("tm_id", "category3_id").withColumns({c: F.col(c).cast("double") for c in ("sku_price", "order_amount", "payment_amount", "refund_amount")})


_VFACTS = f"""{_PAGES}, f AS (
  SELECT vc, ch, ar, is_new, ts, 0 AS uv, 1 AS pv, CASE WHEN entry THEN 1 ELSE 0 END AS sv, 0 AS uj, during_time AS dur FROM pages
  UNION ALL SELECT vc, ch, ar, is_new, ts, 1, 0, 0, 0, 0 FROM ({_VISITS}) UNION ALL SELECT vc, ch, ar, is_new, ts, 0, 0, 0, 1, 0 FROM ({_JUMPS}))"""


@query(
    f"""WITH {_VFACTS} SELECT vc, ch, ar, is_new, ts AS ms, CAST(uv AS BIGINT) AS uv_ct, CAST(pv AS BIGINT) AS pv_ct, CAST(sv AS BIGINT) AS sv_ct, CAST(uj AS BIGINT) AS uj_ct,
    CAST(dur AS BIGINT) AS dur_sum FROM f"""
)
def visitor_facts_union(t: Tables) -> DataFrame:
    pages = t.page_logs()
    facts = stats.visitor_facts(pages, visits.unique_visits(pages, "event_id"), visits.user_jumps(pages, "event_id", within_ms=JUMP_MS))
    return facts.select("vc", "ch", "ar", "is_new", F.unix_millis("et").alias("ms"), "uv_ct", "pv_ct", "sv_ct", "uj_ct", "dur_sum")


@query(
    f"""WITH {_VFACTS} SELECT {_bounds('make_timestamp(ts * 1000)', 3600)}, vc, ch, ar, is_new, CAST(sum(uv) AS BIGINT) AS uv_ct, CAST(sum(pv) AS BIGINT) AS pv_ct,
    CAST(sum(sv) AS BIGINT) AS sv_ct, CAST(sum(uj) AS BIGINT) AS uj_ct, CAST(sum(dur) AS BIGINT) AS dur_sum, min(ts) AS ts FROM f GROUP BY ALL"""
)
def visitor_stats(t: Tables) -> DataFrame:
    return stats.visitor_stats(stats.visitor_page_facts(t.page_logs(), "event_id", within_ms=JUMP_MS), HOUR)


@query(
    f"""WITH {_LINES} SELECT {_bounds('et', 86400)}, province_id, n_name AS province_name, CAST(100000 + n_nationkey AS VARCHAR) AS province_area_code, 'N-' || n_nationkey AS province_iso_code,
    'R-' || n_regionkey AS province_3166_2_code, CAST(sum(split_total_amount) AS DOUBLE) AS order_amount, count(DISTINCT order_id) AS order_count, min(epoch_us(et) // 1000) AS ts
    FROM wide LEFT JOIN nation ON n_nationkey = province_id GROUP BY ALL"""
)
def province_stats(t: Tables) -> DataFrame:
    out = stats.province_stats(orders.with_province(_wide(t), t.dims()["province"]), size=DAY)
    return out.withColumn("order_amount", F.col("order_amount").cast("double"))


_WORDS = "SELECT unnest(regexp_extract_all(lower(item), '[a-z0-9]+')) AS keyword, make_timestamp(ts // 1000 * 1000000) AS et FROM pages WHERE item_type = 'keyword' AND last_page_id = 'search'"


@query(f"WITH {_PAGES} SELECT keyword, epoch_us(et) // 1000 AS ms FROM ({_WORDS})")
def keyword_split(t: Tables) -> DataFrame:
    return stats.split_keywords(stats.searched(t.page_logs())).select("keyword", F.unix_millis("et").alias("ms"))


@query(f"WITH {_PAGES} SELECT keyword, count(*) AS ct, 'search' AS source, {_bounds('et', 3600)}, min(epoch_us(et) // 1000) AS ts FROM ({_WORDS}) GROUP BY ALL")
def keyword_stats(t: Tables) -> DataFrame:
    return stats.keyword_stats(stats.split_keywords(stats.searched(t.page_logs())), HOUR)


# Documents have neither clock nor phrases of searching: one a second, from the events' first day on.
_TEXTS = "SELECT lower(text) AS t, to_timestamp(1704067200 + doc_id) AT TIME ZONE 'UTC' AS et FROM documents"


@query(f"""WITH w AS (SELECT unnest(regexp_extract_all(t, '[a-z0-9]+')) AS keyword, et FROM ({_TEXTS}))
    SELECT keyword, count(*) AS ct, 'documents' AS source, {_bounds('et', 3600)}, min(epoch_us(et) // 1000) AS ts FROM w GROUP BY ALL""")
def keyword_documents(t: Tables) -> DataFrame:
    """Keywords of whole texts, long ones among them."""
    phrases = t.documents.select(F.col("text").alias("full_word"), F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id")).alias("et"))
    return stats.keyword_stats(stats.split_keywords(phrases), HOUR, source="documents")


_HAN, _LATIN = "红色小大部件金木水火土山川日月天人中国新老高", "abcdefghijklmnopqrstuv"


@query(
    f"""WITH d AS (SELECT DISTINCT translate(lower(substr(p_name, s, l)), '{_LATIN}', '{_HAN}') AS word FROM part, (VALUES (1), (3), (5)) AS a(s), (VALUES (2), (3)) AS b(l) WHERE p_partkey % 2 = 0 AND length(p_name) >= s + l - 1),
    c AS (SELECT word FROM d WHERE length(regexp_replace(word, '[^{_HAN}]', '', 'g')) = length(word)),
    p AS (SELECT p_partkey, translate(lower(p_name), '{_LATIN}', '{_HAN}') || ' ' || lower(p_brand) AS t FROM part),
    k AS (SELECT p_partkey, t, unnest(range(1, length(t) + 1)) AS i FROM p),
    x AS (SELECT p_partkey, i AS at, substr(t, i, l) AS keyword FROM k, (VALUES (2), (3)) AS b(l) WHERE i + l - 1 <= length(t) AND substr(t, i, l) IN (SELECT word FROM c)),
    y AS (SELECT p_partkey, i AS at, substr(t, i, 1) AS keyword FROM k WHERE contains('{_HAN}', substr(t, i, 1))
      AND NOT EXISTS (SELECT 1 FROM x WHERE x.p_partkey = k.p_partkey AND x.at <= k.i AND x.at + length(x.keyword) > k.i)),
    z AS (SELECT p_partkey, unnest(regexp_extract_all(t, '[a-z0-9]+')) AS keyword FROM p)
    SELECT keyword, count(*) AS ct FROM (SELECT p_partkey, keyword FROM x UNION ALL SELECT p_partkey, keyword FROM y UNION ALL SELECT p_partkey, keyword FROM z) GROUP BY keyword"""
)
def keyword_words(t: Tables) -> DataFrame:
    """Names of products with letters as Han characters, cut by a dictionary of parts of other names."""
    text = lambda c: F.translate(F.lower(c), _LATIN, _HAN)
    pieces = F.array(*[F.when(F.length("p_name") >= s + n - 1, F.substring("p_name", s, n)) for s in (1, 3, 5) for n in (2, 3)])
    dictionary = t.part.where("p_partkey % 2 = 0").select(F.explode(pieces).alias("word")).select(text("word").alias("word")).where(F.col("word").rlike(f"^[{_HAN}]+$"))
    phrases = t.part.select("p_partkey", F.concat(text("p_name"), F.lit(" "), F.lower("p_brand")).alias("full_word"))
    return words.segmented(phrases, dictionary).groupBy("keyword").agg(F.count(F.lit(1)).alias("ct"))

"""Statistics: facts of each kind, their unions, and tumbling windows over them.

Facts carry their event time in et. On streams, call withWatermark on the union before the statistics. ts of a result is in milliseconds: the least
event time of its window, or on demand the time of its computation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemart import schemas
from tidemart.functions.scalars import day_text, event_time, keywords, time_text
from tidemart.operators.dims import dim_join
from tidemart.operators.logs import displays
from tidemart.operators.visits import is_entry

#: Code of a good appraisal.
GOOD = "1201"
_visitor = ("common.vc", "common.ch", "common.ar", "common.is_new")



def _n(x: int, kind: str = "long") -> Column:
    return F.lit(x).cast(kind)


# Facts of visitors --------------------------------------------------------------------------------------------------


def pv_facts(pages: DataFrame) -> DataFrame:
    entry = F.when(is_entry(F.col("page.last_page_id")), _n(1)).otherwise(_n(0))
    return pages.select(*_visitor, event_time(F.col("ts")).alias("et"), _n(1).alias("pv_ct"), entry.alias("sv_ct"), F.col("page.during_time").alias("dur_sum"))


def uv_facts(visits: DataFrame) -> DataFrame:
    return visits.select(*_visitor, event_time(F.col("ts")).alias("et"), _n(1).alias("uv_ct"))


def uj_facts(jumps: DataFrame) -> DataFrame:
    return jumps.select(*_visitor, event_time(F.col("ts")).alias("et"), _n(1).alias("uj_ct"))


def visitor_facts(pages: DataFrame, visits: DataFrame, jumps: DataFrame) -> DataFrame:
    both = pv_facts(pages).unionByName(uv_facts(visits), True).unionByName(uj_facts(jumps), True)
    return both.na.fill(0, ["pv_ct", "sv_ct", "dur_sum", "uv_ct", "uj_ct"])


def visitor_page_facts(pages: DataFrame, *tiebreak: str, within_ms: int = 10_000) -> DataFrame:
    """What visitor_facts() makes of pages, their first visits and bounces, with all measures of a page in one row: for tables, on which one shuffle and
    sort by visitor tells both. Pages without a visitor or a time are views only; those without a visitor are dealt to many tasks."""
    mid, ts = F.col("common.mid"), F.col("ts")
    known = mid.isNotNull() & ts.isNotNull()
    rows = pages.withColumns({
        "_mid": mid, "_deal": F.when(mid.isNull(), F.xxhash64(ts, *tiebreak)), "_entry": is_entry(F.col("page.last_page_id")), "_day": day_text(event_time(ts)),
    })
    w = Window.partitionBy("_mid", "_deal").orderBy("ts", *tiebreak)
    before = F.last(F.when(F.col("_entry"), F.col("_day")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    follows, again = F.lead("ts").over(w), F.lead("_entry").over(w)
    rows = rows.withColumns({
        "_first": known & F.col("_entry") & ~F.col("_day").eqNullSafe(before), "_left": known & F.col("_entry") & (follows.isNull() | (follows - ts >= within_ms) | again),
    })
    one = lambda c: F.when(F.col(c), _n(1)).otherwise(_n(0))
    measures = [_n(1).alias("pv_ct"), one("_entry").alias("sv_ct"), F.coalesce(F.col("page.during_time"), _n(0)).alias("dur_sum"), one("_first").alias("uv_ct"), one("_left").alias("uj_ct")]
    return rows.select(*_visitor, event_time(ts).alias("et"), *measures)


# Facts of products --------------------------------------------------------------------------------------------------


def click_facts(pages: DataFrame) -> DataFrame:
    hit = pages.where("page.page_id = 'good_detail' AND page.item_type = 'sku_id'")
    return hit.select(F.col("page.item").try_cast("long").alias("sku_id"), event_time(F.col("ts")).alias("et"), _n(1).alias("click_ct"))


def display_facts(pages: DataFrame) -> DataFrame:
    shown = displays(pages).where("item_type = 'sku_id'")
    return shown.select(F.col("item").try_cast("long").alias("sku_id"), event_time(F.col("ts")).alias("et"), _n(1).alias("display_ct"))


def favor_facts(favors: DataFrame) -> DataFrame:
    return favors.select("sku_id", "et", _n(1).alias("favor_ct"))


def cart_facts(carts: DataFrame, measure: str = "sku_num") -> DataFrame:
    """measure: 'sku_num' counts pieces, 'rows' counts additions."""
    return carts.select("sku_id", "et", (F.col("sku_num").cast("long") if measure == "sku_num" else _n(1)).alias("cart_ct"))


def order_facts(wide: DataFrame, amount_col: str = "split_total_amount") -> DataFrame:
    """amount_col: what a line is worth; the order's total would be counted once for each of its lines."""
    return wide.select("sku_id", "et", F.col("sku_num").alias("order_sku_num"), F.col(amount_col).alias("order_amount"), F.col("order_id").alias("_ordered"))


def payment_facts(wide: DataFrame, amount_col: str = "split_total_amount") -> DataFrame:
    return wide.select("sku_id", "et", F.col(amount_col).alias("payment_amount"), F.col("order_id").alias("_paid"))


def refund_facts(refunds: DataFrame) -> DataFrame:
    return refunds.select("sku_id", "et", "refund_amount", F.col("order_id").alias("_refunded"))


def comment_facts(comments: DataFrame) -> DataFrame:
    good = F.when(F.col("appraise") == GOOD, _n(1)).otherwise(_n(0))
    return comments.select("sku_id", "et", _n(1).alias("comment_ct"), good.alias("good_comment_ct"))


def order_and_payment_facts(wide: DataFrame, paid_at: str, before: str = "15 MINUTES", amount_col: str = "split_total_amount") -> DataFrame:
    """What order_facts() and payment_facts() make of order lines and of their orders' payments, in one pass: paid_at, a column of wide, holds the times
    of the order's payments (array; null: none), of which those count that come up to before after the order."""
    late = F.expr(f"INTERVAL {before}")
    due = F.filter(F.coalesce(paid_at, F.array().cast("array<timestamp>")), lambda t: (t >= F.col("et")) & (t <= F.col("et") + late))
    ordered = F.array(F.struct(F.lit(True).alias("ordered"), F.col("et").alias("et")))
    both = F.concat(ordered, F.transform(due, lambda t: F.struct(F.lit(False).alias("ordered"), t.alias("et"))))
    rows = wide.withColumn("_f", F.explode(both))
    mine = lambda c, yes: F.when(F.col("_f.ordered") if yes else ~F.col("_f.ordered"), F.col(c))
    return rows.select(
        "sku_id", F.col("_f.et").alias("et"), mine("sku_num", True).alias("order_sku_num"), mine(amount_col, True).alias("order_amount"), mine("order_id", True).alias("_ordered"),
        mine(amount_col, False).alias("payment_amount"), mine("order_id", False).alias("_paid"),
    )


def facts_of(rows: DataFrame, *facts: tuple[Column, Column, dict[str, Column]]) -> DataFrame:
    """Facts of several kinds from one pass over rows (et): each is (condition, product ids: array<bigint>, {measure: value}). Where one table brings what
    would else be topics of their own."""
    names = list(dict.fromkeys(n for _, _, measures in facts for n in measures))
    one = lambda m: lambda sku: F.struct(sku.alias("sku_id"), *[m.get(n, _n(0)).cast("long").alias(n) for n in names])
    none = F.array().cast("array<struct<sku_id: bigint, " + ", ".join(f"{n}: bigint" for n in names) + ">>")
    parts = [F.when(holds, F.transform(skus, one(m))).otherwise(none) for holds, skus, m in facts]
    return rows.select("et", F.explode(F.concat(*parts)).alias("_f")).select("et", "_f.*")


_counts = ["display_ct", "click_ct", "favor_ct", "cart_ct", "order_sku_num", "comment_ct", "good_comment_ct"]
_amounts = ["order_amount", "payment_amount", "refund_amount"]
_distinct = {"order_ct": "_ordered", "paid_order_ct": "_paid", "refund_order_ct": "_refunded"}


def product_facts(*facts: DataFrame) -> DataFrame:
    """The union of product facts of any kinds; measures that a fact doesn't have are 0, ids null. All three ids are bigints."""
    out = facts[0]
    for f in facts[1:]:
        out = out.unionByName(f, True)
    have = set(out.columns)
    kinds = {c: "long" for c in [*_counts, *_distinct.values()]} | {c: schemas.MONEY for c in _amounts}
    out = out.withColumns({c: F.lit(None).cast(k) for c, k in kinds.items() if c not in have})
    zeros = {c: F.coalesce(c, _n(0)) for c in _counts} | {c: F.coalesce(F.col(c).cast(schemas.MONEY), _n(0, schemas.MONEY)) for c in _amounts}
    return out.withColumns(zeros).select("sku_id", "et", *_counts, *_amounts, *_distinct.values())


# Windows ------------------------------------------------------------------------------------------------------------


def _window(size: str) -> Column:
    return F.window("et", size)


def _bounds() -> list[Column]:
    return [time_text(F.col("window.start")).alias("stt"), time_text(F.col("window.end")).alias("edt")]


def _ts(ts: str) -> Column:
    """ts of a result: 'event', the least event time of its window (the same whenever it is computed), or 'computed', the time at which it is."""
    if ts not in ("event", "computed"):
        raise ValueError("ts is 'event' or 'computed'")
    return (F.unix_millis(F.min("et").cast("timestamp")) if ts == "event" else F.max(F.unix_millis(F.current_timestamp()))).alias("ts")


def with_distinct(facts: DataFrame, size: str, keys: list[str], ids: dict[str, str], sums: list[str], ts: str = "event") -> DataFrame:
    """window, keys, the sums of columns, {new: exact number of different values of an id column}, nulls apart, and ts.

    A row has one of the ids at most. Rows are first summed by (kind, id), then by keys: two aggregates one after the other, which on
    streams are two operators with a state row for each id, spread over all partitions, in place of one growing set in the state of a key.
    """
    kinds = F.coalesce(*[F.when(F.col(c).isNotNull(), n) for n, c in ids.items()])
    marked = facts.withColumns({"_kind": kinds, "_id": F.coalesce(*ids.values())})
    total = lambda c, kind: F.sum(c).cast(kind).alias(c)
    added = [total(c, facts.schema[c].dataType) for c in sums]
    once = marked.groupBy(_window(size), *keys, "_kind", "_id").agg(*added, F.min("et").alias("et"))
    counts = [F.count(F.when(F.col("_kind") == n, F.lit(1))).alias(n) for n in ids]
    return once.groupBy("window", *keys).agg(*added, *counts, _ts(ts))


def visitor_stats(facts: DataFrame, size: str = "10 seconds", ts: str = "event") -> DataFrame:
    measures = [F.sum(c).alias(c) for c in ("uv_ct", "pv_ct", "sv_ct", "uj_ct", "dur_sum")]
    out = facts.groupBy(_window(size), "vc", "ch", "ar", "is_new").agg(*measures, _ts(ts))
    return out.select(*_bounds(), *schemas.VISITOR_STATS[2:])


def product_stats(facts: DataFrame, dims: dict[str, DataFrame], size: str = "10 seconds", how: str = "left", ts: str = "event") -> DataFrame:
    """Aggregates by product first, then joins the dimensions, which depend on the product alone. dims: sku, spu, trademark, category3."""
    out = with_distinct(facts, size, ["sku_id"], _distinct, [*_counts, *_amounts], ts)
    out = out.select(*_bounds(), *[c for c in out.columns if c != "window"])
    names = {"sku_name": "SKU_NAME", "sku_price": "PRICE", "spu_id": "SPU_ID", "tm_id": "TM_ID", "category3_id": "CATEGORY3_ID"}
    out = dim_join(out, dims["sku"], "sku_id", "ID", names, how)
    out = dim_join(out, dims["spu"], "spu_id", "ID", {"spu_name": "SPU_NAME"}, how)
    out = dim_join(out, dims["trademark"], "tm_id", "ID", {"tm_name": "TM_NAME"}, how)
    out = dim_join(out, dims["category3"], "category3_id", "ID", {"category3_name": "NAME"}, how)
    money = {"sku_price": F.col("sku_price").try_cast(schemas.MONEY)} | {c: F.col(c).try_cast("long") for c in ("spu_id", "tm_id", "category3_id")}
    return out.withColumns(money).select(*schemas.PRODUCT_STATS)


def province_stats(wide: DataFrame, amount_col: str = "split_total_amount", size: str = "10 seconds", ts: str = "event") -> DataFrame:
    keys = schemas.PROVINCE_STATS[2:7]
    rows = wide.select("et", *keys, F.col(amount_col).cast(schemas.MONEY).alias("order_amount"), F.col("order_id").cast("long").alias("_ordered"))
    out = with_distinct(rows, size, keys, {"order_count": "_ordered"}, ["order_amount"], ts)
    return out.select(*_bounds(), *schemas.PROVINCE_STATS[2:])


def searched(pages: DataFrame, require_last_page: bool = True) -> DataFrame:
    """Search phrases: full_word, et (whole seconds)."""
    hit = F.expr("page.item_type = 'keyword' AND page.item IS NOT NULL")
    if require_last_page:
        hit = hit & F.expr("page.last_page_id = 'search'")
    return pages.where(hit).select(F.col("page.item").alias("full_word"), F.timestamp_seconds(F.floor(F.col("ts") / 1000)).alias("et"))


def split_keywords(phrases: DataFrame) -> DataFrame:
    """A row per keyword of full_word; phrases without any have none."""
    return phrases.select(F.explode(keywords(F.col("full_word"))).alias("keyword"), "et")


def keyword_stats(words: DataFrame, size: str = "10 seconds", source: str = "search", ts: str = "event") -> DataFrame:
    out = words.groupBy(_window(size), "keyword").agg(F.count(F.lit(1)).alias("ct"), _ts(ts))
    return out.select("keyword", "ct", F.lit(source).alias("source"), *_bounds(), "ts")

"""Orders and payments: typed rows, interval joins, wide rows, dimensions.

Interval joins are equi-joins with a range on event time, inner, bounds included. On streams both sides need a watermark on their
event time, from which Spark derives how long it keeps each row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemart import schemas
from tidemart.functions.scalars import age, date_part, first_non_null, hour_part
from tidemart.operators.dims import dim_join


def _typed(raw: DataFrame, schema: str, *kept: str) -> DataFrame:
    """raw (value: JSON) with the fields of schema and the columns kept. Change topics carry every value as a string, so numbers may be written as strings; what is
    no number becomes null."""
    fields = [x.rsplit(" ", 1) for x in schema.split(", ")]
    rows = raw.select(F.from_json("value", ", ".join(f"{name} string" for name, _ in fields)).alias("r"), *kept)
    return rows.select(*kept, *[F.col(f"r.{name}").try_cast(kind).alias(name) for name, kind in fields])


def order_infos(raw: DataFrame) -> DataFrame:
    """raw (value: JSON) typed, with create_date, create_hour and the event time et; et is null for a create_time that doesn't parse."""
    rows = _typed(raw, schemas.ORDER_INFO)
    return rows.withColumns({"create_date": date_part(F.col("create_time")), "create_hour": hour_part(F.col("create_time")), "et": F.try_to_timestamp("create_time")})


def order_details(raw: DataFrame) -> DataFrame:
    return _typed(raw, schemas.ORDER_DETAIL).withColumn("et", F.try_to_timestamp("create_time"))


def payments(raw: DataFrame, seen_at: str | None = None) -> DataFrame:
    """seen_at: a column of raw with the time at which the record came in, which stands in for a create_time that doesn't parse."""
    kept = [seen_at] if seen_at else []
    rows = _typed(raw, schemas.PAYMENT_INFO, *kept)
    return rows.withColumn("et", F.coalesce(F.try_to_timestamp("create_time"), *[F.col(c).cast("timestamp") for c in kept])).drop(*kept)


def without_time(typed: DataFrame) -> DataFrame:
    """Rows of order_infos, order_details or payments whose create_time doesn't parse, as JSON (value): a dirty output, since no interval join can
    place them."""
    return as_json(typed.where(F.col("et").isNull()), "et")


def _within(left: DataFrame, right: DataFrame, key: Column, before: str, after: str) -> DataFrame:
    """left joined with the rows of right (its event time: ret) from before its own et to after it."""
    span = (F.col("ret") >= F.col("et") - F.expr(f"INTERVAL {before}")) & (F.col("ret") <= F.col("et") + F.expr(f"INTERVAL {after}"))
    return left.join(right, key & span)


def order_wide(infos: DataFrame, details: DataFrame, bound: str = "5 SECONDS", keep: tuple[str, ...] = ()) -> DataFrame:
    """Order lines with their orders, within bound of each other; et is the order's. Columns that neither has are null. keep: more columns of the orders."""
    d = details.select(
        F.col("id").alias("detail_id"), "order_id", "sku_id", "order_price", "sku_num", "sku_name", "split_total_amount", "split_activity_amount",
        "split_coupon_amount", F.col("et").alias("ret"),
    )
    met = _within(infos, d, F.col("id") == F.col("order_id"), bound, bound).drop("expire_time", "operate_time")
    money, text = F.lit(None).cast(schemas.MONEY), F.lit(None).cast("string")
    met = met.withColumns({"split_feight_fee": money, "expire_time": text, "operate_time": text})
    return met.select(*[c for c in schemas.ORDER_WIDE if c in met.columns], "et", *keep)


def payment_wide(payments_: DataFrame, wide: DataFrame, before: str = "15 MINUTES") -> DataFrame:
    """Payments with the lines of their orders, of which the order was made up to before earlier. order_id, user_id and total_amount are the
    payment's. et is the payment's."""
    own = ("order_id", "user_id", "total_amount")
    p = payments_.select(
        F.col("id").alias("payment_id"), "subject", "payment_type", F.col("create_time").alias("payment_create_time"), "callback_time", *own, "et"
    )
    w = wide.select(
        F.col("order_id").alias("_order"), *[c for c in wide.columns if c not in (*own, "et", "create_time")],
        F.col("create_time").alias("order_create_time"), F.col("et").alias("ret"),
    )
    met = _within(p, w, F.col("order_id") == F.col("_order"), before, "0 SECONDS")
    return met.select(*[c for c in schemas.PAYMENT_WIDE if c in met.columns], "et")


def with_user(wide: DataFrame, users: DataFrame, as_of: Column, how: str = "left") -> DataFrame:
    out = dim_join(wide, users, "user_id", "ID", {"user_gender": "GENDER", "_born": "BIRTHDAY"}, how)
    return out.withColumn("user_age", age(F.col("_born"), as_of)).drop("_born")


def with_province(wide: DataFrame, provinces: DataFrame, how: str = "left") -> DataFrame:
    names = {"province_name": "NAME", "province_area_code": "AREA_CODE", "province_iso_code": "ISO_CODE", "province_3166_2_code": "ISO_3166_2"}
    return dim_join(wide, provinces, "province_id", "ID", names, how)


def with_sku(wide: DataFrame, skus: DataFrame, how: str = "left") -> DataFrame:
    return dim_join(wide, skus, "sku_id", "ID", {"sku_name": "SKU_NAME", "category3_id": "CATEGORY3_ID", "spu_id": "SPU_ID", "tm_id": "TM_ID"}, how)


def with_catalog(wide: DataFrame, spus: DataFrame, trademarks: DataFrame, categories: DataFrame, how: str = "left") -> DataFrame:
    """Names by the ids that with_sku brought."""
    out = dim_join(wide, spus, "spu_id", "ID", {"spu_name": "SPU_NAME"}, how)
    out = dim_join(out, trademarks, "tm_id", "ID", {"tm_name": "TM_NAME"}, how)
    return dim_join(out, categories, "category3_id", "ID", {"category3_name": "NAME"}, how)


def with_all_dims(wide: DataFrame, dims: dict[str, DataFrame], as_of: Column, how: str = "left") -> DataFrame:
    """dims: user, province, sku, spu, trademark, category3."""
    out = with_province(with_user(wide, dims["user"], as_of, how), dims["province"], how)
    out = with_catalog(with_sku(out, dims["sku"], how), dims["spu"], dims["trademark"], dims["category3"], how)
    return out.select(*[c for c in schemas.ORDER_WIDE if c in out.columns], *[c for c in ("et",) if c in out.columns])


def first_non_null_merge(rows: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """rows with their nulls filled from the row of other with the same key."""
    o = other.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_o_{c}") for c in other.columns if c != key])
    met = rows.join(o, F.col(key) == F.col("_key"), "left")
    return met.select(*[first_non_null(F.col(c), F.col(f"_o_{c}")).alias(c) if f"_o_{c}" in o.columns else F.col(c) for c in rows.columns])


def as_json(rows: DataFrame, *drop: str) -> DataFrame:
    """value: each row as JSON, without its nulls."""
    return rows.drop(*drop).select(F.to_json(F.struct("*")).alias("value"))

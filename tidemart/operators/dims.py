"""Dimensions: the latest row of a key, folding partial updates, and joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemart.functions.scalars import camel


def latest_per_key(rows: DataFrame, key: str, seq: str) -> DataFrame:
    """The row of each key with the highest seq: an aggregate, not a sort; of equals one is taken by all its columns. Null keys are dropped."""
    cols = [c for c in rows.columns if c != key]
    best = F.max(F.struct(F.col(seq), *[F.col(c) for c in cols if c != seq])).alias("_b")
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(best).select(key, "_b.*").select(*rows.columns)


def folded(changes: DataFrame) -> DataFrame:
    """changes (pk, seq, values map<string,string>): the state of each pk, column by column: an update that leaves a column out keeps its value,
    one that names it replaces it, by null too."""
    cells = changes.where(F.col("pk").isNotNull()).select("pk", "seq", F.explode("values").alias("k", "v"))
    last = cells.groupBy("pk", "k").agg(F.max_by(F.struct("v"), F.struct("seq", "v")).alias("last"))
    return last.groupBy("pk").agg(F.map_from_entries(F.collect_list(F.struct("k", F.col("last.v").alias("v")))).alias("values"))  # a row's columns


def as_table(folded_: DataFrame, columns: list[str], pk: str = "id") -> DataFrame:
    """folded() as a table of strings with the given columns; pk is among them."""
    return folded_.select(*[F.col("pk").alias(c) if c == pk else F.try_element_at("values", F.lit(c)).alias(c) for c in columns])


def renamed_camel(rows: DataFrame) -> DataFrame:
    return rows.toDF(*[camel(c) for c in rows.columns])


def dim_join(facts: DataFrame, dim: DataFrame, fact_key: str, dim_key: str, columns: dict[str, str], how: str = "left") -> DataFrame:
    """facts with columns {new: dimension's}; a new name that facts has is replaced where the key is found.

    how='left' keeps facts without a dimension row, with nulls (or their own values); 'inner' drops them. dim has one row per key. Whether it
    is broadcast is left to Spark, which knows its size.
    """
    taken = {*facts.columns, *columns}
    key, met_ = fresh("_key", taken), fresh("_met", taken)
    held = {n: fresh(f"_dim_{n}", taken) for n in columns}
    d = dim.select(F.col(dim_key).cast("string").alias(key), F.lit(True).alias(met_), *[F.col(c).alias(held[n]) for n, c in columns.items()])
    met = facts.join(d, F.col(fact_key).cast("string") == F.col(key), how)
    new = {n: F.when(F.col(met_), F.col(held[n])).otherwise(F.col(n)) if n in facts.columns else F.col(held[n]) for n in columns}
    return met.withColumns(new).drop(key, met_, *held.values())


def as_of_join(facts: DataFrame, versions: DataFrame, fact_key: str, dim_key: str, columns: dict[str, str]) -> DataFrame:
    """facts (et) with columns {new: dimension's} of the last version (dim_key, et, seq) that isn't later; of versions of one time the last by seq.

    A version holds until the next of its key, so each fact meets one: an equi-join with a range, whose busy keys Spark splits as in any other. Facts
    without a version have nulls; columns that facts have are replaced.
    """
    w = Window.partitionBy("_k").orderBy("_from", "seq")
    v = versions.where(F.col(dim_key).isNotNull() & F.col("et").isNotNull())
    v = v.select(F.col(dim_key).cast("string").alias("_k"), F.col("et").alias("_from"), "seq", *[F.col(c).alias(f"_dim_{n}") for n, c in columns.items()])
    v = v.withColumn("_to", F.lead("_from").over(w)).where("_to IS NULL OR _to > _from").drop("seq")
    held = facts.drop(*[n for n in columns if n not in (fact_key, "et")])
    within = (F.col(fact_key).cast("string") == F.col("_k")) & (F.col("et") >= F.col("_from")) & (F.col("_to").isNull() | (F.col("et") < F.col("_to")))
    met = held.join(v, within, "left")
    return met.select(*held.columns, *[F.col(f"_dim_{n}").alias(n) for n in columns])


def fresh(name: str, taken: set[str]) -> str:
    """name, or with underscores after it what none of taken is."""
    while name in taken:
        name += "_"
    return name

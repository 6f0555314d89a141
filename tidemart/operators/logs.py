"""Behaviour logs: parsing, dirty records, splitting, displays, new-visitor flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemart import schemas


def is_object(value: Column) -> Column:
    """Whether a string is a JSON object; other valid JSON (numbers, arrays) is not."""
    return F.try_parse_json(value).isNotNull() & _opens(value)


def _opens(value: Column) -> Column:
    return F.ltrim(value, F.lit(" \t\r\n")).startswith("{")


def _parsed(raw: DataFrame) -> DataFrame:
    """value and _v: the record as a variant, null unless it is an object. Each record is parsed this one time."""
    return raw.select("value").where(F.col("value").isNotNull()).withColumn("_v", F.when(_opens(F.col("value")), F.try_parse_json("value")))


def _good(marked: DataFrame, schema: str) -> DataFrame:
    # A start block of more than two characters, that is a non-empty one.
    begun = F.length(F.try_variant_get("_v", "$.start", "string")) > 2
    kind = F.when(F.coalesce(begun, F.lit(False)), "start").otherwise("page")
    fields = F.try_variant_get("_v", "$", f"struct<{schema}>")
    return marked.where(F.col("_v").isNotNull()).select("value", kind.alias("kind"), fields.alias("_r")).select("value", "kind", "_r.*")


def parse_or_dirty(raw: DataFrame, schema: str = schemas.PAGE_LOG) -> tuple[DataFrame, DataFrame]:
    """raw (value): (records with value, kind and the fields of schema, dirty rows with value). Null values are in neither. kind: 'start' if
    the record has a non-empty start block, else 'page', even without a page."""
    marked = _parsed(raw)
    return _good(marked, schema), marked.where(F.col("_v").isNull()).select("value")


def parse_drop_dirty(raw: DataFrame, schema: str = schemas.PAGE_LOG) -> DataFrame:
    return parse_or_dirty(raw, schema)[0]


def split_log(logs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(start logs, page logs) of parsed logs. For both in one pass keep kind, which tells them apart."""
    return logs.where("kind = 'start'"), logs.where("kind <> 'start'")


def with_flag(value: Column, is_new: Column) -> Column:
    """The JSON text of a log with another common.is_new; every other field keeps its value and type."""
    fields = F.from_json(value, "map<string,variant>")
    common = F.try_variant_get(F.element_at(fields, F.lit("common")), "$", "map<string,variant>")
    new = F.map_concat(F.map_filter(common, lambda k, _: k != "is_new"), F.create_map(F.lit("is_new"), is_new.cast("variant")))
    return F.to_json(F.transform_values(fields, lambda k, v: F.when(k == "common", F.to_variant_object(new)).otherwise(v)))


def displays(pages: DataFrame) -> DataFrame:
    """One row per display of a page log, with the page's id and time; pages without displays have none."""
    return pages.select(F.col("page.page_id").alias("page_id"), "ts", F.explode("displays").alias("d")).select("d.*", "page_id", "ts")


def repaired_is_new(logs: DataFrame, *tiebreak: str) -> DataFrame:
    """Batch form: of the logs of a mid that claim is_new '1', the first by ts (then tiebreak) keeps it; the others get '0'.
    Logs without a mid can't be told apart and are dropped, as the stream does."""
    w = Window.partitionBy("common.mid", "common.is_new").orderBy("ts", *tiebreak)
    again = (F.col("common.is_new") == "1") & (F.col("_n") > 1)
    numbered = logs.where(F.col("common.mid").isNotNull()).withColumn("_n", F.row_number().over(w))
    flag = F.when(again, F.lit("0")).otherwise(F.col("common.is_new"))
    return numbered.withColumn("common", F.col("common").withField("is_new", flag)).drop("_n")

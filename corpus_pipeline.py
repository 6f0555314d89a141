"""From raw documents to packed training sequences, in five stages.

1. language      documents without an identifiable language go
2. near_copies   of documents that are near copies of each other, the one with the smallest id stays
3. benchmarks    documents contaminated by benchmark passages go
4. personal      personal data in the texts is replaced by its kind
5. packing       the rest becomes pieces in sequences of at most 4096 ids

Each stage takes (spark, docs, sf_dir) and works on all rows of docs; run() writes each result as Parquet and rereads it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemart.llm import decontaminate, langid, ngram_join, packing, pii, scratch, tokens
from tidemart.llm.columns import fresh
from tidemart.llm.tables import table

#: Below this score no language is a fit. Texts of fewer characters than SHORT hold too few n-grams for that: a clean word can score as low as random letters.
LEAST_SCORE, SHORT, LEAST_SHORT = 0.25, 20, 0.1
#: Near copies share 80 of 100 five-word shingles.
PERCENT, WORDS = 80, 5
#: Rows of a batch that goes to a Python task; whole texts add up.
BATCH_ROWS = 1000


def _small_batches(spark: SparkSession) -> None:
    """For what runs after a stage has returned its frame: the session's own setting, as any job sets for its texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fits on the labelled rows of docs and scores all: those named 'und' or with a score below the least go. With no labelled row
    nothing tells languages apart, so all rows with a letter stay."""
    _small_batches(spark)
    model = langid.fit(docs)
    if model is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    least = F.when(F.length("text") < SHORT, LEAST_SHORT).otherwise(LEAST_SCORE)
    return langid.predicted(docs, model).where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("lang_score") >= least)).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays, the one with the smallest id. Rows with a null id are in no component and stay. If an id occurs
    more than once, a row is known by its id and text: equal rows are copies, others are judged by their texts like any other documents."""
    key = fresh("_key", docs.columns)
    repeated = not docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").isEmpty()
    keyed = docs.withColumn(key, F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id", "text")) if repeated else F.col("doc_id"))
    with scratch.scope(spark) as own:
        rows = keyed.select(F.col(key).alias("doc_id"), "text")
        linked = ngram_join.linked(rows.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]) if repeated else rows, PERCENT, WORDS)
        linked = linked.where("doc_id IS NOT NULL").select(F.col("doc_id").alias(key), "component_id")
        if repeated:
            named = linked.join(keyed.select(key, "doc_id").distinct(), key)
            first = named.groupBy("component_id").agg(F.min(F.struct("doc_id", key)).alias("first"))
            go = linked.join(first, "component_id").where(F.col(key) != F.col(f"first.{key}")).select(key)
        else:
            go = linked.where(F.col("component_id") != F.col(key)).select(key)
        go = own.keep(scratch.written(go, "copies"))
    kept = keyed.join(scratch.small(go), key, "left_anti")
    if repeated:
        kept = kept.where(F.col(key).isNull()).union(kept.where(F.col(key).isNotNull()).dropDuplicates([key]))
    return kept.select(*docs.columns)


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words a twentieth or more lies in benchmark windows go. Null and empty texts have no words and stay."""
    key = fresh("_key", docs.columns)
    with scratch.scope(spark) as own:
        found = decontaminate.hits(docs, table(spark, sf_dir, "benchmark"))
        bad = found.where(decontaminate.contaminated()).select(F.col("key").alias(key)).distinct()
        bad = own.keep(scratch.written(bad, "contaminated"))
    return docs.withColumn(key, decontaminate.row_key()).join(scratch.small(bad), key, "left_anti").select(*docs.columns)


def personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row stays; spans of personal data in its text give way to the name of their kind. Null and empty texts stay as they are."""
    _small_batches(spark)
    return pii.masked(docs)


def packing_(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of every row (null texts are the end mark alone) in sequences; rows with equal or null ids are documents of their own."""
    _small_batches(spark)
    return packing.packed(packing.pieces(docs, tokens.word_bpe(), end_id=2))


STAGES = [("language", language), ("near_copies", near_copies), ("benchmarks", benchmarks), ("personal", personal), ("packing", packing_)]

#: Kernel regression has no SQL form; tests/llm holds the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = first = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        kept = scratch.written(stage(spark, docs, sf_dir), name)
        if docs is not first:
            scratch.drop(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)

"""Keywords of mixed text by a dictionary: runs of ASCII letters and digits are words; runs of Han characters are cut by a dictionary.

As the fine-grained mode of such segmenters does, every dictionary entry that stands in a run is a word, overlapping ones too, and
a character that no entry covers is one by itself. Each different phrase is cut once: its runs' substrings of the entries' lengths are joined with
the dictionary, so the dictionary may be of any size and the work of a phrase is its length times that of the longest entry.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_RUN = r"[a-z0-9]+|\p{IsHan}+"


def lengths_of(dictionary: DataFrame) -> list[int]:
    """The different lengths of the entries (word), rising."""
    found = dictionary.where("word IS NOT NULL AND word <> ''").select(F.length("word").alias("n")).distinct().orderBy("n").collect()  # as many as the longest has characters
    return [r.n for r in found]


def segmented(phrases: DataFrame, dictionary: DataFrame, phrase: str = "full_word") -> DataFrame:
    """phrases with a row per keyword in place of phrase: keyword, at (its place in the phrase, in characters). dictionary: word. Letters are folded to
    lower case. Null phrases and those without any word have no rows; a keyword that stands twice has two. Tables only."""
    named = [F.xxhash64(phrase).alias("_p1"), F.xxhash64(F.lit(1), phrase).alias("_p2")]
    different = phrases.where(F.col(phrase).isNotNull()).select(*named, F.lower(phrase).alias("_text")).dropDuplicates(["_p1", "_p2"])
    # Runs with their places: what stands before a run is as long as the text up to where it is cut off.
    runs = F.regexp_extract_all("_text", F.lit(_RUN), F.lit(0))
    gaps = F.split("_text", _RUN)
    each = different.select("_p1", "_p2", gaps.alias("_gaps"), F.posexplode(runs).alias("_n", "_run"), runs.alias("_runs"))
    before = F.aggregate(F.slice("_gaps", 1, F.col("_n") + 1), F.lit(0), lambda n, x: n + F.length(x)) + F.aggregate(F.slice("_runs", 1, F.col("_n")), F.lit(0), lambda n, x: n + F.length(x))
    each = each.select("_p1", "_p2", "_n", "_run", before.alias("_begin"), F.col("_run").rlike("^[a-z0-9]").alias("_plain"))
    plain = each.where("_plain").select("_p1", "_p2", F.col("_run").alias("keyword"), F.col("_begin").alias("at"))

    words = dictionary.where("word IS NOT NULL AND word <> ''").select(F.lower("word").alias("keyword")).distinct()
    sizes = F.array(*[F.lit(n) for n in lengths_of(dictionary)]).cast("array<int>")
    han = each.where("NOT _plain").withColumn("_i", F.explode(F.sequence(F.lit(0), F.length("_run") - 1)))
    fits = F.filter(sizes, lambda n: F.col("_i") + n <= F.length("_run"))
    parts = han.select("_p1", "_p2", "_begin", "_run", "_i", F.explode(fits).alias("_size"))
    parts = parts.select("_p1", "_p2", (F.col("_begin") + F.col("_i")).alias("at"), "_size", F.expr("substring(_run, _i + 1, _size)").alias("keyword"))
    found = parts.join(words, "keyword", "left_semi")
    # Characters behind the reach of all words that begin before them or with them. A phrase's own characters are one window.
    chars = han.select("_p1", "_p2", (F.col("_begin") + F.col("_i")).alias("at"), F.expr("substring(_run, _i + 1, 1)").alias("keyword"), F.lit(0).alias("_size"))
    w = Window.partitionBy("_p1", "_p2").orderBy("at", F.desc("_size")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = chars.unionByName(found).withColumn("_reach", F.max(F.col("at") + F.col("_size")).over(w))
    cut = both.where((F.col("_size") > 0) | (F.col("_reach") <= F.col("at"))).select("_p1", "_p2", "keyword", "at")
    every = plain.unionByName(cut)
    rest = [c for c in phrases.columns if c not in (phrase, "keyword", "at")]
    return phrases.select(*rest, *named).join(every, ["_p1", "_p2"]).select(*rest, "keyword", "at")

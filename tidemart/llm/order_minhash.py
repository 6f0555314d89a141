"""Document fingerprints: Order MinHash, with DataFrame functions only.

A text is cut into units: words of up to ``WORD`` characters other than white space, and longer runs at places that their
own characters mark, so that a character put in or left out changes the units around it and no others. ``k`` consecutive
units are a k-mer; a text of fewer units has one k-mer of them all. The o-th occurrence of a k-mer (o counts from 0) is an
element of its own, and a hash of (k-mer, o) puts all elements on a ring. From each of ``m`` points of the ring, evenly
spaced, the next ``l`` elements are chosen, put back in the order of the text, and their tuple is hashed. Two texts agree
at a point if they chose the same k-mers there in the same order, so the share of agreeing points falls with both changed
and moved text: it follows edit distance, not only overlap. In texts of few k-mers points share elements, but each still
has its tuple of l with their order.

All of this happens inside a row: no shuffle, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemart.llm.columns import let, positions
from tidemart.llm.tables import table

#: The longest run that is a unit as it stands.
WORD = 20
# In longer runs a unit ends after a character of this class (about every fourth of texts in Latin letters or base64, every one beyond
# them), or after 12 others.
_ENDS = "aeiouAEIOU02468+/=._\\-\\x{370}-\\x{10FFFF}"
_units = rf"(?<!\S)\S{{1,{WORD}}}(?!\S)|[^\s{_ENDS}]{{0,11}}[{_ENDS}]|[^\s{_ENDS}]{{1,12}}"


def units(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_units), F.lit(0))


def _kmers(words: Column, k: int) -> Column:
    """Hashes of the k-mers, in the order of the text."""
    return let(
        words,
        lambda w: F.transform(
            positions(F.when(F.size(w) > 0, F.greatest(F.size(w) - (k - 1), F.lit(1))).otherwise(0)),
            lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)]),
        ),
    )


def _numbered(kmers: Column) -> Column:
    """array(struct(kmer, at, occurrence)), sorted by k-mer. Equal k-mers are neighbours after sorting, so an
    occurrence number is the distance from where their run begins."""
    ordered = F.sort_array(F.transform(kmers, lambda h, at: F.struct(h.alias("kmer"), at.alias("at"))))

    def number(s: Column) -> Column:
        begins = F.filter(positions(F.size(s)), lambda j: (j == 0) | (F.get(s, j)["kmer"] != F.get(s, j - 1)["kmer"]))
        counted = let(
            begins,
            lambda b: F.flatten(
                F.transform(b, lambda at, q: F.sequence(F.lit(0), F.coalesce(F.get(b, q + 1), F.size(s)) - at - 1))
            ),
        )
        return F.zip_with(s, counted, lambda x, o: F.struct(x["kmer"].alias("kmer"), x["at"].alias("at"), o.alias("occurrence")))

    return let(ordered, number)


def sketch(text: Column, k: int = 3, l: int = 2, m: int = 64) -> Column:  # noqa: E741
    """array<bigint>: the hash of each point's tuple, in the points' order.

    m is a power of two. Null and empty texts, and texts of white space alone, have an empty sketch.
    """
    bits = m.bit_length() - 1
    if m != 1 << bits or not 0 < bits < 15:
        raise ValueError("m must be a power of two, 2 to 16384")
    part = lambda e: F.shiftrightunsigned(e, 64 - bits).cast("int")  # noqa: E731  of the ring's m parts
    elements = F.transform(
        _numbered(_kmers(units(text), k)),
        lambda x: F.struct(F.xxhash64(x["kmer"], x["occurrence"]).alias("e"), x["at"].alias("at"), x["kmer"].alias("kmer")),
    )
    # Sorted by hash, a part's elements are neighbours (a signed sort begins in the middle of the ring, at part m / 2). No point takes more
    # than the first l of a part.
    chosen = let(
        F.sort_array(elements),
        lambda s: F.filter(s, lambda x, j: (j < l) | (part(x["e"]) != part(F.get(s, j - l)["e"]))),
    )
    turn = lambda e: (part(e) + m // 2) % m  # noqa: E731  parts numbered from where the sort begins

    def tuples(s: Column) -> Column:
        # The point of each part takes what comes first at or after it; past the last element, the first of all.
        firsts = F.filter(positions(F.size(s)), lambda i: (i == 0) | (part(F.get(s, i)["e"]) != part(F.get(s, i - 1)["e"])))
        before = lambda i: F.when(i == 0, -1).otherwise(turn(F.get(s, i - 1)["e"]))
        served = F.flatten(F.transform(firsts, lambda i: F.array_repeat(i, turn(F.get(s, i)["e"]) - before(i))))
        begins = F.concat(served, F.array_repeat(F.lit(0), m - F.size(served)))

        def chained(i: Column) -> Column:
            taken = F.transform(positions(F.least(F.size(s), F.lit(l))), lambda j: F.get(s, (i + j) % F.size(s)))
            in_order = F.sort_array(F.transform(taken, lambda x: F.struct(x["at"].alias("at"), x["kmer"].alias("kmer"))))
            return let(in_order, lambda t: F.xxhash64(*[F.get(t, j)["kmer"] for j in range(l)]))

        return let(begins, lambda b: F.transform(b, chained))

    none = F.array().cast("array<bigint>")
    return let(chosen, lambda s: F.when(F.size(s) > 0, tuples(s)).otherwise(none))


def likeness(a: Column, b: Column) -> Column:
    """Share of the points at which two sketches of the same shape agree: 0 to 1; 1 for two empty sketches, 0 for one."""
    agree = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same))
    most = F.greatest(F.size(a), F.size(b))
    return F.when(most == 0, F.lit(1.0)).otherwise(agree / most).cast("double")


def as_text(s: Column) -> Column:
    """16 hexadecimal digits a point."""
    return F.array_join(F.transform(s, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how: int) -> DataFrame:
    """One row per row of docs: id_col, n_chars, sketch (array<bigint>), fingerprint (string). Null texts count as
    empty; repeated rows stay; other columns are not looked at, so their names can't clash."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = docs.select(F.col(id_col), F.length(text).cast("long").alias("n_chars"), sketch(text, **how).alias("sketch"))
    return out.withColumn("fingerprint", as_text(F.col("sketch")))


def with_next(docs: DataFrame, carried: list[str], parts: int | None = None) -> DataFrame:
    """docs and, for each name x of carried, next_x: its value in the document that follows in descending doc_id
    (ties: descending text; after the last, the first). docs has doc_id and text.

    Ids are cut into ranges at approximate quantiles, each range is sorted by itself, and the one row that a range
    needs from another comes from a table of one row per range.
    """
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = docs.agg(F.percentile_approx("doc_id", [(i + 1) / parts for i in range(parts - 1)], 10_000)).head()[0] if parts > 1 else None
    cuts = sorted(set(cuts or []))
    part = F.size(F.filter(F.lit(cuts) if cuts else F.array().cast("array<long>"), lambda c: c < F.col("doc_id"))).cast("int")
    dealt = docs.withColumn("_part", F.coalesce(F.when(F.col("doc_id").isNull(), -1).otherwise(part), F.lit(-1)))
    # Parts are numbered upwards: the document after a part's last one is the first of the next lower part; after the lowest part comes the highest.
    tops = {r[0]: r[1] for r in dealt.groupBy("_part").agg(F.max("doc_id")).collect()}  # at most parts + 1 rows
    first = dealt.where(F.col("doc_id").isin([x for x in tops.values() if x is not None]) | F.col("doc_id").isNull())
    first = first.groupBy("_part").agg(F.max(F.struct("doc_id", "text", *[c for c in carried if c not in ("doc_id", "text")])).alias("_f"))
    order = sorted(tops)
    after = {p: order[i - 1] for i, p in enumerate(order)}
    follow = F.create_map(*[F.lit(x) for pair in ((b, a) for a, b in after.items()) for x in pair]) if after else F.create_map().cast("map<int,int>")
    heads = first.select(F.element_at(follow, F.col("_part")).alias("_part"), *[F.col("_f")[c].alias(f"_head_{c}") for c in carried])
    w = Window.partitionBy("_part").orderBy(F.col("doc_id").desc_nulls_last(), F.col("text").desc_nulls_last())
    led = dealt.select("*", *[F.lead(c).over(w).alias(f"_lead_{c}") for c in carried], F.lead(F.lit(1)).over(w).alias("_inner"))
    led = led.join(F.broadcast(heads), "_part", "left")  # heads: one row per range
    return led.select(
        *docs.columns, *[F.when(F.col("_inner").isNotNull(), F.col(f"_lead_{c}")).otherwise(F.col(f"_head_{c}")).alias(f"next_{c}") for c in carried]
    )


def op8_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text (the last third replaced by the start of the next document)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    pairs = with_next(docs.withColumn("sketch", sketch(F.col("text"))), ["text", "sketch"])
    n = F.length("text")
    cut = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.col("next_text"), F.lit(1), cut))
    rows = pairs.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "sketch", "next_sketch")
    rows = rows.withColumn("edited_sketch", sketch(F.col("edited")))
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("sketch")).alias("fingerprint"),
        as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )

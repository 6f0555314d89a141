"""N-gram Jaccard join: grouped prefix join.

A document is the set of its 3-word shingles. Two sets with a Jaccard similarity of t or more share one of their first
n - ceil(t n) + 1 shingles in any order that is the same for all. Rare shingles come first here: how often a shingle occurs
is counted, over all documents, in a table of counters addressed by the shingle's hash, which any two documents read alike. Then

1. equal sets become one class, and classes with the same prefix and the same size become one group; groups whose prefix (and a few
   shingles after it) meets too few others' to be similar to any are done;
2. groups that share a prefix shingle are candidates if size, position and the parities of their shingles' hashes (a lower bound on
   how many shingles only one of them has) allow the overlap that t asks for;
3. group pairs are expanded to classes, whose whole sets are compared.

What is asked for are the components of the links, so a pair whose members are known to be connected is not compared. For
each prefix shingle, a pivot takes all its groups (a row per group and shingle, not per pair), in a few rounds with other pivots;
where a shingle's groups are still in different components, those outside the largest of them then meet all. Nothing is left out:
every pair that could be a link is compared or already connected.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemart.llm import scratch
from tidemart.llm.arrow_text import WordHasher, blocks, mix, pairwise, utf8
from tidemart.llm.components import components
from tidemart.llm.tables import table

#: The similarity is PERCENT / 100 or more.
PERCENT, WORDS = 90, 3
#: Counters have 16 entries a document, rounded up to a power of two within 2**COUNTER_BITS and 2**MOST_BITS: of 4 bytes in the tasks that count and of
#: one byte (a level) elsewhere.
COUNTER_BITS, MOST_BITS = 22, 26
#: Levels of counts to a doubling (64 doublings fit into a byte).
STEPS = 4
#: Shingles whose counter has this many documents and four times the mean are taken to be met without being gathered.
CROWD = 1024
#: Rounds of pivots, at most (a round that links nothing is the last), and different pivots of a group's shingles from the second round on.
PIVOT_ROUNDS, PIVOTS = 3, 8
#: Bits of a set's parities.
BITS = 512
#: A SPARE-th of a set's shingles are listed beyond the prefix.
SPARE = 10
#: Groups of a shingle that one task of the last round compares with as many others.
CROSS = 1024
_CHUNK = 1 << 14


def shingles(texts: pa.Array, hasher: WordHasher, k: int = WORDS) -> Iterator[np.ndarray]:
    """For each text its distinct shingles as sorted uint64: windows of k words, or all the words if they are fewer."""
    data, offsets = utf8(texts)
    for i, j in blocks(offsets):
        h, _, _, row = hasher.words(data, offsets[i : j + 1])
        first = np.searchsorted(row, np.arange(j - i + 1))
        windows = pairwise(h, k)
        for r in range(j - i):
            a, b = first[r], first[r + 1]
            if b - a >= k:
                yield np.unique(windows[a : b - k + 1])
            elif b > a:
                yield mix(pairwise(h[a:b], b - a) + np.uint64(b - a))
            else:
                yield windows[:0]


def levels(docs: DataFrame, bits: int = COUNTER_BITS, k: int = WORDS) -> tuple[np.ndarray, int]:
    """(for each value of a hash's first bits bits, on a scale of STEPS levels to a doubling, how many documents of docs (text) have a shingle
    whose hash begins with it; the mean of the counts). Each task sends its own counts in chunks, which as many tasks add up as shuffles have."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, total = WordHasher(), np.zeros(1 << bits, np.uint32)
        for b in batches:
            found = [s >> np.uint64(64 - bits) for s in shingles(b.column(0), hasher, k)]
            if found:
                at, n = np.unique(np.concatenate(found), return_counts=True)
                total[at.astype(np.int64)] += n.astype(np.uint32)
        for c in range(0, len(total), _CHUNK):
            if total[c : c + _CHUNK].any():  # zlib leaves little of many small numbers
                yield chunk(c, total[c : c + _CHUNK].astype("<u4"), 0)

    def chunk(c: int, n: np.ndarray, total: int) -> pa.RecordBatch:
        cols = [pa.array([c], pa.int64()), pa.array([zlib.compress(n.tobytes(), 1)], pa.binary()), pa.array([total], pa.int64())]
        return pa.RecordBatch.from_arrays(cols, names=["chunk", "n", "total"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for c, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                sums[c] = sums.get(c, 0) + np.frombuffer(zlib.decompress(n), "<u4").astype(np.int64)
        for c, n in sums.items():
            yield chunk(c, level(n), int(n.sum()))

    schema = "chunk long, n binary, total long"
    parts = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, schema)
    reducers = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Written first: reading an iterator takes a job for each partition, one after the other, and a written table has few.
    added = scratch.written(parts.repartition(reducers, "chunk").mapInArrow(add, schema), "levels")
    out, total = np.zeros(1 << bits, np.uint8), 0
    for c, n, t in added.toLocalIterator():  # 2**bits bytes, 64 MB at most
        out[c : c + _CHUNK] = np.frombuffer(zlib.decompress(bytes(n)), np.uint8)
        total += t
    scratch.drop(added)
    return out, total >> bits


def level(count: np.ndarray) -> np.ndarray:
    return np.floor(STEPS * np.log2(count + 1.0)).astype(np.uint8)


def first_needed(n: int, percent: int) -> int:
    """Of the first so many shingles of a set of n, a similar set has one at least."""
    return n - (percent * n + 99) // 100 + 1


def spare(n: int, percent: int) -> int:
    """How many more shingles are listed than the prefix has, at most the others that a similar set shares; it grows with n."""
    return min(n // SPARE, (percent * n + 99) // 100 - 1)


def signatures(docs: DataFrame, rarity: np.ndarray, percent: int = PERCENT, k: int = WORDS) -> DataFrame:
    """doc_id, n (size of the set), set1, set2 (128 bits that name it), list (array<bigint>: its rarest shingles, rarest
    first: the prefix and some spare ones), list1, list2 (128 bits that name the list). A shingle's place in the order: its
    counter's level (its first byte), then the last 56 bits of its hash."""
    bits = len(rarity).bit_length() - 1
    shared = docs.sparkSession.sparkContext.broadcast(rarity)  # 2**MOST_BITS bytes at most

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, place = WordHasher(), shared.value
        low = np.uint64((1 << 56) - 1)
        for b in batches:
            sizes, names, lists = [], [], []
            for s in shingles(b.column(1), hasher, k):
                n = len(s)
                keys = (place[(s >> np.uint64(64 - bits)).astype(np.int64)].astype(np.uint64) << np.uint64(56)) | (s & low)
                keys.sort()
                keys = keys[: min(n, first_needed(n, percent) + spare(n, percent)) if n else 0]
                sizes.append(n)
                names += [hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in (s, keys)]
                lists.append(keys.view(np.int64))
            named = np.frombuffer(b"".join(names), "<i8").reshape(-1, 4)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(sizes, pa.int64()), *[pa.array(named[:, c].copy()) for c in range(4)], pa.array(lists, pa.list_(pa.int64()))],
                names=["doc_id", "n", "set1", "set2", "list1", "list2", "list"],
            )

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        sign, "doc_id long, n long, set1 long, set2 long, list1 long, list2 long, list array<bigint>"
    )


def whole_sets(docs: DataFrame, k: int = WORDS) -> DataFrame:
    """id, shingles (array<bigint>), parity (array<bigint>: of BITS counters, whether an odd number of shingles falls on each) of docs (id, text)."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                found = list(shingles(part.column(1), hasher, k))
                odd = [np.packbits(np.bincount((s % np.uint64(BITS)).astype(np.int64), minlength=BITS) & 1).view(np.int64) for s in found]
                lists = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([s.view(np.int64) for s in found], lists), pa.array(odd, lists)], names=["id", "shingles", "parity"])

    return docs.select("id", F.col("text").cast("string").alias("text")).mapInArrow(sets, "id long, shingles array<bigint>, parity array<bigint>")


def _may_overlap(percent: int) -> Column:
    """Whether groups of sizes n, m that meet at places i, j of their lists can still have the overlap for percent."""
    need = F.ceil((percent * (F.col("n") + F.col("m"))) / (100 + percent) - F.lit(1e-9))
    most = F.least("i", "j") + F.least(F.col("n") - F.col("i"), F.col("m") - F.col("j"))
    return (100 * F.least("n", "m") >= percent * F.greatest("n", "m")) & (most >= need)


def _near_enough(percent: int) -> Column:
    """Each shingle that only one set has turns one bit of parity, so sets differ in as many shingles as in bits (x, y), at least. Null: unknown."""
    apart = sum((F.bit_count(F.col(f"x{k}").bitwiseXOR(F.col(f"y{k}"))) for k in range(1, BITS // 64)), F.bit_count(F.col("x0").bitwiseXOR(F.col("y0"))))
    return F.coalesce((100 + percent) * apart <= (100 - percent) * (F.col("n") + F.col("m")), F.lit(True))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of pairs (a, b: classes, ca, cb: their components) whose sets are similar enough. Each side is joined by itself, so that few pairs fetch few sets."""
    left = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a")
    right = pairs.select("a", "b").join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b")
    both = F.size(F.array_intersect("x", "y"))
    return left.join(right, ["a", "b"]).where(100 * both >= percent * (F.size("x") + F.size("y") - both)).drop("x", "y")


def linked(docs: DataFrame, percent: int = PERCENT, k: int = WORDS) -> DataFrame:
    """docs (doc_id: bigint, text): doc_id, n_shingles, class_id (smallest id with the same set), component_id (smallest
    id reachable by links).

    Null, empty and white-space texts have the empty set: n_shingles 0, linked with nothing. Texts of fewer than k words have
    one shingle, all their words. Each row is a document of its own, also where ids repeat: rows with one id and different texts may be
    in different components, and each has the smallest id of its own. Rows with a null id are returned with null class and component.
    Other columns are ignored. An empty table gives no rows.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    with scratch.small_batches(spark), scratch.scope(spark) as own:  # all work on texts is done in here
        names = None
        if not docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").isEmpty():
            # Ids that repeat can't name rows: numbers do, once they are written down.
            row = F.when(F.col("doc_id").isNotNull(), F.monotonically_increasing_id())
            numbered = scratch.written(docs.withColumn("row", row), "numbered")
            docs, names = numbered.select(F.col("row").alias("doc_id"), "text"), numbered.where("row IS NOT NULL").select("row", F.col("doc_id").alias("own"))
        signed, classes, label = map(own.keep, _linked(docs, percent, k))
        of_class = classes.join(label.select("c", "component"), F.col("class_id") == F.col("c"), "left").select(*_NAME, "class_id", F.coalesce("component", "class_id").alias("component_id"))
        if names is not None:
            signed = own.keep(scratch.written(signed.join(names, F.col("doc_id") == F.col("row"), "left").select("own", *_NAME), "named"))
            least = signed.where("own IS NOT NULL").groupBy(*_NAME).agg(F.min("own").alias("least"))
            of_class = scratch.written(of_class.join(least, _NAME), "named_classes")
            first = of_class.groupBy("component_id").agg(F.min("least").alias("first"))
            of_class = of_class.join(first, "component_id").select(*_NAME, F.col("least").alias("class_id"), F.col("first").alias("component_id"))
            of_class = own.keep(scratch.written(of_class, "named_classes"))
            signed = signed.withColumnRenamed("own", "doc_id")
    out = signed.join(of_class, [signed[c] == of_class[c] for c in _NAME], "left")
    own_id = lambda c: F.when(F.col("doc_id").isNotNull(), F.coalesce(c, F.col("doc_id")))
    return out.select(
        "doc_id", signed["n"].alias("n_shingles"), own_id(F.col("class_id")).alias("class_id"), own_id(F.col("component_id")).alias("component_id")
    )


#: What names a set.
_NAME = ["n", "set1", "set2"]


def _linked(docs: DataFrame, percent: int, k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Written tables: the signed rows of docs (doc_id unique where not null); their classes (n, set1, set2, class_id); c, component (and more) of the classes that may have links."""
    rarity, mean = levels(docs, min(MOST_BITS, max(COUNTER_BITS, (16 * docs.count()).bit_length())), k)
    crowd = int(level(np.array([max(CROWD, 4 * mean)]))[0])
    signed = scratch.written(signatures(docs, rarity, percent, k), "signatures")
    usable = signed.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
    shape = ["n", "list1", "list2"]
    classes = usable.groupBy(*_NAME).agg(F.min("doc_id").alias("class_id"), F.min("list1").alias("list1"), F.min("list2").alias("list2"))
    classes = scratch.written(classes, "classes")
    groups = classes.groupBy(*shape).agg(F.min("class_id").alias("g"), F.count(F.lit(1)).alias("classes"))
    members = classes.join(groups, shape).select("g", F.col("class_id").alias("c"), "n", "classes", F.xxhash64(*shape).alias("about"))
    members = scratch.written(members, "members")

    # Which listed shingles more than one group lists: rows of a group's copies count as one. Shingles of full counters are taken to be
    # met, so no task gathers them: that may keep a group too many below, never one too few.
    full = F.shiftrightunsigned("token", 56) >= crowd
    tokens = usable.select(F.xxhash64(*shape).alias("about"), F.explode("list").alias("token"))
    by_token = Window.partitionBy("token")
    several = tokens.where(~full).select("about", (F.min("about").over(by_token) != F.max("about").over(by_token)).alias("met")).where("met")
    met = several.select("about").union(tokens.where(full).select("about")).groupBy("about").count()

    # Similar sets share more of their lists than one shingle: all spare ones count. A group that meets others in fewer listed shingles
    # is similar to none; what passes is a small part of the corpus, unless that is full of near copies.
    least = F.ceil(F.lit(percent) * F.col("n") / 100).cast("long")  # a similar set's least size
    enough = 1 + F.least(F.floor(least / SPARE), F.ceil(F.lit(percent) * least / 100) - 1)
    prefix = F.col("n") - F.ceil(F.lit(percent) * F.col("n") / 100) + 1
    active = members.where("g = c").join(met, "about").where(F.col("count") >= enough)
    active = scratch.written(active.select("g", "n", enough.alias("enough"), prefix.alias("prefix")), "active")
    worked = active.select("g").union(members.where("classes > 1").select("g")).distinct()
    members = members.join(worked, "g").select("g", "c", "n", "classes", F.col("c").alias("component"))  # component: as far as it is known
    members = scratch.written(members, "near")
    leaders = scratch.small(active.select(F.col("g").alias("doc_id"), "enough", "prefix"))  # a group's list is that of its first document
    lists = usable.select("doc_id", "n", "list").join(leaders, "doc_id")
    postings = lists.select(F.col("doc_id").alias("g"), "n", "enough", "prefix", F.posexplode("list").alias("i", "token"))
    postings = scratch.written(postings.select("g", "n", "i", "token", "enough", (F.col("i") < F.col("prefix")).alias("first")), "postings")
    firsts = scratch.small(scratch.written(members.select(F.col("c").alias("id")), "ids"))
    sets = whole_sets(docs.join(firsts, F.col("doc_id") == F.col("id")).select("id", "text"), k)
    sets = scratch.written(sets, "sets")

    bits = range(BITS // 64)
    alone = members.where("classes = 1").select("g", F.col("c").alias("id"))
    parity = scratch.written(alone.join(sets, "id").select("g", *[F.col("parity")[b].alias(f"x{b}") for b in bits]), "parity")
    theirs = parity.select(F.col("g").alias("h"), *[F.col(f"x{b}").alias(f"y{b}") for b in bits])

    tried, turn, last = None, 0, PIVOT_ROUNDS == 0
    while True:
        # A group's components and its class that the others meet in this turn, with that one's component.
        some = F.min_by(F.struct("c", "component"), F.xxhash64(F.lit(turn), "c"))
        state = members.groupBy("g").agg(F.min("component").alias("low"), F.max("component").alias("high"), some.alias("one"))
        state = scratch.written(state.select("g", "low", "high", F.col("one.c").alias("b"), F.col("one.component").alias("cb")), "state")
        labelled = postings.join(scratch.small(state.select("g", "low", "high")), "g")
        ends = [F.min("low").alias("l"), F.max("high").alias("h")]  # a shingle whose groups are all of one component is settled
        mixed = state.where("low <> high").select("g", F.col("g").alias("h"))
        settled = (F.col("low") == F.col("high")) & (F.col("low2") == F.col("high2")) & (F.col("low") == F.col("low2"))
        whole = members.select("g", F.col("c").alias("a"), F.col("component").alias("ca"))
        if not last:
            # First one pivot for all shingles that a group of it shares, later several, so that each group meets as many.
            order = F.xxhash64(F.lit(turn), "g", F.pmod("token", F.lit(PIVOTS if turn else 1)))
            pivot = F.min_by(F.struct(F.col("g").alias("h"), F.col("n").alias("m"), F.col("i").alias("j"), F.col("low").alias("low2"), F.col("high").alias("high2")), order)
            pivots = labelled.where("first").groupBy("token").agg(*ends, pivot.alias("p")).where("l <> h").select("token", "p.*")
            near = labelled.where("first").select("g", "n", "i", "token", "low", "high").join(pivots, "token")
            near = near.where((F.col("g") != F.col("h")) & ~settled & _may_overlap(percent)).select("g", "h", "n", "m").distinct()
            near = near.join(parity, "g", "left").join(theirs, "h", "left").where(_near_enough(percent)).select("g", "h")
            # Every class of the one group is to meet one class of the other, and every class one of its own group.
            theirs_of = state.select(F.col("g").alias("h"), "b", "cb")
        else:
            # A shingle's largest component (null: groups that are in several are in none) needn't meet itself: the others' groups meet all.
            own = F.when(F.col("low") == F.col("high"), F.col("low"))
            parts = labelled.withColumn("own", own).groupBy("token", "own").agg(*ends, F.count(F.when(F.col("first"), 1)).alias("k"))
            inside = F.when(F.col("own").isNotNull(), F.col("k"))
            of_token = parts.groupBy("token").agg(F.min("l").alias("l"), F.max("h").alias("h"), F.max_by("own", inside).alias("main"), F.sum("k").alias("k"), F.coalesce(F.max(inside), F.lit(0)).alias("most"))
            blocks = [F.ceil(c / CROSS).cast("int").alias(name) for c, name in ((F.col("k") - F.col("most"), "rows"), (F.col("k"), "cols"))]
            unsettled = of_token.where("l <> h").select("token", "main", *blocks)
            spread = scratch.written(postings.join(unsettled, "token").select("g", "n", "i", "token", "enough", "first", "main", "rows", "cols"), "unsettled")
            # The filter by count again: a group with a link to be found meets other components in as many shingles.
            going = spread.groupBy("g").agg(F.count(F.lit(1)).alias("c"), F.max("enough").alias("e")).where("c >= e").select("g")
            going = scratch.written(going.join(state.select("g", "low", "high"), "g").join(parity, "g", "left"), "going")
            spread = spread.where("first AND rows > 0").select("g", "n", "i", "token", "main", "rows", "cols").join(scratch.small(going, 1 << 18), "g")
            spread = spread.withColumn("other", ~own.eqNullSafe(F.col("main")) | own.isNull())
            # Both sides are dealt to blocks, and each two blocks meet under a key of their own.
            block = lambda n: F.pmod(F.xxhash64("g"), F.col(n)).cast("int")
            every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
            one = spread.where("other").withColumn("p", block("rows")).withColumn("q", every("cols")).drop("main", "rows", "cols", "other")
            two = spread.withColumn("q", block("cols")).withColumn("p", every("rows"))
            two = two.select("token", "p", "q", F.col("g").alias("h"), F.col("n").alias("m"), F.col("i").alias("j"), F.col("low").alias("low2"), F.col("high").alias("high2"), "other", *[F.col(f"x{b}").alias(f"y{b}") for b in bits])
            once = ~F.col("other") | (F.col("g") < F.col("h"))
            near = one.join(two, ["token", "p", "q"]).where(once & ~settled & _may_overlap(percent) & _near_enough(percent))
            near = near.select(F.least("g", "h").alias("g"), F.greatest("g", "h").alias("h")).distinct()
            theirs_of = whole.select(F.col("g").alias("h"), F.col("a").alias("b"), F.col("ca").alias("cb"))
        # The components come with the classes, so pairs of one are gone before they are told apart.
        pairs = near.union(mixed).join(whole, "g").join(theirs_of, "h").where("ca <> cb")
        one, two = F.struct("a", "ca"), F.struct(F.col("b").alias("a"), F.col("cb").alias("ca"))
        pairs = pairs.select(F.least(one, two).alias("p"), F.greatest(one, two).alias("q")).distinct()
        pairs = pairs.select("p.a", F.col("q.a").alias("b"), "p.ca", F.col("q.ca").alias("cb"))
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = scratch.written(pairs, "pairs")
        tried = pairs.select("a", "b") if tried is None else tried.union(pairs.select("a", "b"))
        # The links join components as they were; what that connects is found on those alone.
        new = scratch.written(_verified(scratch.small(pairs, 1 << 21), sets, percent).select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct(), "verified")
        none = new.isEmpty()
        if not none:
            found = components(new).select("node", F.col("component").alias("joined"))
            members = members.join(found, F.col("component") == F.col("node"), "left").select("g", "c", "n", "classes", F.coalesce("joined", "component").alias("component"))
            members = scratch.written(members, "near")
        if last:
            break
        turn += 1
        last = none or turn == PIVOT_ROUNDS
    return signed, classes, members


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The components of documents with a similarity of 0.9 or more."""
    return linked(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "class_id")

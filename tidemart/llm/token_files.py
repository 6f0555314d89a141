"""Token-ID output: fixed-width bit packing in blocks.

A token table is a folder of Parquet files whose rows are blocks, in ascending order of (part, block):

    part, block      place in the order of the corpus; documents ascend by id within and across them
    first            ids in the part before this block
    bits             width of an id: the least that holds the vocabulary
    n_tokens         ids in the block
    doc_ids, lengths the documents of the block, in order, and their numbers of ids
    payload          the ids, ``bits`` bits each, lowest bit first, no gaps; whole documents only

The width is fixed, so the i-th id of a payload is at bit i * bits: numpy unpacks any range with a few array operations, and
a reader finds a document by its block's offsets without touching others. Since the container is Parquet, any store that
Spark writes to will do, and tasks that are run again replace their files.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemart.llm import scratch, tokens
from tidemart.llm.tables import table

#: A block is closed when it holds so many ids; a longer document has a block of its own.
BLOCK_TOKENS = 1 << 16
BLOCK_SCHEMA = "part int, block int, first long, bits int, n_tokens long, doc_ids array<bigint>, lengths array<int>, payload binary"


def width(vocabulary: int) -> int:
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """ids (each below 2**bits, bits at most 32) as a string of bits, lowest first, padded to whole bytes."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    parts = []
    for i in range(0, len(ids), 1 << 16):  # a multiple of 8 ids fills whole bytes
        low = ids[i : i + (1 << 16)].astype("<u4").view(np.uint8).reshape(-1, 4)
        parts.append(np.packbits(np.unpackbits(low, axis=1, bitorder="little")[:, :bits].reshape(-1), bitorder="little").tobytes())
    return b"".join(parts)


def unpack(payload: bytes, bits: int, start: int, n: int) -> np.ndarray:
    """ids start to start + n as uint32."""
    if bits in (8, 16, 32):
        return np.frombuffer(payload, f"<u{bits // 8}", n, start * bits // 8).astype(np.uint32)
    at = (start + np.arange(n, dtype=np.int64)) * bits
    data = np.frombuffer(payload + b"\0" * 8, np.uint8)
    byte, value = at >> 3, np.zeros(n, np.uint64)
    for k in range((bits + 14) // 8):
        value |= data[byte + k].astype(np.uint64) << np.uint64(8 * k)
    return ((value >> (at & 7).astype(np.uint64)) & np.uint64((1 << bits) - 1)).astype(np.uint32)


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int, by_word: bool = True, parts: int | None = None) -> None:
    """Encodes docs (doc_id, text; others ignored) and writes a token table to path.

    Null texts are empty: just end_id. Null ids come first. Rows with equal ids are documents of their own, ordered by text.
    An empty table writes an empty token table.
    """
    n = parts or max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokens.encoder(tokenizer, by_word)
        part, bits = TaskContext.get().partitionId(), width(max(enc.vocabulary, end_id + 1))
        end = np.array([end_id], "<u4")
        block = first = 0
        ids, lengths, held, total = [], [], [], 0

        def closed() -> pa.RecordBatch:
            payload = pack(np.concatenate(held), bits)
            row = [[part], [block], [first], [bits], [total], [ids], [lengths], [payload]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, kinds, strict=True)], names=names)

        names = [x.split()[0] for x in BLOCK_SCHEMA.split(", ")]
        for batch in batches:
            for doc_id, found in zip(batch.column(0).to_pylist(), enc.encode_all(batch.column(1)), strict=True):
                one = np.concatenate([found, end])
                if total and total + len(one) > BLOCK_TOKENS:
                    yield closed()
                    block, first = block + 1, first + total
                    ids, lengths, held, total = [], [], [], 0
                ids.append(doc_id)
                lengths.append(len(one))
                held.append(one)
                total += len(one)
        if ids:
            yield closed()

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = ordered.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(encode, BLOCK_SCHEMA).write.parquet(path)


def blocks(spark: SparkSession, path: str) -> DataFrame:
    """The blocks of a token table with start: ids of the corpus before the block."""
    stored = spark.read.schema(BLOCK_SCHEMA).parquet(path)
    totals = stored.groupBy("part").agg(F.sum("n_tokens").alias("total"))  # a row for each part: as many as write tasks
    before = F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = totals.select("part", F.coalesce(before, F.lit(0)).alias("part_start"))
    return stored.join(F.broadcast(starts), "part").withColumn("start", F.col("part_start") + F.col("first")).drop("part_start")


def token_range(blocks_: DataFrame, start: int, stop: int) -> DataFrame:
    """start, ids (array<int>): the ids start to stop of the whole corpus, in a row for each block they touch."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, n, bits, payload in zip(*[b.column(i).to_pylist() for i in range(4)], strict=True):
                lo, hi = max(start, at), min(stop, at + n)
                got = unpack(payload, bits, lo - at, hi - lo).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([lo], pa.int64()), pa.array([got], pa.list_(pa.int32()))], names=["start", "ids"])

    near = blocks_.where((F.col("start") < stop) & (F.col("start") + F.col("n_tokens") > start))
    return near.select("start", "n_tokens", "bits", "payload").mapInArrow(cut, "start long, ids array<int>")


def documents(blocks_: DataFrame) -> DataFrame:
    """One row per document of a token table: doc_id, start, n_tokens, ids_crc32."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, bits, doc_ids, lengths, payload in zip(*[b.column(i).to_pylist() for i in range(5)], strict=True):
                sizes = np.array(lengths, np.int64)
                ends = np.cumsum(sizes)
                ids = unpack(payload, bits, 0, int(ends[-1])).astype("<u4")
                crc = [zlib.crc32(ids[e - n : e].tobytes()) for e, n in zip(ends, sizes, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids, pa.int64()), pa.array(at + ends - sizes), pa.array(sizes), pa.array(crc, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return blocks_.select("start", "bits", "doc_ids", "lengths", "payload").mapInArrow(
        read, "doc_id long, start long, n_tokens long, ids_crc32 long"
    )


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes all documents into a token table and reads it back."""
    path = scratch.new_folder(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), path, tokens.word_bpe(), end_id=2)
    return documents(blocks(spark, path))

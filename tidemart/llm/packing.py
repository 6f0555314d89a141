"""Packing documents into training sequences: first-fit decreasing in randomised groups.

A document's ids are cut at multiples of the sequence length; what is left over is one piece. Pieces are dealt at random
into groups of about ``group_pieces``, and each group is packed by itself: pieces in falling order of length, each into
the first open sequence with room, which a tournament tree over the sequences' free room finds in logarithmic time. A group
leaves at most a few sequences short, so large groups waste little and small ones bound a task's memory.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemart.llm import scratch, tokens
from tidemart.llm.arrow_text import sliced
from tidemart.llm.tables import table

SEQUENCE_TOKENS = 4096
GROUP_PIECES = 20_000


class Tournament:
    """Free room of bins 0 to n - 1, all empty at first; first(size) finds the lowest bin with room in log n steps."""

    def __init__(self, n: int, capacity: int) -> None:
        self.leaves = 1 << max(0, (n - 1).bit_length())
        self.best = [capacity] * (2 * self.leaves)

    def put(self, size: int) -> tuple[int, int]:
        """Puts size into the first bin with room: (bin, room that it had)."""
        best, at = self.best, 1
        if best[1] < size:
            raise ValueError("no bin has room")
        while at < self.leaves:
            at *= 2
            if best[at] < size:
                at += 1
        had = best[at]
        bin_ = at - self.leaves
        best[at] = had - size
        while at > 1:
            at >>= 1
            best[at] = max(best[2 * at], best[2 * at + 1])
        return bin_, had


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset in it) of each length (1 to capacity). Ties in length keep their order."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    tree = Tournament(len(lengths), capacity)
    for i in np.argsort(-lengths, kind="stable").tolist():
        bins[i], room = tree.put(int(lengths[i]))
        offsets[i] = capacity - room
    return bins, offsets


def pieces(docs: DataFrame, tokenizer: str, end_id: int, by_word: bool = True, length: int = SEQUENCE_TOKENS, with_ids: bool = False) -> DataFrame:
    """docs (doc_id, text) as pieces of at most length ids: doc_id, start, length, ids_crc32, doc_tokens and, if asked for, ids.

    Null texts are empty (one piece: end_id). Equal or null doc_ids are documents of their own; other columns are ignored.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = tokens.encoder(tokenizer, by_word), np.array([end_id], "<u4")
        for batch in sliced(batches, 4000):
            rows: list[list] = [[], [], [], [], [], []]
            for doc_id, found in zip(batch.column(0).to_pylist(), enc.encode_all(batch.column(1)), strict=True):
                ids = np.concatenate([found, end]).astype("<u4").tobytes()
                n = len(ids) // 4
                for at in range(0, n, length):
                    part = ids[4 * at : 4 * (at + length)]
                    for column, x in zip(rows, (doc_id, at, len(part) // 4, zlib.crc32(part), n, part), strict=True):
                        column.append(x)
            out = [pa.array(x, pa.int64()) for x in rows[:5]]
            if with_ids:
                out.append(pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in rows[5]], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(out, names=names)

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids
    names = [x.split()[0] for x in schema.split(", ")]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, schema)


def packed(cut: DataFrame, length: int = SEQUENCE_TOKENS, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """pieces() with sequence_id and offset. Sequence ids are unique, not dense: the group's number * 2**32 + the bin's."""
    # Written once: a task that runs again must deal its pieces into the same groups.
    cut = scratch.written(cut.withColumn("_piece", F.monotonically_increasing_id()), "pieces")
    groups = max(1, -(-cut.count() // group_pieces))

    def place(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_piece", ignore_index=True)
        bins, offsets = first_fit_decreasing(pdf["length"].to_numpy(), length)
        return pdf.assign(sequence_id=key[0] * (1 << 32) + bins, offset=offsets).drop(columns=["_piece", "_group"])

    dealt = cut.withColumn("_group", F.pmod(F.xxhash64("_piece"), F.lit(groups)))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema if f.name != "_piece")
    return dealt.groupBy("_group").applyInPandas(place, f"{schema}, sequence_id long, offset long")


def sequences(placed: DataFrame) -> DataFrame:
    """sequence_id, ids, doc_ids, offsets: the sequences of packed(pieces(..., with_ids=True)), each at most its length."""
    whole = placed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("p"))
    return whole.select("sequence_id", F.flatten("p.ids").alias("ids"), F.col("p.doc_id").alias("doc_ids"), F.col("p.offset").alias("offsets"))


def op4_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 4096 ids."""
    return packed(pieces(table(spark, sf_dir, "documents"), tokens.word_bpe(), end_id=2))

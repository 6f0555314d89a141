"""Sequence patterns over keyed rows in order of time: batch form. streaming/processors.py has the stream's.

A pattern is steps that rows must meet one right after another; each row can begin a match of its own. A match that is not whole when
``within_ms`` have passed since its first row has timed out, which is a result too; one that meets a row that doesn't fit is none.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MATCHED, TIMED_OUT = "matched", "timed_out"


@dataclass(frozen=True)
class Pattern:
    """steps: (name of a boolean column, how many rows in a row meet it). within_ms: a match's last row comes less than this after its first; None:
    at any time, and nothing times out."""

    steps: tuple[tuple[str, int], ...]
    within_ms: int | None = None

    @property
    def conditions(self) -> list[str]:
        """The column that each row of a match has to meet."""
        return [name for name, times in self.steps for _ in range(times)]

    def outcome(self, rows: list[tuple[int, dict[str, bool]]], begin: int, now: int | None = None) -> tuple[str | None, int] | None:
        """(result, rows met) of the match that begins at rows[begin], rows being (ts, conditions) in order; no result if it fails. None: not known yet.
        Time has come to now; without it, to its end."""
        first, wanted = rows[begin][0], self.conditions
        for k, name in enumerate(wanted):
            after = rows[begin + k] if begin + k < len(rows) else None
            over = self.within_ms is not None and (now is None or now >= first + self.within_ms)
            if after is None:
                return (TIMED_OUT, k) if over else None if now is not None else (None, k)
            if self.within_ms is not None and after[0] - first >= self.within_ms:
                return TIMED_OUT, k
            if not after[1][name]:
                return None, k
        return MATCHED, len(wanted)


def matched(rows: DataFrame, pattern: Pattern, key: str, ts: str, *tiebreak: str) -> DataFrame:
    """rows (key, ts in milliseconds, the pattern's boolean columns; nulls are false), of which those that begin a match or time out stay, with
    _outcome, _met (rows met) and _until (ts of the last row met). Rows without key or ts are dropped. One shuffle and sort, however long the pattern."""
    w = Window.partitionBy(key).orderBy(ts, *tiebreak)
    wanted = pattern.conditions
    meets = [F.coalesce(F.col(c), F.lit(False)) for c in wanted]
    times = [F.col(ts), *[F.lead(ts, k).over(w) for k in range(1, len(wanted))]]
    holds = [meets[0], *[F.lead(m, k).over(w) for k, m in enumerate(meets[1:], 1)]]
    row = rows.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).withColumns({f"_t{k}": t for k, t in enumerate(times)} | {f"_h{k}": h for k, h in enumerate(holds)})
    outcome, met = F.lit(MATCHED), F.lit(len(wanted))
    for k in reversed(range(len(wanted))):
        gone, missing = F.lit(False), F.col(f"_t{k}").isNull()
        if pattern.within_ms is not None:
            gone = missing | (F.col(f"_t{k}") - F.col("_t0") >= pattern.within_ms)
        fails = missing | ~F.col(f"_h{k}")
        outcome = F.when(gone, F.lit(TIMED_OUT)).when(fails, F.lit(None)).otherwise(outcome)
        met = F.when(gone | fails, F.lit(k)).otherwise(met)
    last = F.element_at(F.array(*[F.col(f"_t{k}") for k in range(len(wanted))]), F.col("_met"))
    names = [f"_{x}{k}" for x in "th" for k in range(len(wanted))]
    return row.where("_h0").withColumns({"_outcome": outcome, "_met": met}).where("_outcome IS NOT NULL").withColumn("_until", last).drop(*names)

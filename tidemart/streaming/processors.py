"""Stateful processors per key: flag repair, first visit of a day, sequence patterns.

Input rows have mid, ts (milliseconds), the columns that a processor names, and value, which comes back as it is. Each equals its batch form on
rows that are not late; rows of one micro-batch may come in any order and are put in order of (ts, value) first.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemart.functions.scalars import time_text
from tidemart.operators.patterns import Pattern

DAY_MS = 86_400_000


def _in_order(rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(rows), ignore_index=True).sort_values(["ts", "value"], kind="stable", ignore_index=True)


class RepairIsNew(StatefulProcessor):
    """Keeps is_new '1' on the first record of a mid that claims it; later ones get '0'."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.claimed = handle.getValueState("claimed", "yes boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        out = _in_order(rows)
        claims = out["is_new"] == "1"
        repaired = claims & (self.claimed.exists() | claims.cumsum().gt(1))
        if claims.any():
            self.claimed.update((True,))
        yield out.assign(mid=key[0], was=out["is_new"], is_new=out["is_new"].mask(repaired, "0"))[["mid", "ts", "was", "is_new", "value"]]

    def close(self) -> None:
        pass


class FirstVisit(StatefulProcessor):
    """Emits an entry page whose day is not the last one seen; with forget, the day is forgotten 24 hours after it was set."""

    def __init__(self, forget: bool = True) -> None:
        self.forget = forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.day = handle.getValueState("day", "day string", **({"ttlDurationMs": DAY_MS} if self.forget else {}))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        out = _in_order(rows)
        out = out[out["entry"]]
        last = self.day.get()[0] if self.day.exists() else None
        keep = out["day"] != out["day"].shift(fill_value=last)
        if keep.any():
            self.day.update((str(out["day"].iloc[-1]),))
        yield out[keep].assign(mid=key[0])[["mid", "ts", "value"]]

    def close(self) -> None:
        pass


class Matches(StatefulProcessor):
    """Emits rows that begin a match of a pattern, or time out, with outcome and met. Rows wait until the watermark has passed them, so each is judged by
    those that really follow it, whatever order they came in; a row goes when it is judged and no match before it is open."""

    def __init__(self, pattern: Pattern) -> None:
        self.pattern = pattern
        self.columns = list(dict.fromkeys(pattern.conditions))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "ts long, meets array<boolean>, value string, judged boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        watermark = timerValues.getCurrentWatermarkInMs()
        for ts, value, *meets in _in_order(rows)[["ts", "value", *self.columns]].itertuples(index=False):
            if ts > watermark or watermark <= 0:
                self.waiting.appendValue((int(ts), [bool(m) for m in meets], value, False))
                for at in {int(ts), int(ts) + (self.pattern.within_ms or 0)}:
                    self.handle.registerTimer(at)
        yield _found([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now, out = timerValues.getCurrentWatermarkInMs(), []
        held = sorted(self.waiting.get(), key=lambda p: (p[0], p[2]))
        past = [(ts, dict(zip(self.columns, meets, strict=True))) for ts, meets, _, _ in held if ts <= now]
        left, changed = [], False
        for i, (ts, meets, value, judged) in enumerate(held):
            result = None if ts > now else self.pattern.outcome(past, i, now)
            if result is not None and not judged:
                changed = True
                if result[0]:
                    out.append((key[0], ts, value, *result))
            if result is None or left:  # an open match may still need what follows its first row
                left.append((ts, meets, value, result is not None))
            else:
                changed = True
        if changed:
            if left:
                self.waiting.put(left)
            else:
                self.waiting.clear()
        yield _found(out)

    def close(self) -> None:
        pass


def _found(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["mid", "ts", "value", "outcome", "met"]).astype({"mid": "str", "ts": "int64", "value": "str", "outcome": "str", "met": "int32"})


class ClockSums(StatefulProcessor):
    """Sums of measures in tumbling windows of the clock: a row belongs to the window in which it is processed, and a window's sums come out when the
    clock has passed its end, whether more rows come or not."""

    def __init__(self, keys: list[str], measures: list[str], size_ms: int) -> None:
        self.keys, self.measures, self.size_ms = keys, measures, size_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sums = handle.getMapState("sums", "start long", "sums array<decimal(38,6)>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentProcessingTimeInMs()
        start = now - now % self.size_ms
        known = self.sums.containsKey((start,))
        total = list(self.sums.getValue((start,))[0]) if known else [Decimal(0)] * len(self.measures)
        for part in rows:
            for i, m in enumerate(self.measures):
                total[i] += sum((x for x in part[m] if x is not None), Decimal(0))
        self.sums.updateValue((start,), (total,))
        if not known:
            self.handle.registerTimer(start + self.size_ms)
        yield self._closed([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentProcessingTimeInMs()
        over = sorted((k[0], list(v[0])) for k, v in self.sums.iterator() if k[0] + self.size_ms <= now)
        for start, _ in over:
            self.sums.removeKey((start,))
        yield self._closed([(*key, start, start + self.size_ms, now, *total) for start, total in over])

    def _closed(self, rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=[*self.keys, "start", "end", "ts", *self.measures], dtype=object)
        return out.astype(dict.fromkeys(("start", "end", "ts"), "int64"))

    def close(self) -> None:
        pass


def clock_sums(rows: DataFrame, keys: list[str], measures: list[str], size_ms: int = 10_000) -> DataFrame:
    """rows (keys as text, numbers to be summed): stt, edt (texts), keys, ts (milliseconds at which the window was closed) and the sums, of the type that
    sums of measures have. For measures without an event time, or whose time doesn't matter; such a query never comes to an end by itself."""
    texts = [F.col(k).cast("string").alias(k) for k in keys]
    numbers = rows.select(*texts, *[F.col(m).cast("decimal(38,6)").alias(m) for m in measures])
    schema = ", ".join([f"{k} string" for k in keys] + ["start long", "end long", "ts long"] + [f"{m} decimal(38,6)" for m in measures])
    out = numbers.groupBy(*keys).transformWithStateInPandas(ClockSums(keys, measures, size_ms), schema, "append", "processingTime")
    bounds = [time_text(F.timestamp_millis(c)).alias(n) for c, n in (("start", "stt"), ("end", "edt"))]
    return out.select(*bounds, *keys, "ts", *[F.col(m).cast(rows.schema[m].dataType).alias(m) for m in measures])


def repaired_is_new(rows: DataFrame) -> DataFrame:
    """rows (mid, ts, is_new, value), with the flag as it was in was."""
    return rows.groupBy("mid").transformWithStateInPandas(RepairIsNew(), "mid string, ts long, was string, is_new string, value string", "append", "none")


def unique_visits(rows: DataFrame, forget: bool = True) -> DataFrame:
    """rows (mid, ts, entry, day, value). Forgetting goes by the clock, so such a query never comes to an end by itself; a run over what
    is there (Job.start(once=True)) needs forget=False."""
    return rows.groupBy("mid").transformWithStateInPandas(FirstVisit(forget), "mid string, ts long, value string", "append", "processingTime" if forget else "none")


def matches(rows: DataFrame, pattern: Pattern) -> DataFrame:
    """rows (mid, ts, the pattern's boolean columns, value, and et with a watermark): mid, ts, value of rows that begin a match or time out, outcome, met."""
    return rows.groupBy("mid").transformWithStateInPandas(Matches(pattern), "mid string, ts long, value string, outcome string, met int", "append", "eventTime")


def user_jumps(rows: DataFrame, within_ms: int = 10_000) -> DataFrame:
    """rows (mid, ts, entry, value, and et with a watermark): an entry page and right after it another, or no page in time."""
    return matches(rows, Pattern((("entry", 2),), within_ms)).select("mid", "ts", "value")

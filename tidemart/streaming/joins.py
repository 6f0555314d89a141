"""Joins of two streams by state: changes with routing rows that may come later, and facts with dimensions as they were at the facts' time.

Both bring their two inputs together as one, keyed by what they join on and a salt: rows of the large side are dealt to ``salts`` keys by a hash,
rows of the small side go to all of them, so that one busy table or one much used dimension row is several states in several tasks. Rows travel
as JSON text. What the batch forms are: cdc.routed and cdc.unrouted; dims.as_of_join.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemart import schemas
from tidemart.functions import order
from tidemart.operators.cdc import whitelisted

ROUTED, EXPIRED = "routed", "expired"
_exact = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "ignoreNullFields": "false"}


def _dealt(rows: DataFrame, salts: int, by: Column) -> DataFrame:
    return rows.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int"))


def _everywhere(rows: DataFrame, salts: int) -> DataFrame:
    return rows.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))


# Routing ----------------------------------------------------------------------------------------------------------------


class LateRouting(StatefulProcessor):
    """Keys are (table, operation, salt). The newest routing row is kept; changes that have none wait, at most patience_ms."""

    def __init__(self, patience_ms: int) -> None:
        self.patience_ms = patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.config = handle.getValueState("config", "value string")
        self.waiting = handle.getListState("waiting", "value string, until long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        config = json.loads(self.config.get()[0]) if self.config.exists() else None
        changes, newer = [], False
        for part in rows:
            for is_config, value in part[["is_config", "value"]].itertuples(index=False):
                if not is_config:
                    changes.append(value)
                elif config is None or _place(json.loads(value)) > _place(config):
                    config, newer = json.loads(value), True
        if newer:
            self.config.update((json.dumps(config),))
        if config is None:
            until = timerValues.getCurrentProcessingTimeInMs() + self.patience_ms
            for value in changes:
                self.waiting.appendValue((value, until))
            if changes:
                self.handle.registerTimer(until)
            yield _routes([])
            return
        if newer and self.waiting.exists():
            changes = [v for v, _ in self.waiting.get()] + changes
            self.waiting.clear()
        found = tuple(config.get(c) for c in ("sink_type", "sink_table", "sink_columns", "sink_pk"))
        yield _routes([(ROUTED, *found, v) for v in changes])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentProcessingTimeInMs()
        held = list(self.waiting.get()) if self.waiting.exists() else []
        left = [(v, until) for v, until in held if until > now]
        if left:
            self.waiting.put(left)
        elif held:
            self.waiting.clear()
        yield _routes([(EXPIRED, None, None, None, None, v) for v, until in held if until <= now])

    def close(self) -> None:
        pass


def _place(row: dict) -> tuple:
    s = row["seq"]
    return s["major"], s["log"], s["pos"], s["row"]


def _routes(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["outcome", "sink_type", "sink_table", "sink_columns", "sink_pk", "value"], dtype=object)


def routed_late(changes: DataFrame, config_changes: DataFrame, patience_ms: int = 600_000, salts: int = 16) -> DataFrame:
    """changes: envelopes (without deletes); config_changes: envelopes of the routing table. The columns of changes and outcome, sink_type, sink_table,
    sink_pk, with after cut to the routing row's columns.

    A change before its routing row waits for it, patience_ms by the clock; then it comes out as 'expired', uncut, for audit. Changes keep
    their seq, so folds put those that waited where they belong. Such a query never comes to an end by itself: time goes on.
    """
    fields = [x.split()[0] for x in schemas.ROUTING.split(", ")]
    kind = T.StructType(changes.schema.fields)
    config = config_changes.select(*[F.try_element_at("after", F.lit(f)).alias(f) for f in fields], "seq").where("source_table IS NOT NULL AND operate_type IS NOT NULL")
    config = config.select(F.col("source_table").alias("t"), F.col("operate_type").alias("o"), F.lit(True).alias("is_config"), F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))
    rows = changes.select(F.col("tableName").alias("t"), F.coalesce("type", F.lit("")).alias("o"), F.lit(False).alias("is_config"), F.to_json(F.struct("*"), _exact).alias("value"))
    both = _dealt(rows, salts, F.col("value")).unionByName(_everywhere(config, salts))
    schema = "outcome string, sink_type string, sink_table string, sink_columns string, sink_pk string, value string"
    out = both.groupBy("t", "o", "salt").transformWithStateInPandas(LateRouting(patience_ms), schema, "append", "processingTime")
    out = out.select("outcome", "sink_type", "sink_table", F.coalesce("sink_pk", F.lit("id")).alias("sink_pk"), "sink_columns", F.from_json("value", kind, _exact).alias("r"))
    out = out.select("r.*", "outcome", "sink_type", "sink_table", "sink_pk", "sink_columns")
    return out.withColumn("after", F.when(F.col("outcome") == ROUTED, whitelisted(F.col("after"), F.col("sink_columns"))).otherwise(F.col("after"))).drop("sink_columns")


# Dimensions in state ------------------------------------------------------------------------------------------------------


class AsOf(StatefulProcessor):
    """Keys are (dimension's key, salt). Facts wait until the watermark has passed them, so that all versions of their time are known; of versions
    that the watermark has passed only the last is needed."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.versions = handle.getListState("versions", "ts long, seq string, value string")
        self.waiting = handle.getListState("waiting", "ts long, value string")

    def handleInitialState(self, key, initialState, timerValues) -> None:  # noqa: N802, N803
        for ts, seq, value in initialState[["ts", "seq", "value"]].itertuples(index=False):
            self.versions.appendValue((int(ts), seq, value))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        watermark, late = timerValues.getCurrentWatermarkInMs(), []
        for part in rows:
            for is_fact, ts, seq, value in part[["is_fact", "ts", "seq", "value"]].itertuples(index=False):
                if not is_fact:
                    self.versions.appendValue((int(ts), seq, value))
                elif ts > watermark or watermark <= 0:
                    self.waiting.appendValue((int(ts), value))
                    self.handle.registerTimer(int(ts))
                else:
                    late.append((int(ts), value))
        yield self._met(late)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs()
        held = list(self.waiting.get()) if self.waiting.exists() else []
        left = [x for x in held if x[0] > now]
        out = self._met([x for x in held if x[0] <= now])
        if len(left) < len(held):
            if left:
                self.waiting.put(left)
            else:
                self.waiting.clear()
            versions = self._sorted()
            past = [v for v in versions if v[0] <= now]
            if len(past) > 1:
                self.versions.put(past[-1:] + versions[len(past) :])
        yield out

    def _sorted(self) -> list[tuple]:
        return sorted((tuple(v) for v in self.versions.get()), key=lambda v: (v[0], v[1])) if self.versions.exists() else []

    def _met(self, facts: list[tuple]) -> pd.DataFrame:
        versions, out = self._sorted() if facts else [], []
        for ts, value in facts:
            known = [v for v in versions if v[0] <= ts]
            out.append((value, known[-1][2] if known else None))
        return pd.DataFrame(out, columns=["fact", "dim"], dtype=object)

    def close(self) -> None:
        pass


def sortable(seq: Column) -> Column:
    """A position as text that sorts as it does."""
    n = lambda c: F.lpad((seq[c] + 1).cast("string"), 20, "0")
    return F.concat(n("major"), seq["log"], F.lit("\0"), n("pos"), n("row"))


def as_of(facts: DataFrame, versions: DataFrame, fact_key: str, dim_key: str, columns: dict[str, str], snapshot: DataFrame | None = None, delay: str = "1 second", salts: int = 8) -> DataFrame:
    """facts (stream with et) with columns {new: dimension's} as they were at et: of the last version (stream: dim_key, et, seq and the columns) not after it.

    snapshot: the dimension when the query begins for the first time (dim_key, et, seq and the columns), the state's beginning; after a restart the state
    goes on from the checkpoint. Facts without a version have nulls. A null key meets none. Facts come out once the watermark has passed them.
    """
    new = list(columns)
    kind = T.StructType([T.StructField(n, versions.schema[columns[n]].dataType) for n in new])
    value = F.to_json(F.struct(*[F.col(c).alias(n) for n, c in columns.items()]), _exact)

    def changes(df: DataFrame) -> DataFrame:
        keyed = df.where(F.col(dim_key).isNotNull())
        return keyed.select(F.col(dim_key).cast("string").alias("k"), "et", F.unix_millis(F.col("et").cast("timestamp")).alias("ts"), sortable(F.col("seq")).alias("seq"), value.alias("value"))

    f = facts.select(
        F.coalesce(F.col(fact_key).cast("string"), F.lit("\0null")).alias("k"), "et", F.unix_millis(F.col("et").cast("timestamp")).alias("ts"), F.lit("").alias("seq"),
        F.to_json(F.struct("*"), _exact).alias("value"), F.lit(True).alias("is_fact"),
    )
    both = _dealt(f, salts, F.col("value")).unionByName(_everywhere(changes(versions).withColumn("is_fact", F.lit(False)), salts))
    start = None if snapshot is None else _everywhere(changes(snapshot).drop("et"), salts).groupBy("k", "salt")
    met = both.withWatermark("et", delay).groupBy("k", "salt").transformWithStateInPandas(AsOf(), "fact string, dim string", "append", "eventTime", initialState=start)
    plain = T.StructType([T.StructField(x.name, x.dataType) for x in facts.schema.fields])
    out = met.select(F.from_json("fact", plain, _exact).alias("f"), F.from_json("dim", kind, _exact).alias("d"))
    return out.select(*[F.col(f"f.{c}").alias(c) for c in facts.columns if c not in new], *[F.col(f"d.{n}").alias(n) for n in new])

"""Stateful joins and patterns of streams against plain versions."""

from __future__ import annotations

import json
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from tidemart import schemas
from tidemart.functions import order
from tidemart.operators import dims, patterns
from tidemart.sources import sinks, topics
from tidemart.streaming import jobs, joins, processors

BASE = 1_704_067_200_000


def put(place, name, rows, mtime=0):
    place.mkdir(exist_ok=True, parents=True)
    (place / f"{name}.txt").write_text("".join(json.dumps(r) + "\n" for r in rows))
    os.utime(place / f"{name}.txt", (1_700_000_000 + mtime, 1_700_000_000 + mtime))


def stream(spark, root, topic, schema):
    raw = topics.topic_source(spark, topic, kind="files", root=str(root), maxFilesPerTrigger="1")
    return raw.select(F.from_json("value", schema).alias("r"), "seq").select("r.*", "seq")


def once(rows, tmp_path, name="out"):
    assert jobs.Job(rows, sinks.table_sink(str(tmp_path / name)), str(tmp_path / f"{name}-checkpoint")).start(once=True).awaitTermination(120)
    return rows.sparkSession.read.parquet(str(tmp_path / name)).collect()


# Patterns ----------------------------------------------------------------------------------------------------------------


def plain_matches(rows, steps, within):
    """rows: {key: [(ts, n, letter)] in order}. {n: (outcome, met)}: a match is followed by hand from each row."""
    out = {}
    wanted = "".join(letter * times for letter, times in steps)
    for seq in rows.values():
        for i, (ts, n, letter) in enumerate(seq):
            if letter != wanted[0]:
                continue
            met = 1
            while met < len(wanted):
                follower = seq[i + met] if i + met < len(seq) else None
                if within is not None and (follower is None or follower[0] - ts >= within):
                    out[n] = ("timed_out", met)
                    break
                if follower is None or follower[2] != wanted[met]:
                    break
                met += 1
            else:
                out[n] = ("matched", met)
    return out


def letters(seed, n=160, keys=3):
    rng, clock, rows = random.Random(seed), {}, []
    for i in range(n):
        k = f"k{rng.randrange(keys)}"
        clock[k] = clock.get(k, BASE) + rng.choice([0, 500, 1000, 2999, 3000, 9000])
        rows.append((k, clock[k], i, rng.choice("aab")))
    return sorted(rows, key=lambda r: (r[1], r[2]))


CASES = [((("a", 2),), 3000), ((("a", 1), ("b", 1)), 5000), ((("a", 2), ("b", 2)), 6000), ((("b", 1), ("a", 3)), None), ((("a", 1),), 100)]


@pytest.mark.parametrize(("steps", "within"), CASES)
def test_patterns_in_batches(spark, steps, within):
    for seed in (1, 2):
        rows = letters(seed)
        by_key = {}
        for k, ts, n, letter in rows:
            by_key.setdefault(k, []).append((ts, n, letter))
        df = spark.createDataFrame([*rows, (None, BASE, 900, "a"), ("k0", None, 901, "a")], "mid string, ts long, n int, letter string")
        df = df.withColumns({"a": F.col("letter") == "a", "b": F.when(F.col("letter") == "b", F.lit(True))})
        got = patterns.matched(df, patterns.Pattern(steps, within), "mid", "ts", "n").collect()
        want = plain_matches(by_key, steps, within)
        assert {r.n: (r._outcome, r._met) for r in got} == want and want
        ts = {n: t for _, t, n, _ in rows}
        order_of = {k: [n for _, n, _ in v] for k, v in by_key.items()}
        for r in got:
            assert r._until == ts[order_of[r.mid][order_of[r.mid].index(r.n) + r._met - 1]]


@pytest.mark.parametrize(("steps", "within"), CASES[1:4])
def test_patterns_in_streams(spark, tmp_path, steps, within):
    rows = letters(7)
    by_key = {}
    for k, ts, n, letter in rows:
        by_key.setdefault(k, []).append((ts, n, letter))
    for i in range(5):
        part = rows[i * 32 : (i + 1) * 32]
        random.Random(i).shuffle(part)
        put(tmp_path / "in", str(i), [{"mid": k, "ts": ts, "value": f"{n:04d}", "letter": x} for k, ts, n, x in part], i)
    for i in (5, 6):
        put(tmp_path / "in", str(i), [{"mid": "end", "ts": BASE + 10**9 * i, "value": "9999", "letter": "c"}], i)
    df = stream(spark, tmp_path, "in", "mid string, ts long, value string, letter string").withColumns({"a": F.col("letter") == "a", "b": F.col("letter") == "b", "et": F.timestamp_millis("ts")})
    out = processors.matches(df.drop("seq", "letter").withWatermark("et", "1 second"), patterns.Pattern(steps, within))
    got = {int(r.value): (r.outcome, r.met) for r in once(out, tmp_path)}
    assert got == plain_matches(by_key, steps, within) and got


# Routing with rows that come later ----------------------------------------------------------------------------------------


def change(table, kind, n, **after):
    return {"database": "shop", "tableName": table, "type": kind, "before": {}, "after": after, "seq": dict(major=0, log="", pos=n, row=0)}


def route(table, kind, columns, n, **more):
    return change("table_process", "insert", n, source_table=table, operate_type=kind, sink_type="hbase", sink_table=f"dim_{table}", sink_columns=columns, **more)


def test_changes_wait_for_their_routing_row(spark, tmp_path):
    put(tmp_path / "changes", "0", [change("users", "insert", n, id=str(n), name=f"n{n}", secret="s") for n in range(20)] + [change("never", "insert", 1, id="1"), change("known", "update", 1, id="1", a="x", b="y")])
    put(tmp_path / "config", "0", [route("known", "update", "id,b", 5), route("known", "update", "id,a", 1)])
    read = lambda t: topics.change_source(topics.topic_source(spark, t, kind="files", root=str(tmp_path)))
    rows = joins.routed_late(read("changes"), read("config"), patience_ms=12_000, salts=3)
    query = jobs.Job(rows, sinks.table_sink(str(tmp_path / "out")), str(tmp_path / "checkpoint")).start(every="1 seconds")

    def until(n):
        for _ in range(90):
            time.sleep(1)
            try:
                got = spark.read.parquet(str(tmp_path / "out")).collect()
            except Exception:  # noqa: BLE001 nothing is written yet
                got = []
            if len(got) >= n:
                return got
        raise AssertionError(query.lastProgress)

    try:
        assert [(r.tableName, r.outcome, r.sink_table, r.sink_pk, r.after) for r in until(1)] == [("known", "routed", "dim_known", "id", {"id": "1", "b": "y"})]
        put(tmp_path / "config", "1", [route("users", "insert", "id,name", 6, sink_pk="id")])
        waited = [r for r in until(21) if r.tableName == "users"]
        assert sorted((int(r.after["id"]), r.seq.pos) for r in waited) == [(n, n) for n in range(20)]
        assert all(r.outcome == "routed" and set(r.after) == {"id", "name"} for r in waited)
        expired = [r for r in until(22) if r.outcome == "expired"]
        assert [(r.tableName, r.sink_table, r.after) for r in expired] == [("never", None, {"id": "1"})]
        put(tmp_path / "changes", "1", [change("users", "insert", 99, id="99", name="late")])
        assert [r.after["name"] for r in until(23) if r.after["id"] == "99"] == ["late"]  # the routing row is kept
    finally:
        query.stop()


# Dimensions in state --------------------------------------------------------------------------------------------------------


def plain_as_of(facts, versions):
    out = {}
    for f in facts:
        known = [v for v in versions if v["k"] == f["k"] and v["ts"] <= f["ts"] and f["k"] is not None]
        out[f["n"]] = max(known, key=lambda v: (v["ts"], v["pos"]))["name"] if known else None
    return out


def history(seed):
    rng = random.Random(seed)
    versions = [{"k": str(rng.randrange(4)), "ts": BASE + rng.randrange(60) * 1000, "pos": i, "name": f"v{i}"} for i in range(40)]
    facts = [{"k": rng.choice(["0", "0", "1", "2", "3", "9", None]), "ts": BASE + rng.randrange(60) * 1000, "n": i, "amount": f"{i}.25"} for i in range(80)]
    return sorted(facts, key=lambda r: r["ts"]), sorted(versions, key=lambda r: r["ts"])


FACT, VERSION = "k string, ts long, n int, amount decimal(16,2)", "k string, ts long, pos long, name string"


def timed(df):
    return df.withColumn("et", F.timestamp_millis("ts"))


def test_facts_meet_the_value_of_their_time_in_batches(spark):
    facts, versions = history(3)
    f = timed(spark.createDataFrame([(r["k"], r["ts"], r["n"], r["name"] if "name" in r else "old") for r in facts], "k string, ts long, n int, name string"))
    v = timed(spark.createDataFrame([(r["k"], r["ts"], r["pos"], r["name"]) for r in versions], VERSION)).withColumnRenamed("pos", "seq")
    got = dims.as_of_join(f, v, "k", "k", {"name": "name", "pos": "seq"}).collect()
    assert {r.n: r.name for r in got} == plain_as_of(facts, versions) and len(got) == len(facts)


def test_facts_meet_the_value_of_their_time_in_streams(spark, tmp_path):
    facts, versions = history(4)
    old, new = versions[:15], versions[15:]  # the first are the snapshot
    for i in range(4):
        mixed = lambda rows, i=i: [r for r in rows if i * 15_000 <= r["ts"] - BASE < (i + 1) * 15_000]
        for topic, rows in (("facts", mixed(facts)), ("versions", mixed(new))):
            random.Random(i).shuffle(rows)
            put(tmp_path / topic, str(i), rows, i)
    v = timed(stream(spark, tmp_path, "versions", VERSION)).withColumn("seq", order.numbered(F.col("pos")))
    snapshot = timed(spark.createDataFrame([(r["k"], r["ts"], r["pos"], r["name"]) for r in old], VERSION)).withColumn("seq", order.numbered(F.col("pos")))
    f = lambda: timed(stream(spark, tmp_path, "facts", FACT)).drop("seq")
    out = joins.as_of(f(), v, "k", "k", {"name": "name"}, snapshot, delay="30 seconds", salts=3)
    once(out, tmp_path)
    # The rest, after a restart: the last rows move the watermark past all; the state is that of the checkpoint.
    put(tmp_path / "facts", "8", [{"k": "end", "ts": BASE + 10**9, "n": -1}, {"k": "1", "ts": BASE + 59_500, "n": 1000, "amount": "7.50"}], 8)
    put(tmp_path / "facts", "9", [{"k": "end", "ts": BASE + 2 * 10**9, "n": -2}], 9)
    put(tmp_path / "versions", "8", [{"k": "end", "ts": BASE + 10**9, "pos": 0, "name": "e"}], 8)
    put(tmp_path / "versions", "9", [{"k": "end", "ts": BASE + 2 * 10**9, "pos": 0, "name": "e"}], 9)
    got = [r for r in once(joins.as_of(f(), v, "k", "k", {"name": "name"}, snapshot, delay="30 seconds", salts=3), tmp_path) if r.n >= 0]
    want = plain_as_of([*facts, {"k": "1", "ts": BASE + 59_500, "n": 1000}], versions)
    assert {r.n: r.name for r in got} == want and len(got) == len(want)
    assert all(str(r.amount) == ("7.50" if r.n == 1000 else f"{r.n}.25") for r in got)


def test_an_update_between_two_facts_is_seen_by_the_second(spark, tmp_path):
    put(tmp_path / "facts", "0", [{"k": "1", "ts": BASE + 1000, "n": 1}, {"k": "1", "ts": BASE + 3000, "n": 2}, {"k": None, "ts": BASE, "n": 3}])
    put(tmp_path / "facts", "1", [{"k": "x", "ts": BASE + 10**8, "n": -1}], 1)
    put(tmp_path / "versions", "0", [{"k": "1", "ts": BASE + 2000, "pos": 1, "name": "new"}])
    put(tmp_path / "versions", "1", [{"k": "x", "ts": BASE + 10**8, "pos": 1, "name": "x"}], 1)
    snapshot = timed(spark.createDataFrame([("1", BASE, 0, "old")], VERSION)).withColumn("seq", order.numbered(F.col("pos")))
    v = timed(stream(spark, tmp_path, "versions", VERSION)).withColumn("seq", order.numbered(F.col("pos")))
    out = joins.as_of(timed(stream(spark, tmp_path, "facts", FACT)), v, "k", "k", {"name": "name"}, snapshot)
    assert {r.n: r.name for r in once(out, tmp_path) if r.n > 0} == {1: "old", 2: "new", 3: None}


# Jobs -----------------------------------------------------------------------------------------------------------------------


def test_orders_are_enriched_with_dimensions_as_they_are_when_a_batch_begins(spark, tmp_path):
    from tidemart.operators import cdc

    at = lambda s: time.strftime("%Y-%m-%d %H:%M:%S", time.gmtime(BASE // 1000 + s))
    for i in range(3):
        put(tmp_path / "infos", str(i), [{"id": i, "province_id": 1, "user_id": 7, "create_time": at(100 * i)}], i)
        put(tmp_path / "lines", str(i), [{"id": 10 + i, "order_id": i, "sku_id": 5, "sku_num": 1, "create_time": at(100 * i)}], i)
    sink = sinks.dim_sink(str(tmp_path / "dims"))
    config = spark.createDataFrame([("province", k, "hbase", "dim_province", "id,name", None, None) for k in ("insert", "update")], schemas.ROUTING)

    def rename(name, pos):
        rows = spark.createDataFrame([("shop", "province", "update", {}, {"id": "1", "name": name}, (0, "", pos, 0))], f"{schemas.CHANGE}, seq {order.SEQ}")
        sink(cdc.dimensions(cdc.routed(rows, config)), pos)

    def dims_now(s):
        province = sinks.dim_snapshot(s, str(tmp_path / "dims"), "dim_province", "id,name").select(F.col("id").alias("ID"), F.col("name").alias("NAME"))
        none = lambda *cols: s.createDataFrame([], ", ".join(f"{c} string" for c in cols))
        return {
            "user": none("ID", "BIRTHDAY", "GENDER"), "province": province.withColumns({c: F.lit("x") for c in ("AREA_CODE", "ISO_CODE", "ISO_3166_2")}), "sku": none("ID", "SKU_NAME", "CATEGORY3_ID", "SPU_ID", "TM_ID"),
            "spu": none("ID", "SPU_NAME"), "trademark": none("ID", "TM_NAME"), "category3": none("ID", "NAME"),
        }

    rename("old", 0)
    seen = []

    def write(df, batch_id):
        sinks.table_sink(str(tmp_path / "out"))(df, batch_id)
        seen.append(batch_id)
        rename(f"after {batch_id}", batch_id + 1)  # between this batch and the next

    read = lambda t: topics.topic_source(spark, t, kind="files", root=str(tmp_path), maxFilesPerTrigger="1")
    rows, enrich = jobs.order_wide_enriched(read("infos"), read("lines"), dims_now, write, delay="1 hour")
    assert jobs.Job(rows, enrich, str(tmp_path / "checkpoint")).start(once=True).awaitTermination(120)
    got = sorted((r.order_id, r.province_name) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert [o for o, _ in got] == [0, 1, 2] and got[0][1] == "old" and got[1][1] == "after 0" and got[2][1] == "after 1"


def test_late_routing_job_reaches_facts_dimensions_and_audit(spark, tmp_path):
    put(tmp_path / "changes", "0", [change("users", "insert", 1, id="1", name="n"), change("lost", "insert", 2, id="2"), change("users", "delete", 3, id="1")])
    put(tmp_path / "config", "0", [route("users", "insert", "id,name", 1)])
    read = lambda t: topics.change_source(topics.topic_source(spark, t, kind="files", root=str(tmp_path)))
    facts, dims_, audit = sinks.routed_sink(root=str(tmp_path / "facts")), sinks.dim_sink(str(tmp_path / "dims")), sinks.table_sink(str(tmp_path / "audit"))
    rows, to = jobs.base_db_late(read("changes"), read("config"), facts, dims_, audit, patience_ms=2000)
    q = jobs.Job(rows, to, str(tmp_path / "checkpoint")).start(every="1 seconds")
    try:
        for _ in range(60):
            time.sleep(1)
            try:
                lost = spark.read.parquet(str(tmp_path / "audit")).collect()
            except Exception:  # noqa: BLE001 nothing is written yet
                lost = []
            if lost:
                break
    finally:
        q.stop()
    assert [(r.tableName, r.after) for r in lost] == [("lost", {"id": "2"})]
    assert [tuple(r) for r in sinks.dim_snapshot(spark, str(tmp_path / "dims"), "dim_users", "id,name").collect()] == [("1", "n")]


def test_routing_key(spark):
    from tidemart.functions.scalars import routing_key

    rows = spark.createDataFrame([("t", "insert"), (None, "x")], "a string, b string").select(routing_key(F.col("a"), F.col("b")).alias("k")).collect()
    assert [r.k for r in rows] == ["t:insert", "x"]


def test_distinct_ids_of_a_window_are_state_rows_of_their_own(spark, tmp_path):
    """One busy product: its orders' ids are counted exactly, and no state row holds more than one."""
    from tidemart.operators import stats

    rng = random.Random(6)
    facts = [{"sku_id": 1, "order_id": rng.randrange(300), "ts": BASE + rng.randrange(9000), "n": 1, "amount": "2.50"} for _ in range(900)]
    for i in range(3):
        put(tmp_path / "in", str(i), facts[i::3], i)
    for i in (3, 4):
        put(tmp_path / "in", str(i), [{"sku_id": 9, "order_id": 1, "ts": BASE + 10**7 * i, "n": 1, "amount": "1"}], i)
    schema = "sku_id long, order_id long, ts long, n long, amount decimal(16,2)"
    none = {name: spark.createDataFrame([], cols) for name, cols in (("sku", "ID string, SKU_NAME string, PRICE string, SPU_ID string, TM_ID string, CATEGORY3_ID string"), ("spu", "ID string, SPU_NAME string"), ("trademark", "ID string, TM_NAME string"), ("category3", "ID string, NAME string"))}

    def as_facts(df):
        return stats.order_facts(df.withColumnsRenamed({"n": "sku_num", "amount": "split_total_amount"}).withColumn("et", F.timestamp_millis("ts")))

    rows = jobs.product_stats([as_facts(stream(spark, tmp_path, "in", schema).drop("seq"))], none, "10 seconds")
    q = jobs.Job(rows, sinks.table_sink(str(tmp_path / "out")), str(tmp_path / "checkpoint")).start(once=True)
    assert q.awaitTermination(120)
    want = stats.product_stats(stats.product_facts(as_facts(spark.createDataFrame([tuple(f[c] for c in ("sku_id", "order_id", "ts", "n")) for f in facts], "sku_id long, order_id long, ts long, n long").withColumn("amount", F.lit("2.50").cast("decimal(16,2)")))), none)
    got = spark.read.parquet(str(tmp_path / "out")).where("sku_id = 1")
    assert [tuple(r) for r in got.select(*want.columns).collect()] == [tuple(r) for r in want.collect()]
    assert want.first().order_ct == len({f["order_id"] for f in facts})
    rows_of = [[s.numRowsTotal for s in p.stateOperators] for p in q.recentProgress if p.stateOperators]
    assert max(max(r) for r in rows_of) >= want.first().order_ct

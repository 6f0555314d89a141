"""The order of changes from source to fold, and loads of tables that change meanwhile."""

from __future__ import annotations

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from tidemart import schemas
from tidemart.functions import order
from tidemart.operators import cdc
from tidemart.sources import handover, sinks, topics
from tidemart.streaming import jobs

CONFIG = [("users", k, "hbase", "dim_users", "id,name,age", None, None) for k in ("insert", "update")]


def lines(place, name, rows, mtime):
    place.mkdir(exist_ok=True, parents=True)
    (place / f"{name}.txt").write_text("".join(json.dumps(r) + "\n" for r in rows))
    os.utime(place / f"{name}.txt", (mtime, mtime))


def envelope(kind="update", seq=None, **after):
    return {"database": "shop", "tableName": "users", "type": kind, "before": {}, "after": after} | ({"seq": dict(zip(("major", "log", "pos", "row"), seq))} if seq else {})


def users(spark, root):
    return sorted(tuple(r) for r in sinks.dim_snapshot(spark, str(root), "dim_users", "id,name,age").collect())


def ingest(spark, tmp_path, raw):
    dim = sinks.dim_sink(str(tmp_path / "dims"), every=2)
    changes, route = jobs.base_db(raw, lambda s: s.createDataFrame(CONFIG, schemas.ROUTING), sinks.routed_sink(root=str(tmp_path / "facts")), dim)
    assert jobs.Job(changes, route, str(tmp_path / "checkpoint")).start(once=True).awaitTermination(100)


def test_updates_of_one_key_in_one_batch_keep_the_order_of_their_file(spark, tmp_path):
    rows = [envelope("insert", id="1", name="b", age="9"), envelope(id="1", name="zed"), envelope(id="1", name="amy"), *[envelope(id=str(k), name=f"n{j}") for j in range(40, 0, -1) for k in range(2, 9)]]
    lines(tmp_path / "topic", "a", rows, 1_700_000_000)
    ingest(spark, tmp_path, topics.change_source(topics.topic_source(spark, "topic", kind="files", root=str(tmp_path))))
    assert users(spark, tmp_path / "dims") == [("1", "amy", "9"), *[(str(k), "n1", None) for k in range(2, 9)]]


def test_a_later_file_wins_and_a_replayed_one_changes_nothing(spark, tmp_path):
    for i, name in enumerate(("zed", "max", "amy", "bob", "abe")):
        lines(tmp_path / "topic", f"{9 - i}", [envelope(id="1", name=name + "0"), envelope(id="1", name=name)], 1_700_000_000 + i)
    read = lambda **o: topics.change_source(topics.topic_source(spark, "topic", kind="files", root=str(tmp_path), **o))
    ingest(spark, tmp_path, read(maxFilesPerTrigger="1"))
    assert users(spark, tmp_path / "dims") == [("1", "abe", None)]
    dim = sinks.dim_sink(str(tmp_path / "dims"), 0)
    early = cdc.dimensions(cdc.routed(read(streaming=False, pathGlobFilter="9.txt"), spark.createDataFrame(CONFIG, schemas.ROUTING)))
    for batch in (0, 70):  # the first batch again, in its place and as a late one
        dim(early, batch)
        assert users(spark, tmp_path / "dims") == [("1", "abe", None)]


def record(file, pos, name=None, op="u", **more):
    after = {"id": "1"} | ({"name": name} if name else {}) | more
    return {"before": None, "after": after, "op": op, "source": {"file": file, "pos": pos, "row": 0, "db": "shop"}}


def test_places_in_the_log_outweigh_batches_and_files(spark, tmp_path):
    """bin.10 comes after bin.9 though it sorts before; the newest change comes in the first batch, the oldest in the last; each column has its own last change."""
    batches = [[record("bin.10", 7, "last"), record("bin.10", 6, "zzz")], [record("bin.9", 999, "old", age="3")], [record("bin.9", 5, "older", age="2"), record("bin.10", 7, "last")], [record("bin.9", 1000, age="4")]]
    for i, rows in enumerate(batches):
        lines(tmp_path / "server.shop.users", f"{i}", rows, 1_700_000_000 + i)
    raw = topics.topic_source(spark, "server.shop.users", kind="files", root=str(tmp_path), maxFilesPerTrigger="1")
    ingest(spark, tmp_path, cdc.normalized(raw))
    assert users(spark, tmp_path / "dims") == [("1", "last", "4")]
    assert sinks.settled(spark, str(tmp_path / "dims")) == 2  # the last batch was folded into a state that had a later change of another column


def test_configuration_follows_its_own_log(spark, tmp_path):
    row = lambda columns, **more: {"source_table": "users", "operate_type": "insert", "sink_type": "hbase", "sink_table": "dim", "sink_columns": columns} | more
    rows = [envelope("insert", **row("id,z")), envelope(**row("id,a"))]
    lines(tmp_path / "config", "a", rows, 1_700_000_000)
    found = topics.config_source(topics.change_source(topics.topic_source(spark, "config", kind="files", streaming=False, root=str(tmp_path))))
    assert [r.sink_columns for r in found.collect()] == ["id,a"]


def test_changes_without_an_order_are_refused(spark, tmp_path):
    with pytest.raises(ValueError, match="seq"):
        sinks.dim_sink(str(tmp_path))(spark.createDataFrame([("t", "id", {"id": "1"})], "sink_table string, sink_pk string, after map<string,string>"), 0)


def test_snapshots_come_before_all_changes(spark):
    rows = spark.createDataFrame([(1, "a")], "id int, name string")
    r = topics.snapshot_source(rows, "shop", "users").first()
    assert (r.type, r.after, tuple(r.seq)) == ("insert", {"id": "1", "name": "a"}, order.FIRST)


# Loads ------------------------------------------------------------------------------------------------------------------


class Shop:
    """A table of numbers that changes between any two looks at it, and its log."""

    def __init__(self, seed):
        self.rng, self.rows, self.log = random.Random(seed), {}, []
        self.change(30)

    def change(self, n):
        for _ in range(n):
            k = self.rng.randrange(45)
            kind = "delete" if k in self.rows and self.rng.random() < 0.3 else "update" if k in self.rows else "insert"
            if kind == "delete":
                value = self.rows.pop(k)
            else:
                value = self.rows[k] = len(self.log)
            self.log.append((k, len(self.log) + 1, kind, value))

    def position(self):
        self.change(self.rng.randrange(4))
        return (0, "", len(self.log), 0)


@pytest.mark.parametrize("seed", range(3))
def test_load_of_a_changing_table(spark, tmp_path, seed):
    shop, place = Shop(seed), str(tmp_path / "load")
    begun = shop.position()
    held = sorted(shop.rows)
    chunks = handover.Chunks(held[0], held[-1], 6)
    reads = []

    def read(first, last):
        if len(reads) == 3:
            reads.append("lost")
            raise OSError("the database went away")
        reads.append(first)
        rows = []
        for k in range(first, last + 1):  # rows are seen at different times
            shop.change(shop.rng.randrange(2))
            rows += [(k, shop.rows[k])] if k in shop.rows else []
        return spark.createDataFrame(rows, "id long, value long")

    with pytest.raises(OSError):
        handover.load(spark, place, chunks, read, shop.position)
    assert handover.marks(spark, place).count() == 3
    shop.change(5)
    handover.load(spark, place, chunks, read, shop.position)
    assert reads == [chunks.bounds(c)[0] for c in range(3)] + ["lost"] + [chunks.bounds(c)[0] for c in range(3, len(chunks))]  # it went on where it stopped
    shop.change(20)
    log = spark.createDataFrame(shop.log, "id long, n long, type string, value long").withColumn("seq", order.numbered(F.col("n")))
    out = handover.handed_over(handover.loaded(spark, place), handover.marks(spark, place), log, chunks, "id", begun)
    assert {r.id: r.value for r in handover.state(out, "id").collect()} == shop.rows
    # Each key's history is a chain: an insert at most at its beginning or after a delete, nothing twice.
    kinds = {}
    for r in sorted(out.collect(), key=lambda r: (r.id, tuple(r.seq))):
        kinds.setdefault(r.id, []).append(r)
    for rows in kinds.values():
        assert len({(r.type, r.value) for r in rows if r.type != "delete"}) == len([r for r in rows if r.type != "delete"])
        assert all(b.type != "insert" or a.type == "delete" for a, b in zip(rows, rows[1:]))


def test_the_log_is_a_stream_after_the_load(spark, tmp_path):
    chunks, place = handover.Chunks(1, 4, 2), str(tmp_path / "load")
    marks = iter([(0, "", 10, 0), (0, "", 20, 0), (0, "", 20, 0), (0, "", 30, 0)])
    handover.load(spark, place, chunks, lambda a, b: spark.createDataFrame([(k, f"s{k}") for k in range(a, b + 1)], "id long, v string"), lambda: next(marks))
    log = [("1", 9), ("1", 10), ("2", 15), ("3", 20), ("3", 21), ("4", 31), ("5", 2), ("5", 3), ("x", 40)]
    lines(tmp_path / "topic", "a", [envelope(seq=(0, "", n, 0), id=k, v=f"l{n}") for k, n in log], 1_700_000_000)
    stream = topics.change_source(topics.topic_source(spark, "topic", kind="files", root=str(tmp_path))).withColumn("id", F.col("after")["id"])
    rows = handover.since(stream, handover.marks(spark, place), chunks, "id", (0, "", 2, 0)).select("id", F.col("seq.pos").alias("n"))
    assert jobs.Job(rows, sinks.table_sink(str(tmp_path / "out")), str(tmp_path / "checkpoint")).start(once=True).awaitTermination(100)
    assert sorted((r.id, r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [("2", 15), ("3", 21), ("4", 31), ("5", 3), ("x", 40)]


def test_load_of_a_database_table(spark, tmp_path):
    """The table and its log are in a database, which changes between any two looks at it; chunks are read by JDBC."""
    from tidemart.sources import jdbc

    spark.sparkContext._jvm.java.lang.System.setProperty("derby.stream.error.file", "/dev/null")
    url, rng, held, n = "jdbc:derby:memory:handover;create=true", random.Random(3), {}, [0]

    def change(times):
        with jdbc.transaction(spark, url) as c:
            for _ in range(times):
                k, name = rng.randrange(60), f"n{n[0]}"
                kind = "delete" if k in held and rng.random() < 0.3 else "update" if k in held else "insert"
                sql = {"delete": "DELETE FROM users WHERE id = ?", "update": "UPDATE users SET name = ? WHERE id = ?", "insert": "INSERT INTO users (name, id) VALUES (?, ?)"}[kind]
                jdbc.execute(c, sql, *([k] if kind == "delete" else [name, k]))
                n[0] += 1
                jdbc.execute(c, "INSERT INTO changes VALUES (?, ?, ?, ?)", n[0], k, kind, held[k] if kind == "delete" else name)
                if kind == "delete":
                    del held[k]
                else:
                    held[k] = name

    with jdbc.transaction(spark, url) as c:
        jdbc.execute(c, "CREATE TABLE users (id BIGINT PRIMARY KEY, name VARCHAR(20))")
        jdbc.execute(c, "CREATE TABLE changes (n BIGINT PRIMARY KEY, id BIGINT, kind VARCHAR(10), name VARCHAR(20))")
    change(80)

    def position():
        change(4)
        now = (0, "", n[0], 0)
        change(3)  # what comes after this position, while the chunk is read
        return now

    begun, place = (0, "", n[0], 0), str(tmp_path / "load")
    chunks = handover.Chunks(0, 59, 25)
    read = handover.jdbc_reader(spark, url, "users", "id", tasks=3)
    assert read(0, 24).rdd.getNumPartitions() == 3
    handover.load(spark, place, chunks, read, position)
    change(10)
    log = spark.read.format("jdbc").options(url=url, dbtable="changes").load().toDF("n", "id", "type", "name").withColumn("seq", order.numbered(F.col("n")))
    rows = handover.loaded(spark, place).select(F.col("ID").alias("id"), F.col("NAME").alias("name"), "chunk")
    out = handover.state(handover.handed_over(rows, handover.marks(spark, place), log, chunks, "id", begun), "id")
    assert {r.id: r.name for r in out.collect()} == held

"""Han words by a dictionary, windows of the clock, one-pass facts."""

from __future__ import annotations

import json
import random
import re
import time
from decimal import Decimal

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemart.operators import logs, stats, visits, words
from tidemart.sources import sinks, topics
from tidemart.streaming import jobs, processors

BASE = 1_704_067_200_000


def plain_words(text, dictionary):
    out = []
    for m in re.finditer(r"[a-z0-9]+|[一-鿿\U00020000-\U0002a6df]+", text.lower()):
        run, begin = m[0], m.start()
        if run[0].isascii():
            out.append((run, begin))
            continue
        found = [(run[i:j], i) for i in range(len(run)) for j in range(i + 1, len(run) + 1) if run[i:j] in dictionary]
        covered = {p for w, i in found for p in range(i, i + len(w))}
        out += [(w, begin + i) for w, i in found] + [(c, begin + i) for i, c in enumerate(run) if i not in covered]
    return out


def test_segmentation(spark):
    rng = random.Random(2)
    chars = "中华人民共和国大会堂小米手机壳\U00020001"
    dictionary = {"中华", "华人", "人民", "共和国", "中华人民共和国", "大会堂", "手机", "手机壳", "小", "\U00020001大", "民共"}
    phrases = [None, "", "red WIDGET 12", "中华人民共和国", "小米手机壳 iPhone15手机", "，。！", "大" * 50, *["".join(rng.choices(chars + "aB1 ,", k=rng.randrange(1, 40))) for _ in range(60)], "中" * 3000 + "手机"]
    phrases += phrases[2:6]  # phrases come again
    rows = [(i, p, "k") for i, p in enumerate(phrases)]
    df = spark.createDataFrame(rows, "n int, full_word string, at string")
    got = words.segmented(df, spark.createDataFrame([(w,) for w in [*dictionary, None, ""]], "word string")).collect()
    want = sorted((i, w, at) for i, p, _ in rows if p for w, at in plain_words(p, dictionary))
    assert sorted((r.n, r.keyword, r["at"]) for r in got) == want
    none = words.segmented(df, spark.createDataFrame([], "word string")).collect()
    assert sorted((r.n, r.keyword, r["at"]) for r in none) == sorted((i, w, at) for i, p, _ in rows if p for w, at in plain_words(p, set()))


# Windows of the clock ---------------------------------------------------------------------------------------------------


class Clock:
    def __init__(self):
        self.now = 0

    def getCurrentProcessingTimeInMs(self):  # noqa: N802
        return self.now


class Handle:
    """What a processor sees of its state."""

    def __init__(self):
        self.values, self.timers = {}, set()

    def getMapState(self, *_):  # noqa: N802
        return self

    def containsKey(self, k):  # noqa: N802
        return k in self.values

    def getValue(self, k):  # noqa: N802
        return self.values[k]

    def updateValue(self, k, v):  # noqa: N802
        self.values[k] = v

    def removeKey(self, k):  # noqa: N802
        del self.values[k]

    def iterator(self):
        return iter(list(self.values.items()))

    def registerTimer(self, t):  # noqa: N802
        self.timers.add(t)


def test_windows_follow_the_clock():
    clock, handle = Clock(), Handle()
    p = processors.ClockSums(["sku"], ["n", "amount"], 10_000)
    p.init(handle)
    add = lambda *rows: list(p.handleInputRows(("a",), iter([pd.DataFrame([(Decimal(n), None if a is None else Decimal(a)) for n, a in rows], columns=["n", "amount"])]), clock))
    fire = lambda: pd.concat(p.handleExpiredTimer(("a",), clock, None)).values.tolist()
    clock.now = 12_000
    add((1, "2.50"), (1, None))
    clock.now = 19_999
    add((1, "0.25"))
    assert handle.timers == {20_000} and fire() == []
    clock.now = 20_000
    add((5, "1"))  # the next window
    assert fire() == [["a", 10_000, 20_000, 20_000, Decimal(3), Decimal("2.75")]]
    clock.now = 47_000  # nothing came meanwhile
    assert fire() == [["a", 20_000, 30_000, 47_000, Decimal(5), Decimal(1)]] and handle.values == {}


def test_clock_sums_of_a_stream(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.txt").write_text("".join(json.dumps({"sku": i % 2, "n": 1, "amount": "1.25"}) + "\n" for i in range(10)))
    raw = topics.topic_source(spark, "t", kind="files", root=str(tmp_path))
    rows = raw.select(F.from_json("value", "sku long, n long, amount decimal(16,2)").alias("r")).select("r.*")
    begun = time.time() * 1000
    q = jobs.Job(processors.clock_sums(rows, ["sku"], ["n", "amount"], 2000), sinks.table_sink(str(tmp_path / "out")), str(tmp_path / "c")).start(every="1 seconds")
    try:
        for _ in range(60):
            time.sleep(1)
            try:
                got = spark.read.parquet(str(tmp_path / "out")).collect()
            except Exception:  # noqa: BLE001 nothing is written yet
                got = []
            if len(got) == 2:
                break
    finally:
        q.stop()
    assert sorted((r.sku, r.n, str(r.amount)) for r in got) == [("0", 5, "6.25"), ("1", 5, "6.25")]
    assert all(r.ts > begun and r.stt < r.edt for r in got)


def test_ts_by_choice(spark):
    facts = spark.createDataFrame([("w", BASE)], "keyword string, ms long").withColumn("et", F.timestamp_millis("ms"))
    begun = time.time() * 1000 - 1
    assert stats.keyword_stats(facts).first().ts == BASE and stats.keyword_stats(facts, ts="computed").first().ts >= begun
    with pytest.raises(ValueError):
        stats.keyword_stats(facts, ts="other")


# One pass -----------------------------------------------------------------------------------------------------------------


def test_visitor_facts_in_one_pass(spark):
    rng, rows = random.Random(5), []
    for i in range(400):
        mid = rng.choice(["a", "b", "c", None])
        ts = rng.choice([None, BASE + rng.randrange(40) * 4_000_000 + rng.choice([0, 3000])])
        page = {"last_page_id": rng.choice([None, "", "x"]), "during_time": rng.choice([None, 7])}
        common = {"vc": "1", "ch": rng.choice("xy"), "ar": "1", "is_new": "0"} | ({"mid": mid} if mid else {})
        rows.append(({"common": common, "page": {k: v for k, v in page.items() if v is not None}} | ({"ts": ts} if ts else {}) | {"n": i}))
    pages = logs.parse_drop_dirty(spark.createDataFrame([(json.dumps(r),) for r in rows], "value string"))
    three = stats.visitor_facts(pages, visits.unique_visits(pages, "value"), visits.user_jumps(pages, "value"))
    one = stats.visitor_page_facts(pages, "value")
    assert one.count() == len(rows)
    show = lambda f: sorted(map(str, stats.visitor_stats(f, "1 hour").collect()))
    assert show(three) == show(one)


def test_order_and_payment_facts_in_one_pass(spark):
    rows = [(1, 10, BASE, [BASE, BASE + 900_000, BASE + 900_001, BASE - 1]), (2, 10, BASE, None), (3, 11, BASE, [])]
    wide = spark.createDataFrame([(o, s, 2, 1.5, ms, p) for o, s, ms, p in rows], "order_id long, sku_id long, sku_num long, split_total_amount double, ms long, p array<long>")
    wide = wide.withColumns({"et": F.timestamp_millis("ms"), "paid": F.transform("p", F.timestamp_millis)})
    got = stats.order_and_payment_facts(wide, "paid").collect()
    assert sorted((r._ordered or 0, r._paid or 0, r.order_sku_num or 0) for r in got) == [(0, 1, 0), (0, 1, 0), (1, 0, 2), (2, 0, 2), (3, 0, 2)]

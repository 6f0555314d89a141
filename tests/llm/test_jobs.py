"""What the driver has to keep track of: jobs."""

from __future__ import annotations

import numpy as np

from tidemart.llm import ngram_join


def test_counters_are_read_in_few_jobs_however_many_shuffle_partitions(spark):
    """Each partition was a job of its own, one after the other."""
    docs = spark.createDataFrame([(f"one {i} two {i} three",) for i in range(40)], "text string")
    begun = spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs
    before, found = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for n in (2, 64):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            first = begun()
            found.append((ngram_join.levels(docs, 16), begun() - first))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    (one, _), (two, jobs) = found
    assert np.array_equal(one[0], two[0]) and one[1] == two[1] and one[0].any()
    assert jobs < 20

"""Every query against its SQL in DuckDB."""

from __future__ import annotations

import duckdb
import pytest

from tidemart import catalog

SF = "/root/testdata/sf0.001"


def rows(cols, data, order):
    at = [cols.index(c) for c in order]
    tidy = lambda v: round(v, 4) if isinstance(v, float) else v
    return sorted(str(tuple(tidy(r[i]) for i in at)) for r in data)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = catalog.queries()[name](spark, SF)
    want = con.sql(catalog.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    order = sorted(want.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()], order) == rows(want.columns, want.fetchall(), order)

"""Every registered query with an oracle matches DuckDB exactly on sf0.001 (the driver checks sf0.01)."""

import os

import duckdb
import pytest

from tests.conftest import SF_SMALL

import __spark_entry__ as E  # noqa: E402
from tools.oracle_check import TABLES, norm  # noqa: E402

ORACLES = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{SF_SMALL}/{t}.parquet"
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, con, name):
    sdf = E.queries()[name](spark, SF_SMALL)
    srows, scols = sdf.collect(), sdf.columns
    res = con.execute(ORACLES[name])
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    assert sorted(scols) == sorted(dcols)
    order = sorted(scols)
    s = sorted((tuple(norm(r[scols.index(c)]) for c in order) for r in srows), key=repr)
    d = sorted((tuple(norm(r[dcols.index(c)]) for c in order) for r in drows), key=repr)
    assert s == d


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 4 and "outliers_count" in df.columns

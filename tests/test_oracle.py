"""Every registered query against its DuckDB oracle on the smallest tables."""

import duckdb
import pytest

from __spark_entry__ import entry
from tablewarden.plans.fixtures import TABLES
from tablewarden.plans.oracle import ORACLE_SQL
from tablewarden.plans.queries import QUERIES
from tools.oracle_check import _digest

from conftest import SMALL


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    return c


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE_SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SMALL)
    s_rows = [tuple(r) for r in df.collect()]
    res = con.execute(ORACLE_SQL[name])
    d_cols = [c[0] for c in res.description]
    d_rows = res.fetchall()
    assert sorted(df.columns) == sorted(d_cols)
    assert len(s_rows) == len(d_rows)
    assert _digest(df.columns, s_rows) == _digest(d_cols, d_rows)


def test_entry_runs(spark):
    df = entry(spark)
    assert df.count() > 0
    assert df.columns[:3] == ["pos", "catalog", "schema"]

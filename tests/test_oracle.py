"""Every registered query against its DuckDB SQL at sf0.001 (the driver uses sf0.01)."""

import duckdb
import pytest

import __spark_entry__ as E
from notewise.plans.portfolio import QUERIES
from oracle_check import TABLES, compare

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def test_every_query_has_an_oracle():
    assert set(QUERIES) <= set(E.queries()) & set(E.oracle_sql())
    assert len(QUERIES) >= 44


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query_matches_oracle(spark, con, key):
    line = compare(spark, con, SF, key)
    assert " OK " in line, line


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 10 and "netRoi" in df.columns

"""Run every registered query in Spark and its oracle SQL in DuckDB, and compare.

Usage: python tests/oracle_check.py [sf_dir] [key ...]
Prints one line per key: rows, column names and exact values (order-insensitive).
"""

from __future__ import annotations

import math
import sys
import time
from decimal import Decimal

import duckdb

sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])

import __spark_entry__ as E  # noqa: E402,I001
from notewise.session import local_session  # noqa: E402

# Spark type name -> DuckDB type name, for the schema part of the comparison.
SPARK_TO_DUCKDB = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
                   "date": "DATE", "boolean": "BOOLEAN", "decimal(18,2)": "DECIMAL(18,2)",
                   "decimal(18,4)": "DECIMAL(18,4)"}

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return float(v) + 0.0
    if isinstance(v, Decimal):
        return Decimal(v)
    if hasattr(v, "isoformat"):
        return v.isoformat()[:10] if type(v).__name__ == "date" else v.isoformat()
    return v


def _rows(names, tuples):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(_norm(t[i]) for i in order) for t in tuples]
    return sorted(out, key=lambda r: tuple((x is None, str(x)) for x in r))


def compare(spark, con, sf_dir, key):
    t0 = time.time()
    sdf = E.queries()[key](spark, sf_dir)
    srows = [tuple(r) for r in sdf.collect()]
    t1 = time.time()
    sql = E.oracle_sql().get(key)
    if sql is None:
        return f"{key:26s} rows={len(srows)} (no oracle) spark={t1-t0:.1f}s"
    rel = con.sql(sql)
    dnames = rel.columns
    drows = rel.fetchall()
    snames = sdf.columns
    if sorted(snames) != sorted(dnames):
        return f"{key:26s} COLUMNS DIFFER spark={sorted(snames)} duck={sorted(dnames)}"
    dtypes = dict(zip(dnames, [str(t) for t in rel.types]))
    wrong = {c: (t, dtypes[c]) for c, t in sdf.dtypes if SPARK_TO_DUCKDB.get(t, t) != dtypes[c]}
    if wrong:
        return f"{key:26s} TYPES DIFFER {wrong}"
    a, b = _rows(snames, srows), _rows(dnames, drows)
    if len(a) != len(b):
        return f"{key:26s} ROWCOUNT spark={len(a)} duck={len(b)}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    status = "OK" if not bad else f"VALUES DIFFER in {len(bad)} rows; first: {bad[0]}"
    return f"{key:26s} rows={len(a)} {status} spark={t1-t0:.1f}s"


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    keys = sys.argv[2:] or list(E.queries())
    spark = local_session(8)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    for k in keys:
        try:
            print(compare(spark, con, sf_dir, k), flush=True)
        except Exception as e:  # report and go on
            print(f"{k:26s} ERROR {type(e).__name__}: {str(e)[:400]}", flush=True)


if __name__ == "__main__":
    main()

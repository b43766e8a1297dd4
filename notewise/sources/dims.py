"""The fixed grade dimension, built as a local relation (exact size known to the optimizer).

It has ten rows, so it is the only table this library broadcasts explicitly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from notewise.sources.schema import GRADE_BAD_DEBT_RATES


def _sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def grade_dim(spark: SparkSession) -> DataFrame:
    """(gradeOrder INT, grade STRING, badDebtRate DOUBLE): 10 rows, annual % rate."""
    rows = ", ".join(
        f"({i}, {_sql_str(g)}, CAST({r!r} AS DOUBLE))"
        for i, (g, r) in enumerate(GRADE_BAD_DEBT_RATES)
    )
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(gradeOrder, grade, badDebtRate)")

"""Closed-form loan formulas and exact integer helpers."""

import math

import pytest
from pyspark.sql import functions as F

from notewise.functions import loanmath as L


def _eval(spark, col, schema, rows):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(col).collect()]


def test_annuity_principal_matches_formula(spark):
    u, rate, n = 10.0, 16.18, 36
    i = rate / 1200
    expected = round(u / i * (1 - 1 / (1 + i) ** n))
    got = _eval(spark, L.annuity_principal("u", "r", "n"), "u DOUBLE, r DOUBLE, n BIGINT",
                [(u, rate, n)])
    assert got == [expected]


def test_annuity_principal_zero_rate_is_limit(spark):
    got = _eval(spark, L.annuity_principal("u", "r", "n"), "u DOUBLE, r DOUBLE, n BIGINT",
                [(10.0, 0.0, 36)])
    assert got == [360.0]


def test_bad_debt_reserve(spark):
    p, rate, n = 1000.0, 4.32, 12
    r = rate / 1200
    expected = round(p * (n * r / (1 - (1 + r) ** -n) - 1), 2)
    got = _eval(spark, L.bad_debt_reserve("p", "r", "n"), "p DOUBLE, r DOUBLE, n BIGINT",
                [(p, rate, n), (p, 0.0, n), (p, None, n)])
    assert got[0] == pytest.approx(expected, abs=1e-9)
    assert got[1] == 0.0 and got[2] is None


def test_annualized_growth(spark):
    rows = [(10.0, 100.0, 12, 0), (10.0, 100.0, 12, 12), (10.0, 100.0, 24, 18)]
    got = _eval(spark, L.annualized_growth("e", "p", "n", "rem"),
                "e DOUBLE, p DOUBLE, n BIGINT, rem BIGINT", rows)
    assert got[0] == pytest.approx(1.1)
    assert got[1] == 1.0
    assert got[2] == pytest.approx(1.1 ** 2)


def test_ceil_div_all_signs(spark):
    rows = [(a, b) for a in (-7, -6, -1, 0, 1, 6, 7) for b in (-3, -2, 2, 3)] + [(5, 0)]
    got = _eval(spark, L.ceil_div("a", "b"), "a BIGINT, b BIGINT", rows)
    for (a, b), g in zip(rows, got):
        assert g == (None if b == 0 else math.ceil(a / b)), (a, b)


def test_clamp_semantics(spark):
    rows = [(5, 0, 3), (-1, 0, 3), (2, 0, 3), (None, 0, 3), (2, 0, -1)]
    got = _eval(spark, L.clamp("x", "lo", "hi"), "x BIGINT, lo BIGINT, hi BIGINT", rows)
    assert got == [3, 0, 2, None, 0]


def test_units_round_trip(spark):
    got = _eval(spark, L.from_units(L.to_units(F.col("x"))), "x DOUBLE", [(12.35,), (0.1 + 0.2,)])
    assert got == [12.35, 0.3]

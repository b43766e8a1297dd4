"""Golden rows of the payment waterfall (hand-computed) and the spill-over trap."""

import pytest
from pyspark.sql import functions as F

from notewise.operators.waterfall import note_progress, waterfall
from notewise.sources.schema import waterfall_columns

NOTE = "company STRING, fees DOUBLE, principal DOUBLE, badDebtFunds DOUBLE, profits DOUBLE, " \
       "unitPayment DOUBLE, cyclesTotal BIGINT, cyclesRemaining BIGINT, amountRepayed DOUBLE"

# amountRepayed -> (received, next, outstanding) per category, then monthsToBreakeven
GOLDEN = {
    6: [(3, 0, 0), (3, 10, 62), (0, 0, 5), (0, 0, 18.14), 8],
    20: [(3, 0, 0), (17, 10, 48), (0, 0, 5), (0, 0, 18.14), 6],
    70: [(3, 0, 0), (67, 8, 0), (0, 2, 3), (0, 0, 18.14), 1],
    80: [(3, 0, 0), (75, 0, 0), (2, 3, 0), (0, 7, 11.14), 0],
    115: [(3, 0, 0), (75, 0, 0), (5, 0, 0), (18.14, 0, 0), 0],
}


def _notes(spark, bad_debt=5.0):
    rows = [(f"My Test Company{i or ''}", 3.0, 75.0, bad_debt, 18.14, 10.0, 36, 36 - i, float(a))
            for i, a in enumerate(GOLDEN)]
    return spark.createDataFrame(rows, NOTE)


def test_golden_rows(spark):
    out = note_progress(waterfall(_notes(spark)))
    got = {r["amountRepayed"]: r for r in out.collect()}
    cols = waterfall_columns()
    for a, expected in GOLDEN.items():
        row = got[float(a)]
        flat = [v for triple in expected[:4] for v in triple]
        assert [row[c] for c in cols] == pytest.approx(flat, abs=1e-9), a
        assert row["monthsToBreakeven"] == expected[4]


def test_spillover_next_exceeds_unit_payment(spark):
    """Reference semantics: a small category's next payment is capped by U only."""
    notes = _notes(spark, bad_debt=1.0).filter(F.col("amountRepayed") == 70)
    row = waterfall(notes).first()
    assert row["nextBadDebtFundsPayment"] == 2.0
    assert row["nextProfitsPayment"] == 1.0
    total_next = sum(row[c] for c in ["nextFeesPayment", "nextPrincipalPayment",
                                      "nextBadDebtFundsPayment", "nextProfitsPayment"])
    assert total_next == 11.0


def test_cap_spillover(spark):
    notes = _notes(spark, bad_debt=1.0).filter(F.col("amountRepayed") == 70)
    row = waterfall(notes, cap_spillover=True).first()
    assert (row["nextPrincipalPayment"], row["nextBadDebtFundsPayment"],
            row["nextProfitsPayment"]) == (8.0, 1.0, 1.0)


def test_negative_category_does_not_fail(spark):
    """The reference asserts min <= max in its clamp; here a negative category is data."""
    df = spark.createDataFrame([("x", 3.0, 75.0, 5.0, -10.0, 10.0, 36, 30, 90.0)], NOTE)
    row = waterfall(df).first()
    assert row["profitsReceived"] == 0.0


def test_null_inputs_give_null(spark):
    df = spark.createDataFrame([("x", 3.0, 75.0, None, 1.0, 10.0, 36, 30, 90.0)], NOTE)
    row = waterfall(df).first()
    assert row["badDebtFundsReceived"] is None and row["feesPaid"] == 3.0


def test_zero_unit_payment_breakeven_is_null(spark):
    df = spark.createDataFrame([("x", 0.0, 0.0, 0.0, 0.0, 0.0, 3, 3, 0.0)], NOTE)
    row = note_progress(waterfall(df)).first()
    assert row["monthsToBreakeven"] is None and row["completed"] is False


def test_custom_categories(spark):
    df = spark.createDataFrame([(5.0, 10.0, 4.0, 7.0)], "a DOUBLE, b DOUBLE, u DOUBLE, paid DOUBLE")
    row = waterfall(df, categories=["a", "b"], paid="paid", unit="u").first()
    assert (row["aReceived"], row["nextAPayment"], row["aOutstanding"]) == (5.0, 0.0, 0.0)
    assert (row["bReceived"], row["nextBPayment"], row["bOutstanding"]) == (2.0, 4.0, 4.0)

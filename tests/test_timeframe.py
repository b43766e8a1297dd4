"""Timeframe earnings: bounds, and consistency with the cumulative KPI."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from notewise.operators import metrics
from notewise.operators.timeframe import earnings_by_period, earnings_timeframe, timeframe_bounds
from notewise.plans.portfolio import analyzed_notes
from notewise.sources.derived import derive_ledger


def test_bounds():
    assert timeframe_bounds("2000-06-30", "all") == (None, dt.date(2000, 6, 30))
    assert timeframe_bounds("2000-06-30", "year") == (dt.date(1999, 12, 31), dt.date(2000, 6, 30))
    assert timeframe_bounds("2000-03-15", "month") == (dt.date(2000, 2, 29), dt.date(2000, 3, 15))
    with pytest.raises(ValueError):
        timeframe_bounds("2000-03-15", "week")


def test_all_time_equals_total_earnings(spark, sf_small):
    ledger = derive_ledger(spark, sf_small)
    total = metrics.kpi_total_earnings(analyzed_notes(ledger)).first()["totalEarnings"]
    row = earnings_timeframe(ledger, "2100-01-01", "all").first()
    assert row["periodStart"] is None and row["earningsAtStart"] == 0.0
    assert row["earnings"] == pytest.approx(total, abs=1e-6)


def test_periods_add_up(spark, sf_small):
    """Year-to-date earnings = earnings as of the end minus as of the previous year end."""
    ledger = derive_ledger(spark, sf_small)
    ytd = earnings_timeframe(ledger, "2000-06-30", "year").first()
    end = earnings_timeframe(ledger, "2000-06-30", "all").first()
    start = earnings_timeframe(ledger, "1999-12-31", "all").first()
    assert ytd["earningsAtEnd"] == pytest.approx(end["earnings"], abs=1e-6)
    assert ytd["earningsAtStart"] == pytest.approx(start["earnings"], abs=1e-6)
    assert ytd["earnings"] >= 0
    by = earnings_timeframe(ledger, "2000-06-30", "month", by=["grade"])
    assert by.agg(F.round(F.sum("earnings"), 2)).first()[0] == pytest.approx(
        earnings_timeframe(ledger, "2000-06-30", "month").first()["earnings"], abs=1e-6)


def test_every_month_equals_its_timeframe(spark, sf_small):
    ledger = derive_ledger(spark, sf_small, faulty=True).where("loanID < 2000")
    rows = earnings_by_period(ledger, "month").orderBy("periodEnd").collect()
    assert all(a.periodEnd == b.periodStart and a.earningsAtEnd == b.earningsAtStart for a, b in zip(rows, rows[1:], strict=False))
    for r in (rows[0], rows[len(rows) // 2], rows[-1]):
        one = earnings_timeframe(ledger, r.periodEnd, "month").first()
        assert (r.periodStart, r.earningsAtStart, r.earningsAtEnd, r.earnings) == (
            one.periodStart, one.earningsAtStart, one.earningsAtEnd, one.earnings)
    years = earnings_by_period(ledger, "year").collect()
    assert sum(r.earnings for r in years) == pytest.approx(sum(r.earnings for r in rows), abs=1e-6)
    assert sum(r.notesExcluded for r in rows) > 0


def test_periods_by_hand(spark):
    """One note of three instalments of 100 with 1 in fees, paid in January twice and in April."""
    from decimal import Decimal

    from notewise.sources.schema import ledger_schema

    d = lambda x: Decimal(str(x))
    line = lambda loan, grade, paid: ("Scheduled", loan, "A", "L", 0.0, grade, d(30), d(70), d(100), d(0), d(0), d(0), d(0), d(0),
                                      d(100 if paid else 0), d(1), dt.date(2020, 1, 1), paid, "x")
    rows = [line(1, "A", dt.date(2020, 1, 5)), line(1, "A", dt.date(2020, 1, 31)), line(1, "A", dt.date(2020, 4, 1)),
            line(2, "A", None), line(None, None, dt.date(2020, 3, 1))]
    ledger = spark.createDataFrame(rows, ledger_schema())
    got = [(r.periodEnd, r.notesPaid, r.notesExcluded, r.earnings) for r in earnings_by_period(ledger).orderBy("periodEnd").collect()]
    # Fees 3 and principal 300 come first, so nothing is earned; the note without a grade has no reserve.
    assert got == [(dt.date(2020, 1, 31), 1, 0, 0.0), (dt.date(2020, 2, 29), 0, 0, 0.0),
                   (dt.date(2020, 3, 31), 1, 1, 0.0), (dt.date(2020, 4, 30), 1, 0, 0.0)]
    by = earnings_by_period(ledger, "quarter", by=["grade"]).collect()
    assert sorted((str(r.grade), r.periodEnd.month, r.notesPaid) for r in by) == [("A", 3, 1), ("A", 6, 1), ("None", 3, 1), ("None", 6, 0)]
    assert earnings_by_period(ledger.where("false")).count() == 0
    with pytest.raises(ValueError):
        earnings_by_period(ledger, "week")


def test_periods_sort_the_notes_once(spark, sf_small):
    """Each further sort would hold all rows of a task once more."""
    plan = earnings_by_period(derive_ledger(spark, sf_small), "month")._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.splitlines() if " Window [" in line and "loanName#" in line]
    sorts = [line for line in plan.splitlines() if "Sort [" in line and "loanName#" in line]
    assert len(windows) == len(sorts) == 1, plan

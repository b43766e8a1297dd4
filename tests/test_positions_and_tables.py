"""Positions without a single-task window, KPIs with subtotals, and notes bucketed by loan."""

import re

import pytest
from pyspark.sql import functions as F

from notewise.operators import metrics, selection
from notewise.operators.notes import apply_transactions, loan_transactions, note_summary
from notewise.plans.portfolio import analyzed_notes
from notewise.sources.derived import derive_ledger
from notewise.sources.notetable import apply_to_table, save_notes


@pytest.fixture(scope="module")
def ledger(spark, sf_small):
    return derive_ledger(spark, sf_small, faulty=True)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_positions_follow_the_order(spark, ledger):
    notes = analyzed_notes(ledger).select("loanID", "company", "loanName", "interestRate", "grade", "principal")
    got = selection.with_positions(notes)
    places = got.orderBy("position").collect()
    assert [r["position"] for r in places] == list(range(notes.count()))
    assert [tuple(r)[:-1] for r in places] == [tuple(r) for r in selection.order_notes(notes).collect()]
    # One window only, over the sizes of the ranges.
    assert _plan(got).count("Window ") <= 2 and "rangepartitioning" not in _plan(got)


def test_positions_with_hot_keys_nulls_and_no_rows(spark):
    rows = [(i, "c", "n", 5.0, "A", None if i % 3 == 0 else 1.0) for i in range(3000)]
    schema = "loanID long, company string, loanName string, interestRate double, grade string, principal double"
    notes = spark.createDataFrame(rows, schema)
    places = {r["loanID"]: r["position"] for r in selection.with_positions(notes).collect()}
    want = sorted(range(3000), key=lambda i: (i % 3 != 0, i))
    assert places == {loan: p for p, loan in enumerate(want)}
    assert selection.with_positions(notes.where("false")).collect() == []


def test_rollup_equals_its_levels(spark, ledger):
    notes = analyzed_notes(ledger)
    got = metrics.portfolio_kpis_rollup(notes, ["grade", "completed"], 1e9)
    kpis = list(metrics.kpi_columns(1e9))
    for level, by in ((0, ["grade", "completed"]), (1, ["grade"]), (3, [])):
        part = got.where(F.col("totalLevel") == level).select(*by, *kpis)
        want = metrics.portfolio_kpis(notes, 1e9, by=by).select(*by, *kpis)
        as_set = lambda df: sorted(map(str, df.collect()))
        assert as_set(part) == as_set(want)
    total = got.where("totalLevel = 3").collect()
    assert len(total) == 1 and total[0]["grade"] is None


def test_rollup_tells_null_groups_from_subtotals(spark, ledger):
    notes = analyzed_notes(ledger).withColumn("grade", F.when(F.col("loanID") % 2 == 0, F.col("grade")))
    rows = metrics.portfolio_kpis_rollup(notes, ["grade"]).where("grade is null").collect()
    assert sorted(r["totalLevel"] for r in rows) == [0, 1]
    counts = {r["totalLevel"]: r["notes"] for r in rows}
    assert counts[1] == notes.count() and counts[0] == notes.where("grade is null").count()


def test_payments_reach_bucketed_notes_without_moving_them(spark, ledger, tmp_path):
    notes = note_summary(ledger.withColumn("loanID", F.when(F.col("loanID") % 50 != 0, F.col("loanID"))))
    save_notes(notes, "notes_by_loan", buckets=4, path=str(tmp_path / "notes"))
    try:
        paid = loan_transactions(ledger.where("year(datePaid) < 1996"))
        got = apply_to_table(spark, "notes_by_loan", paid)
        want = apply_transactions(notes, paid)
        assert got.columns == want.columns
        assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
        # The left side of the join reads the table's buckets and sorts; nothing is exchanged there.
        plan = _plan(got)
        left = plan[plan.index("SortMergeJoin"):]
        first_scan = re.search(r"FileScan|Scan parquet", left).start()
        assert "Exchange" not in left[:first_scan] and "notes_by_loan" in left[first_scan:first_scan + 2000]
        assert "Bucketed: true" in left
    finally:
        spark.sql("DROP TABLE notes_by_loan")

"""KPIs over notes that lack a value, sums before rounding, fresh reads, order and literals."""

from decimal import Decimal

from pyspark.sql import functions as F

from notewise.operators import datasets, metrics, selection
from notewise.operators.notes import apply_transactions, loan_transactions, note_summary, notes_with_transactions
from notewise.plans import portfolio
from notewise.sources.derived import derive_ledger, null_ledger
from notewise.sources.ledger import to_titles
from notewise.sources.schema import (
    GRADE_BAD_DEBT_RATES, PROGRESS_SERIES, WATERFALL_CATEGORIES, ledger_schema, title_map, waterfall_columns,
)


def _ledger(spark, rows):
    blank = {f.name: None for f in ledger_schema().fields}
    return spark.createDataFrame([tuple((blank | r).values()) for r in rows], ledger_schema())


def _line(**values):
    return {"loanID": 1, "company": "Acme", "loanName": "L", "interestRate": 12.0, "grade": "B"} | {
        k: Decimal(v) if isinstance(v, str) and k != "grade" else v for k, v in values.items()}


def test_unknown_grades_do_not_move_the_returns(spark, sf_small):
    notes = portfolio.analyzed_notes(derive_ledger(spark, sf_small))
    broken = F.col("loanID") % 97 == 0
    holes = notes.withColumns({c: F.when(~broken, F.col(c)) for c in (
        "badDebtFunds", "profits", "badDebtFundsReceived", "profitsReceived", "nextProfitsPayment", "profitsOutstanding")})
    got = metrics.portfolio_kpis(holes).first()
    rest = metrics.portfolio_kpis(notes.where(~broken)).first()
    for name in ("totalEarnings", "currentRoi", "netRoi"):
        assert got[name] == rest[name]
    lost = notes.where(broken)
    assert got["notesExcluded"] == lost.count() and rest["notesExcluded"] == 0
    assert got["principalExcluded"] == lost.agg(F.sum("principal")).first()[0]


def test_mean_skips_missing_amounts_and_cents_are_rounded_once(spark):
    rows = [_line(totalScheduled="100"), _line(totalScheduled="100"), _line()]
    assert note_summary(_ledger(spark, rows)).first()["unitPayment"] == 100.0
    rows = [_line(totalScheduled="10", interestScheduled="1", fees="0.004")] * 10
    assert note_summary(_ledger(spark, rows)).first()["fees"] == 0.04
    rows = [_line(totalScheduled="-0.01"), _line(totalScheduled="-0.02")]
    assert note_summary(_ledger(spark, rows)).first()["unitPayment"] == -0.02


def test_one_aggregate_equals_summary_joined_with_transactions(spark, sf_small):
    ledger = null_ledger(derive_ledger(spark, sf_small, faulty=True))
    joined = apply_transactions(note_summary(ledger), loan_transactions(ledger))
    fused = notes_with_transactions(ledger)
    assert fused.columns == joined.columns
    assert fused.exceptAll(joined).count() == 0 and joined.exceptAll(fused).count() == 0


def test_notes_with_transactions_reads_lineitem_for_one_ledger(spark, sf_small):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    once = plan(portfolio.QUERIES["rebuild_notes"](spark, sf_small)).count("FileScan")
    assert plan(portfolio.QUERIES["notes_with_transactions"](spark, sf_small)).count("FileScan") == once


def test_new_files_are_read(spark, sf_small, tmp_path):
    for name in ("lineitem", "orders", "customer"):
        spark.read.parquet(f"{sf_small}/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    before = portfolio.QUERIES["ledger"](spark, str(tmp_path)).count()
    spark.read.parquet(f"{sf_small}/lineitem.parquet").limit(500).write.mode("append").parquet(
        str(tmp_path / "lineitem.parquet"))
    assert portfolio.QUERIES["ledger"](spark, str(tmp_path)).count() == before + 500


def _in_order(rows, keys):
    def key(row):
        return [(row[c] is not None, row[c] if asc else -row[c]) for c, asc in keys]
    return all(key(a) <= key(b) for a, b in zip(rows, rows[1:]))


def test_presets_order_rows_with_the_whole_key_last(spark, sf_small):
    notes = portfolio.analyzed_notes(derive_ledger(spark, sf_small, faulty=True))
    ties = [(k, True) for k in ("loanID", "company", "loanName", "interestRate", "grade")]
    app = [("principal", True), ("interestRate", True)]
    assert _in_order(selection.order_notes(notes, "app").collect(), app + ties)
    notebook = [("feesPaid", True), ("principal", True), ("principalOutstanding", False), ("interestRate", True),
                ("cyclesTotal", True)]
    assert _in_order(selection.top_notes(notes, 50, "notebook").collect(), notebook + ties)


def test_remainder_row_holds_what_other_grades_have(spark, sf_small):
    notes = note_summary(derive_ledger(spark, sf_small, faulty=True))
    by_grade = datasets.grade_distribution(notes, remainder=True)
    assert by_grade.count() == 11
    total = by_grade.agg(F.sum("principal")).first()[0]
    assert abs(total - notes.agg(F.sum("principal")).first()[0]) < 0.01
    assert by_grade.where("grade = 'other' and gradeOrder = 10").first()["principal"] > 0


def test_kpi_text(spark):
    df = spark.createDataFrame([(1234.565, 12.25, -0.05)], "totalEarnings double, currentRoi double, netRoi double")
    assert tuple(metrics.kpi_text(df).first()) == ("$1,234.57", "12.3%", "-0.1%")


def test_titles_are_these(spark, sf_small):
    assert to_titles(derive_ledger(spark, sf_small)).columns == [
        "Payment Type", "Loan Id", "Company", "Loan Name", "Interest Rate", "Risk Band", "Interest Scheduled",
        "Principal Scheduled", "Total Scheduled", "Interest Owed", "Principal Owed", "Total Owed", "Interest Paid",
        "Principal Paid", "Total Paid", "Fees Paid to Loop", "Due Date", "Date Paid", "Status"]
    assert (title_map()["Loan Id"], title_map()["Risk Band"], title_map()["Fees Paid to Loop"]) == ("loanID", "grade", "fees")
    assert dict(GRADE_BAD_DEBT_RATES) == {"A+": 0.56, "A": 1.83, "B+": 3.05, "B": 4.32, "C+": 5.46, "C": 6.25,
                                         "D+": 7.11, "D": 8.0, "E+": 8.84, "E": 9.64}
    assert WATERFALL_CATEGORIES == ["fees", "principal", "badDebtFunds", "profits"]
    assert [n for _, n, _ in PROGRESS_SERIES][::3] == ["Fees Paid", "Principal Received", "Bad Debt Funds Received",
                                                       "Profits Received"]
    assert waterfall_columns()[:3] == ["feesPaid", "nextFeesPayment", "feesOutstanding"]

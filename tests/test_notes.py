"""Note summary, payment application and data quality."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from notewise.operators import quality
from notewise.operators.notes import (
    apply_transactions, loan_transactions, note_summary, notes_with_transactions, rebuild_notes,
)
from notewise.sources.derived import derive_ledger
from notewise.sources.schema import ledger_schema


def _ledger(spark, rows):
    """rows: (loanID, company, grade, rate, totalScheduled, interest, fees, dueDate, datePaid)."""
    full = []
    for loan, company, grade, rate, tot, interest, fees, due, paid in rows:
        d = lambda x: Decimal(str(x))
        full.append(("Scheduled", loan, company, f"Loan {loan}", rate, grade, d(interest),
                     d(tot - interest), d(tot), d(0), d(0), d(0), d(0), d(0),
                     d(tot if paid else 0), d(fees), due, paid, "x"))
    return spark.createDataFrame(full, ledger_schema())


D = dt.date


def test_note_summary_small(spark):
    rows = [(7, "Acme", "B", 12.0, 100.0, 5.0, 1.0, D(2019, 3, 31), D(2019, 3, 31)),
            (7, "Acme", "B", 12.0, 100.0, 4.0, 1.0, D(2019, 4, 30), None),
            (7, "Acme", "B", 12.0, 100.01, 3.0, 1.0, D(2019, 5, 31), None)]
    n = note_summary(_ledger(spark, rows)).first()
    assert n["cyclesTotal"] == 3 and n["cyclesRemaining"] == 3
    assert n["fees"] == 3.0 and n["unitPayment"] == 100.0
    assert n["startDate"] == D(2019, 2, 28)
    i = 12.0 / 1200
    assert n["principal"] == round(100.0 / i * (1 - 1 / (1 + i) ** 3))
    assert n["profits"] == pytest.approx(12.0 - 3.0 - n["badDebtFunds"], abs=1e-9)
    r = rebuild_notes(_ledger(spark, rows)).first()
    assert r["amountRepayed"] == 100.0 and r["cyclesRemaining"] == 2


def test_unknown_grade_and_zero_rate_do_not_fail(spark):
    rows = [(1, "A", "Z", 12.0, 10.0, 1.0, 0.1, D(2019, 1, 1), None),
            (2, "B", "A", 0.0, 10.0, 0.0, 0.1, D(2019, 1, 1), None)]
    out = {r["loanID"]: r for r in note_summary(_ledger(spark, rows)).collect()}
    assert out[1]["badDebtFunds"] is None
    assert out[2]["principal"] == 10.0


def test_join_path_equals_one_pass(spark, sf_small):
    led = derive_ledger(spark, sf_small)
    a = notes_with_transactions(led)
    b = rebuild_notes(led)
    assert a.count() == b.count()
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_apply_transactions_is_additive(spark, sf_small):
    led = derive_ledger(spark, sf_small)
    notes = note_summary(led)
    early = led.filter(F.col("dueDate") < "1998-01-01")
    late = led.filter(F.col("dueDate") >= "1998-01-01")
    step = apply_transactions(apply_transactions(notes, loan_transactions(early)),
                              loan_transactions(late))
    once = apply_transactions(notes, loan_transactions(led))
    key = ["loanID"]
    s = step.select(*key, F.round("amountRepayed", 2).alias("a"), "cyclesRemaining")
    o = once.select(*key, F.round("amountRepayed", 2).alias("a"), "cyclesRemaining")
    assert s.exceptAll(o).count() == 0 and o.exceptAll(s).count() == 0


def test_dq_report_on_faulty_ledger(spark, sf_small):
    notes = note_summary(derive_ledger(spark, sf_small, faulty=True))
    report = {r["rule"]: r["violations"] for r in quality.dq_report(notes).collect()}
    for rule in ["unknown_grade", "negative_profits", "zero_unit_payment", "zero_rate",
                 "zero_principal", "duplicate_loan"]:
        assert report[rule] > 0, rule
    assert report["negative_fees"] == 0
    viol = quality.dq_note_violations(notes)
    assert viol.filter(F.array_contains("violations", "unknown_grade")).count() == report["unknown_grade"]
    dups = quality.dq_duplicate_loans(notes).collect()
    assert len(dups) == report["duplicate_loan"] and all(d["noteKeys"] == 2 for d in dups)


def test_dq_report_clean_ledger_is_zero(spark, sf_small):
    notes = note_summary(derive_ledger(spark, sf_small))
    report = {r["rule"]: r["violations"] for r in quality.dq_report(notes).collect()}
    assert len(report) == 10 and set(report.values()) == {0}


def test_payment_types_filter(spark):
    rows = [(7, "Acme", "B", 12.0, 100.0, 5.0, 1.0, D(2019, 3, 31), D(2019, 3, 31)),
            (7, "Acme", "B", 12.0, 100.0, 4.0, 1.0, D(2019, 4, 30), None)]
    led = _ledger(spark, rows)
    late_fee = led.limit(1).withColumn("paymentType", F.lit("Late Fee"))
    both = led.unionByName(late_fee)
    assert note_summary(both).first()["cyclesTotal"] == 3
    assert note_summary(both, payment_types=["Scheduled"]).first()["cyclesTotal"] == 2
    assert rebuild_notes(both, payment_types=["Scheduled"]).first()["cyclesRemaining"] == 1
    assert loan_transactions(both, payment_types=["Scheduled"]).first()["numPayments"] == 1

"""A loan holding a third of all ledger rows: exact results, partial aggregation first."""

from decimal import Decimal

from pyspark.sql import functions as F

from notewise.operators.notes import rebuild_notes
from notewise.plans.portfolio import analyzed_notes
from notewise.sources.derived import derive_ledger


def test_hot_loan_is_exact(spark, sf_small):
    ledger = derive_ledger(spark, sf_small)
    n = ledger.count()
    hot = ledger.filter(F.col("loanID") == 1).limit(1)
    copies = hot.select("*", F.explode(F.array_repeat(F.lit(1), n // 2)).alias("_"))
    skewed = ledger.unionByName(copies.drop("_"))
    rows = skewed.filter(F.col("loanID") == 1).collect()
    note = rebuild_notes(skewed).filter(F.col("loanID") == 1).first()
    assert note["cyclesTotal"] == len(rows)
    paid = sum((r["totalPaid"] for r in rows if r["datePaid"] is not None), Decimal(0))
    assert note["amountRepayed"] == float(paid)
    assert note["cyclesRemaining"] == sum(r["datePaid"] is None for r in rows)
    assert analyzed_notes(skewed).count() == analyzed_notes(ledger).count()


def test_note_aggregate_combines_before_the_shuffle(spark, sf_small, tmp_path):
    from notewise.sources.ledger import read_ledger, write_ledger

    write_ledger(derive_ledger(spark, sf_small), str(tmp_path / "pq"))
    df = rebuild_notes(read_ledger(spark, str(tmp_path / "pq"), fmt="parquet"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    below_exchange = plan.split("Exchange hashpartitioning", 1)[1]
    assert "partial_sum" in below_exchange and "partial_count" in below_exchange

"""Stored notes: batches are applied exactly once, also when a run is cut short."""

import os

import pytest
from pyspark.sql import functions as F

from notewise.operators.notes import apply_transactions, loan_transactions, note_summary
from notewise.sources import notestore
from notewise.sources.derived import derive_ledger


@pytest.fixture()
def ledger(spark, sf_small):
    return derive_ledger(spark, sf_small).where("loanID < 3000").withColumn("batchId", F.year("datePaid").cast("string"))


def _same(store, ledger, notes):
    want = apply_transactions(notes, loan_transactions(ledger)).withColumn("amountRepayed", F.round("amountRepayed", 2))
    got = store.select(*want.columns)
    return got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def _files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(f"{path}/notes") for f in names if f.endswith(".parquet")}


def test_batches_apply_once(spark, ledger, tmp_path):
    path, notes = str(tmp_path / "store"), note_summary(ledger)
    notestore.create_store(notes, path, buckets=8)
    assert notestore.apply_payments(spark, path, ledger.where("batchId <= '1997'")) == 3
    assert _same(notestore.read_notes(spark, path), ledger.where("batchId <= '1997'"), notes)
    before = _files(path)
    assert notestore.apply_payments(spark, path, ledger.where("batchId <= '1997'")) == 0  # the same again
    assert _files(path) == before
    assert notestore.apply_payments(spark, path, ledger) > 0  # old and new batches together
    assert _same(notestore.read_notes(spark, path), ledger, notes)
    log = notestore.read_log(spark, path).collect()
    assert len({r.batchId for r in log}) == len(log) and sum(r.payments for r in log) == ledger.where("datePaid is not null").count()


def test_only_touched_buckets_are_rewritten(spark, ledger, tmp_path):
    path = str(tmp_path / "store")
    notestore.create_store(note_summary(ledger), path, buckets=16)
    before = _files(path)
    loan = ledger.where("datePaid is not null").agg(F.min("loanID")).first()[0]
    assert notestore.apply_payments(spark, path, ledger.where(F.col("loanID") == loan).withColumn("batchId", F.lit("one"))) == 1
    gone = before - _files(path)
    assert len({os.path.dirname(f) for f in gone}) == 1 and len(before) - len(gone) >= 10


@pytest.mark.parametrize("where", ["before the log", "after the log", "half published"])
def test_a_run_cut_short(spark, ledger, tmp_path, monkeypatch, where):
    path, notes = str(tmp_path / "store"), note_summary(ledger)
    notestore.create_store(notes, path, buckets=4)
    publish = notestore._publish

    def fail(spark, path, run):
        if where == "half published":
            some = spark.read.parquet(f"{path}/pending").where("bucket < 2")
            some.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{path}/notes")
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        if where == "before the log":
            m.setattr(notestore, "apply_transactions", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        else:
            m.setattr(notestore, "_publish", fail)
        with pytest.raises(RuntimeError):
            notestore.apply_payments(spark, path, ledger)
    assert notestore._publish is publish
    again = notestore.apply_payments(spark, path, ledger)
    assert (again > 0) == (where == "before the log")
    assert _same(notestore.read_notes(spark, path), ledger, notes)


def test_unknown_loans_and_missing_ids(spark, ledger, tmp_path):
    path = str(tmp_path / "store")
    kept = ledger.where("loanID % 5 <> 0")
    notestore.create_store(note_summary(kept), path, buckets=4)
    nobody = ledger.withColumn("loanID", F.lit(None).cast("long")).limit(50)
    notestore.apply_payments(spark, path, ledger.unionByName(nobody))
    lost = ledger.where("loanID % 5 = 0 and datePaid is not null").count() + nobody.where("datePaid is not null").count()
    assert sum(r.unmatchedPayments for r in notestore.read_log(spark, path).collect()) == lost
    with pytest.raises(ValueError):
        notestore.apply_payments(spark, path, ledger.withColumn("batchId", F.lit(None).cast("string")))
    assert _same(notestore.read_notes(spark, path), kept, note_summary(kept))


def test_known_batches_are_left_out_before_the_shuffle(spark, ledger, tmp_path, monkeypatch):
    """No exchange deals payments out by batch id, of which there are few."""
    path, plans = str(tmp_path / "store"), []
    notestore.create_store(note_summary(ledger), path, buckets=4)
    assert notestore.apply_payments(spark, path, ledger.where("batchId <= '1997'")) == 3
    writer = type(spark.range(1).write)
    parquet = writer.parquet

    def watched(self, target, *args, **more):
        if "/payments/run=" in target:
            plans.append(self._df._jdf.queryExecution().executedPlan().toString())
        return parquet(self, target, *args, **more)

    monkeypatch.setattr(writer, "parquet", watched)
    assert notestore.apply_payments(spark, path, ledger.where("batchId <= '1997'")) == 0
    assert len(plans) == 1 and "BroadcastHashJoin" in plans[0] and "SortMergeJoin [batchId" not in plans[0]
    monkeypatch.setattr(notestore, "BROADCAST_IDS", 0)  # a log of many batches
    assert notestore.apply_payments(spark, path, ledger) > 0
    assert _same(notestore.read_notes(spark, path), ledger, note_summary(ledger))

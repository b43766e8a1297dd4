"""KPIs from running totals equal the batch KPIs after every micro-batch."""

import datetime as dt
import os
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from notewise.operators import metrics
from notewise.plans.portfolio import analyzed_notes
from notewise.sources.derived import derive_ledger, null_ledger
from notewise.sources.schema import ledger_schema
from notewise.streaming.kpis import kpis_at, start_kpi_stream

FUNDS = 5_000_000_000.0


def _start(spark, tmp_path, by):
    return start_kpi_stream(spark, str(tmp_path / "src"), str(tmp_path / "out"), str(tmp_path / "ck"), by=by, max_files_per_trigger=1)


def _seen(spark, tmp_path, upto):
    """The ledger rows of the batches up to ``upto``."""
    return spark.read.parquet(*[str(tmp_path / f"out/work/batchId={k}/rows") for k in range(upto + 1)]).where("not state")


def _close(got, want, by):
    number = lambda r: tuple(str(r[c]) for c in by)
    got, want = sorted(got, key=number), sorted(want, key=number)
    assert [number(r) for r in got] == [number(r) for r in want]
    for a, b in zip(got, want, strict=True):
        assert set(a.asDict()) == set(b.asDict())
        for c in a.asDict():
            if c not in by:
                assert a[c] == pytest.approx(b[c], abs=1.01e-4, nan_ok=True) if a[c] is not None else b[c] is None, c


@pytest.mark.parametrize("by", [["grade"], []])
def test_every_batch_equals_the_batch_job(spark, sf_small, tmp_path, by):
    ledger = derive_ledger(spark, sf_small, faulty=True).where("loanID < 2500")
    if by:
        ledger = null_ledger(ledger)
    ledger.repartitionByRange(4, F.xxhash64("dueDate", "loanID")).write.parquet(str(tmp_path / "src"))
    _start(spark, tmp_path, by).awaitTermination()
    for batch in range(4):
        want = metrics.portfolio_kpis(analyzed_notes(_seen(spark, tmp_path, batch)), FUNDS, by=by).collect()
        _close(kpis_at(spark, str(tmp_path / "out"), FUNDS, batch).collect(), want, by)
    assert _seen(spark, tmp_path, 3).count() == ledger.count()
    # A batch costs its own rows and notes: two versions of each note at most.
    rows = spark.read.parquet(str(tmp_path / "out/work/batchId=3/rows"))
    versions = spark.read.parquet(str(tmp_path / "out/work/batchId=3/versions"))
    assert versions.count() <= 2 * rows.where("state").count() < 2 * ledger.select("loanID").distinct().count()


def test_a_batch_run_again_changes_nothing(spark, sf_small, tmp_path):
    derive_ledger(spark, sf_small).where("loanID < 800").repartitionByRange(3, "dueDate").write.parquet(str(tmp_path / "src"))
    _start(spark, tmp_path, ["grade"]).awaitTermination()
    out = str(tmp_path / "out")
    before = sorted(map(str, kpis_at(spark, out, FUNDS).collect()))
    for name in ("2", ".2.crc"):  # the last batch was not committed
        os.remove(tmp_path / "ck" / "commits" / name)
    _start(spark, tmp_path, ["grade"]).awaitTermination()
    assert sorted(map(str, kpis_at(spark, out, FUNDS).collect())) == before


def test_the_largest_principal_may_shrink(spark, tmp_path):
    d = lambda x: Decimal(str(x))
    line = lambda loan, total: ("Scheduled", loan, "A", "L", 240.0, "A", d(1), d(1), d(total), d(0), d(0), d(0), d(0), d(0), d(0), d(0),
                                dt.date(2020, 1, 1), None, "x")
    frame = lambda *lines: spark.createDataFrame(list(lines), ledger_schema()).coalesce(1)
    src = str(tmp_path / "src")
    frame(line(1, 1000), line(2, 960)).write.parquet(src)
    _start(spark, tmp_path, []).awaitTermination()
    frame(line(1, 1)).write.mode("append").parquet(src)  # two instalments of 500.5 on average are worth less
    _start(spark, tmp_path, []).awaitTermination()
    frame(line(3, 5000)).write.mode("append").parquet(src)
    _start(spark, tmp_path, []).awaitTermination()
    out = str(tmp_path / "out")
    largest = [spark.read.parquet(f"{out}/totals").where(F.col("batchId") == k).first().largest for k in range(3)]
    assert largest == [833.0, 800.0, 4167.0]
    _close(kpis_at(spark, out).collect(), metrics.portfolio_kpis(analyzed_notes(_seen(spark, tmp_path, 2))).collect(), [])


def test_no_rows(spark, tmp_path):
    spark.createDataFrame([], ledger_schema()).write.parquet(str(tmp_path / "src"))
    _start(spark, tmp_path, ["grade"]).awaitTermination()
    assert kpis_at(spark, str(tmp_path / "out"), FUNDS).count() == 0

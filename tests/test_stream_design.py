"""The stream's settings stay in its own session; newest versions come from hash aggregates."""

import glob

import pytest

from notewise.plans.portfolio import QUERIES
from notewise.session import checkpoint_dir
from notewise.sources.derived import derive_ledger
from notewise.sources.ledger import write_ledger
from notewise.streaming.payments import compact_notes, latest_notes, start_note_stream


def test_stream_session_rocksdb_formats_and_compaction(spark, sf_small, tmp_path):
    ledger = derive_ledger(spark, sf_small).where("loanID < 300")
    src, out = str(tmp_path / "csv"), str(tmp_path / "out")
    text = ledger.selectExpr("* except (dueDate)", "date_format(dueDate, 'dd/MM/yyyy') as dueDate").select(*ledger.columns)
    write_ledger(text.withColumn("datePaid", text.datePaid.cast("string")).coalesce(1), src, fmt="csv")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    q = start_note_stream(spark, src, out, fmt="csv", checkpoint=str(tmp_path / "ck"), state_partitions=3,
                          date_format=["dd/MM/yyyy", "yyyy-MM-dd"])
    assert spark.conf.get("spark.sql.shuffle.partitions") == before
    q.awaitTermination()
    state = q.lastProgress["stateOperators"][0]
    assert state["numShufflePartitions"] == 3 and any("rocksdb" in k for k in state["customMetrics"])
    newest = latest_notes(spark, out)
    assert newest.where("startDate is null").count() == 0
    plan = newest._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "Sort [" not in plan
    assert compact_notes(spark, out, str(tmp_path / "compact")) == 0
    assert spark.read.parquet(str(tmp_path / "compact")).count() == newest.count()


@pytest.mark.parametrize("name", ["analyzed_notes_stream", "portfolio_kpis_stream"])
def test_stores_and_files_follow_the_data(spark, sf_small, name):
    """A session of 200 shuffle partitions does not open 200 state stores for a small ledger."""
    wide = spark.newSession()
    wide.conf.set("spark.sql.shuffle.partitions", "200")
    runs = lambda: set(glob.glob(f"{checkpoint_dir(spark).removeprefix('file:')}/notewise-*-run-*"))
    before = runs()
    assert not QUERIES[name](wide, sf_small).isEmpty()
    [run] = runs() - before
    assert len(glob.glob(f"{run}/checkpoint/state/0/[0-9]*")) == spark.sparkContext.defaultParallelism < 200
    assert len(glob.glob(f"{run}/ledger/*.parquet")) <= spark.sparkContext.defaultParallelism

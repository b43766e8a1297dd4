"""Plan shape: one hash exchange ledger -> notes, no Python workers, pushdown."""

import re

import pytest

from notewise.operators import datasets, metrics
from notewise.operators.notes import rebuild_notes
from notewise.plans.portfolio import analyzed_notes
from notewise.sources.derived import derive_ledger
from notewise.sources.ledger import read_ledger, write_ledger


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def parquet_ledger(spark, sf_small, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("ledger") / "pq")
    write_ledger(derive_ledger(spark, sf_small), path, fmt="parquet")
    return path


def test_one_hash_exchange_ledger_to_analyzed_notes(spark, parquet_ledger):
    df = analyzed_notes(read_ledger(spark, parquet_ledger, fmt="parquet"))
    plan = _plan(df)
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 1, plan
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def test_all_kpis_in_one_aggregate(spark, parquet_ledger):
    df = metrics.portfolio_kpis(analyzed_notes(read_ledger(spark, parquet_ledger, fmt="parquet")), 1e6)
    plan = _plan(df)
    # the note aggregate + the KPI aggregate (one final HashAggregate each)
    assert len(re.findall(r"Exchange", plan.replace("BroadcastExchange", ""))) <= 2, plan


def test_grade_filter_reaches_the_scan(spark, parquet_ledger):
    an = analyzed_notes(read_ledger(spark, parquet_ledger, fmt="parquet"))
    plan = _plan(datasets.progress_series(an, "C"))
    assert "PushedFilters: [IsNotNull(grade), EqualTo(grade,C)]" in plan, plan


def test_scan_reads_only_needed_columns(spark, parquet_ledger):
    df = rebuild_notes(read_ledger(spark, parquet_ledger, fmt="parquet")).select("loanID", "fees")
    plan = _plan(df)
    scanned = re.search(r"FileScan parquet \[([^\]]*)\]", plan).group(1)
    assert "status" not in scanned and "interestOwed" not in scanned, scanned
    assert "fees" in scanned


def test_progress_series_adds_no_shuffle(spark, parquet_ledger):
    an = analyzed_notes(read_ledger(spark, parquet_ledger, fmt="parquet"))
    plan = _plan(datasets.progress_series(an))
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 1


def test_derived_ledger_note_aggregate_reuses_join_partitioning(spark, sf_small):
    # the session (local_session) broadcasts nothing by estimate, as on a cluster
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == "-1"
    plan = _plan(rebuild_notes(derive_ledger(spark, sf_small)))
    # On the order key: lineitem rows, lines per order, orders, and the order-level result
    # (re-shuffled after the customer join, so that AQE can split a hot order). The note
    # aggregate adds no exchange of its own (it reuses the join's partitioning).
    assert len(re.findall(r"Exchange hashpartitioning\(l_orderkey", plan)) == 4, plan
    assert "hashpartitioning(loanID" not in plan

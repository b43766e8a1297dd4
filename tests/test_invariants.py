"""Waterfall invariants on random notes, and KPI consistency across groupings."""

import random

import pytest
from pyspark.sql import functions as F

from notewise.operators import metrics
from notewise.operators.waterfall import waterfall
from notewise.plans.portfolio import analyzed_notes
from notewise.sources.derived import derive_ledger
from notewise.sources.schema import WATERFALL_CATEGORIES as CATS
from notewise.sources.schema import next_column, outstanding_column, received_column

SCHEMA = "fees DOUBLE, principal DOUBLE, badDebtFunds DOUBLE, profits DOUBLE, " \
         "unitPayment DOUBLE, amountRepayed DOUBLE"


@pytest.fixture(scope="module")
def random_notes(spark):
    rng = random.Random(7)
    rows = []
    for _ in range(2000):
        cats = [rng.randint(0, 50_000) / 100 for _ in CATS]
        total = sum(cats)
        unit = rng.randint(1, 20_000) / 100
        paid = rng.choice([0.0, total, total + rng.randint(0, 5000) / 100,
                           rng.randint(0, int(total * 100) + 1) / 100])
        rows.append((*cats, unit, paid))
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("cap", [False, True])
def test_waterfall_invariants(random_notes, cap):
    for r in waterfall(random_notes, cap_spillover=cap).collect():
        total_received = 0.0
        total_next = 0.0
        for c in CATS:
            size, rec = r[c], r[received_column(c)]
            nxt, out = r[next_column(c)], r[outstanding_column(c)]
            assert -1e-9 <= rec <= size + 1e-9
            assert -1e-9 <= out <= size + 1e-9
            assert 0 <= nxt <= r["unitPayment"] + 1e-9
            total_received += rec
            total_next += nxt
        total = sum(r[c] for c in CATS)
        assert total_received == pytest.approx(min(r["amountRepayed"], total), abs=1e-6)
        if cap:
            assert total_next <= r["unitPayment"] + 1e-6
            remaining = max(0.0, total - r["amountRepayed"])
            assert total_next == pytest.approx(min(r["unitPayment"], remaining), abs=1e-6)


def test_kpis_by_grade_reaggregate_to_global(spark, sf_small):
    an = analyzed_notes(derive_ledger(spark, sf_small))
    glob = metrics.portfolio_kpis(an, 1e6).first()
    per = metrics.portfolio_kpis(an, 1e6, by=["grade"])
    agg = per.agg(F.sum("notes").alias("n"), F.round(F.sum("totalEarnings"), 2).alias("e")).first()
    assert agg["n"] == glob["notes"]
    assert agg["e"] == pytest.approx(glob["totalEarnings"], abs=1e-6)
    w = metrics.weighted_avg(an, "interestRate", "principal").first()[0]
    direct = an.agg((F.sum(F.col("interestRate") * F.col("principal")) / F.sum("principal"))).first()[0]
    assert w == pytest.approx(direct)

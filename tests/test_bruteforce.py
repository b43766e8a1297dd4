"""The waterfall and progress columns against a plain-Python model on random notes."""

import math
import random

import pytest

from notewise.operators.waterfall import note_progress, waterfall
from notewise.sources.schema import WATERFALL_CATEGORIES as CATS
from notewise.sources.schema import next_column, outstanding_column, received_column

SCHEMA = ("loanID BIGINT, fees DOUBLE, principal DOUBLE, badDebtFunds DOUBLE, profits DOUBLE, "
          "unitPayment DOUBLE, amountRepayed DOUBLE, cyclesRemaining BIGINT")


def _clamp(x, lo, hi):
    return max(lo, min(x, hi))


def model(row, cap):
    """Per-note waterfall in integer cents, written from the definition."""
    a, u = round(row["amountRepayed"] * 100), round(row["unitPayment"] * 100)
    out, prefix = {}, 0
    for c in CATS:
        size = round(row[c] * 100)
        rel = a - prefix
        rec = _clamp(rel, 0, size)
        if cap:
            nxt = max(0, min(a + u, prefix + size) - max(a, prefix))
        elif rel < 0:
            nxt = _clamp(u + rel, 0, u)
        else:
            nxt = min(_clamp(size - rel, 0, size), u)
        outst = _clamp(size - (rel + u), 0, size)
        out[received_column(c)] = rec / 100
        out[next_column(c)] = nxt / 100
        out[outstanding_column(c)] = outst / 100
        prefix += size
    owed = round(out["nextPrincipalPayment"] * 100) + round(out["principalOutstanding"] * 100)
    out["monthsToBreakeven"] = None if u == 0 else math.ceil(owed / u)
    out["completed"] = row["cyclesRemaining"] == 0
    return out


@pytest.mark.parametrize("cap", [False, True])
def test_waterfall_matches_model(spark, cap):
    rng = random.Random(11 + cap)
    rows = []
    for i in range(3000):
        sizes = [rng.choice([0, rng.randint(1, 300_000)]) / 100 for _ in CATS]
        unit = rng.choice([0, rng.randint(1, 50_000)]) / 100
        total = sum(sizes)
        paid = rng.choice([0.0, round(total, 2), rng.randint(0, int(total * 100) + 5000) / 100])
        rows.append((i, *sizes, unit, paid, rng.randint(0, 3)))
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r["loanID"]: r.asDict() for r in note_progress(waterfall(df, cap_spillover=cap)).collect()}
    for r in rows:
        row = dict(zip(["loanID", *CATS, "unitPayment", "amountRepayed", "cyclesRemaining"], r))
        expected = model(row, cap)
        actual = got[row["loanID"]]
        assert {k: actual[k] for k in expected} == expected, row

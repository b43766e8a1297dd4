"""Hard-negative mining against a plain computation over all pairs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from notewise.llm import hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int, uid string, chunk int"
INF = float("inf")


def _plain(rows, positives, negatives, low, high, modulus):
    sound = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in rows
             if v is not None and label is not None and all(x is not None and math.isfinite(x) for x in v)]
    number = lambda i: (i is None, i or 0)
    out = []
    for at, (anchor, v, label) in enumerate(sound):
        if anchor is None or anchor % modulus:
            continue
        scored = sorted(((sum(a * b for a, b in zip(v, w, strict=False)), i, other) for k, (i, w, other) in enumerate(sound) if k != at),
                        key=lambda r: (-r[0], number(r[1])))
        for top, positive, _ in [r for r in scored if r[2] == label][:positives]:
            fits = [r for r in scored if r[2] != label and low * top <= 100 * r[0] <= high * top]
            out += [(anchor, positive, k, i, top, s) for k, (s, i, _) in enumerate(fits[:negatives], 1)]
    return out


def _rows(seed, n):
    rng = random.Random(seed)
    centre = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(3)]
    # Multiples of 1/8: floats hold them exactly, and many scores tie.
    vector = lambda: [round(8 * (x + rng.gauss(0, 0.4))) / 8 for x in rng.choice(centre)]
    rows = [(i, vector(), 0 if rng.random() < 0.5 else rng.randrange(4)) for i in range(n)]
    rows += [(100, vector(), 1), (100, rows[100][1], 1), (101, rows[3][1], 2), (None, vector(), 0), (None, vector(), 1),
             (400, None, 1), (401, [0.5, None], 1), (402, [INF] * 6, 1), (403, [float("nan")] * 6, 1), (404, [1.0] * 6, None),
             (500, [], 1), (600, [1.0, 2.0], 0), (700, [0.0] * 6, 2), (800, [-9.0] * 6, 3)]
    return rows


@pytest.mark.parametrize("rows_per_task, anchors_per_task", [(8192, 4096), (40, 3)])
@pytest.mark.parametrize("positives, negatives, low, high", [(5, 5, 80, 100), (2, 3, 50, 90)])
def test_against_all_pairs(spark, monkeypatch, rows_per_task, anchors_per_task, positives, negatives, low, high):
    monkeypatch.setattr(hard_negatives, "ROWS_PER_TASK", rows_per_task)
    monkeypatch.setattr(hard_negatives, "ANCHORS_PER_TASK", anchors_per_task)
    rows = _rows(positives, 300)
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    got = hard_negatives.mine(hard_negatives.prepare(table, F.col("vec_id") % 20 == 0, F.col("label")),
                              positives, negatives, low, high).collect()
    want = _plain(rows, positives, negatives, low, high, 20)
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str) and len(want) > 100


def test_empty_and_lonely(spark):
    table = spark.createDataFrame([(0, [1.0], 1, "x", 1)], SCHEMA)
    mine = lambda t: hard_negatives.mine(hard_negatives.prepare(t, F.col("vec_id") % 100 == 0, F.col("label")))
    assert mine(table).count() == 0 and mine(table.where("false")).count() == 0
    with pytest.raises(ValueError):
        hard_negatives.mine(table, low=80, high=120)


def test_stream_keeps_open_windows_only():
    def pairs():
        yield 1, 100, 1000, 0, 7
        for k in range(100_000):
            yield 1, 100, 1000 - k // 1000, 1, k
        yield 2, 200, 5, 1, 3  # an anchor without a positive
    assert list(hard_negatives.windows(pairs(), 2, 5, 80, 100)) == [(100, 7, 1, 0, 1000, 1000), (100, 7, 2, 1, 1000, 1000)]


def test_scores_beyond_doubles_are_exact():
    import numpy as np
    a = np.array([[2 ** 30 + 1, 3]]), np.array([[2 ** 31 + 1, 5], [1, 1]])
    assert hard_negatives._scores(*a).tolist() == [[(2 ** 30 + 1) * (2 ** 31 + 1) + 15, 2 ** 30 + 4]]

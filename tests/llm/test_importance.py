"""Importance resampling against a plain computation."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from notewise.llm import importance


def _features(text, longest):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return words, [" ".join(words[i:i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def _plain(rows, target, longest, percent, min_words, buckets=10_000):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(bucket(f) for _, t in rows for f in _features(t, longest)[1])
    t = Counter(bucket(f) for x in target for f in _features(x, longest)[1])
    size_s, size_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (size_s + buckets) / ((s[b] + 1) * (size_t + buckets))))
    out, fit = [], []
    for doc_id, text in rows:
        words, found = _features(text, longest)
        weight = sum(gain(bucket(f)) for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        if len(words) >= min_words:
            fit.append((-score, doc_id is None, doc_id or 0, len(found), weight, len(out)))
        out.append([doc_id, len(found), weight, score, None])
    for rank, row in enumerate(sorted(fit)[:percent * len(fit) // 100], 1):
        out[row[-1]][4] = rank
    return out


def _key(rows):
    return sorted([tuple(r) for r in rows], key=lambda r: tuple((x is None, x or 0) for x in r))


@pytest.mark.parametrize("longest, percent, min_words", [(1, 10, 20), (3, 40, 2)])
def test_against_plain_computation(spark, make_docs, longest, percent, min_words):
    rng = random.Random(longest)
    words = [f"w{i}" for i in range(300)] + ["É", "ça", "x" * 60, "日本", "a-b", "don't", "X9"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(60)))) for i in range(400)]
    rows += [(900, None), (901, ""), (902, " .,- "), (None, "null id " * 30), (None, "null id " * 30), (None, "other " * 25),
             (5, rows[5][1]), (5, rows[5][1]), (903, "Z" * 200_000), (904, "deep " * 40_000), (905, "a" * 48 + " " + "b" * 49)]
    target = [" ".join(rng.choice(words[:40]) for _ in range(30)) for _ in range(8)] + [None]
    docs = make_docs(rows, extra="1 as n;2 as bucket;3 as score")
    bench = spark.createDataFrame([(i, x) for i, x in enumerate(target)], "item_id long, text string")
    got = importance.resample(docs, bench, longest=longest, percent=percent, min_words=min_words).collect()
    assert _key(got) == _key(_plain(rows, target, longest, percent, min_words))


def test_ties_and_empty_tables(spark, make_docs):
    docs = make_docs([(1, "x y")])
    bench = spark.createDataFrame([], "item_id long, text string")
    assert importance.resample(docs.where("false"), bench).count() == 0
    assert _key(importance.resample(docs, bench, min_words=1, percent=100).collect()) == _key(_plain([(1, "x y")], [], 1, 100, 1))
    scored = spark.createDataFrame([(i, 30, 30, 5, 7) for i in [9, 3, 3, None, 4]] + [(1, 30, 30, 5, 6), (2, 3, 3, 9, 99)],
                                   "doc_id long, n_words long, n_features long, weight long, score long")
    ranks = [(r.doc_id, r["rank"]) for r in importance.draw(scored, percent=84).collect()]
    assert sorted(ranks, key=str) == sorted([(3, 1), (3, 2), (4, 3), (9, 4), (None, 5), (1, None), (2, None)], key=str)


def test_bit_slices_are_exact():
    rng = np.random.default_rng(3)
    gains = rng.integers(-9000, 9000, 10_000)
    gains[:3] = [0, -8192, 8191]
    counts = rng.poisson(0.05, (70, 10_000)) * rng.integers(0, 3000, (70, 1))
    assert (importance.gain_sums(counts, importance.gain_planes(gains)) == counts @ gains).all()
    assert (importance.gain_sums(counts, importance.gain_planes(np.zeros(10_000, np.int64))) == 0).all()

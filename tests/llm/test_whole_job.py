"""Cases that earlier versions of the corpus operators cut short, against plain computations."""

import functools
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from notewise.llm import exact_dedup, parity_join

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def _shingles(text, size):
    words = WORDS.findall((text or "").lower())
    k = min(size, len(words))
    return frozenset(tuple(words[i:i + k]) for i in range(len(words) - k + 1)) if words else frozenset()


def _linked(rows, size, percent):
    """All pairs of rows whose sets link."""
    sets = [_shingles(r[1], size) for r in rows]
    return [(i, j) for i in range(len(rows)) for j in range(i)
            if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]


def _groups(rows, size, percent):
    group = list(range(len(rows)))
    for i, j in _linked(rows, size, percent):
        group = [group[j] if g == group[i] else g for g in group]
    return group


def test_near_dedup_stage_at_five_words(spark, make_docs):
    """Copies that link at 5 words and 0.8 but not at 3 words and 0.9."""
    rng = random.Random(11)
    rows = []
    for k in range(12):
        words = [f"v{rng.randrange(4000)}" for _ in range(200)]
        edited = list(words)
        for at in (20, 70, 120, 170):
            edited[at] = "edit"
        rows += [(10 * k, " ".join(words)), (10 * k + 1, " ".join(words + [f"f{k}x{i}" for i in range(30)])),
                 (10 * k + 2, " ".join(edited)), (10 * k + 3, " ".join(words[:120] + [f"o{k}y{i}" for i in range(80)]))]
    rows += [(900, "a b"), (901, "A  b"), (902, "a b c"), (903, None)]
    group = _groups(rows, 5, 80)
    want = sorted(min(d for (d, _), h in zip(rows, group, strict=True) if h == g) for g in set(group))
    got = sorted(r.doc_id for r in dict(corpus_pipeline.STAGES)["near_dedup"](spark, make_docs(rows), "").collect())
    assert got == want and not {1, 2} & set(got) and 3 in got


def _rows_of_few_ids():
    """Null and repeated ids with several texts: alone, copies of another id, copies of each other."""
    words = " ".join(f"w{i}" for i in range(100))
    rows = [(None, f"only {i} here") for i in range(20)] + [(None, "shared text"), (9, "Shared text"), (9, "another one of nine"),
            (9, "kept by ten"), (10, "kept by ten"), (None, "both null"), (None, "BOTH null"), (4, "twice"), (4, "twice")]
    return rows + [(7, words), (7, words + " end"), (7, "seven itself"), (None, words + " fin"), (None, None), (None, "")]


def test_exact_dedup_decides_by_id_and_text(make_docs):
    rows = _rows_of_few_ids()
    best = {}
    for i, t in rows:
        best[(t or "").lower()] = max(-1 if i is None else i, best.get((t or "").lower(), -1))
    kept = exact_dedup.keep_one(make_docs(rows)).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, (r.text or "").lower()) for r in kept) == sorted((i, t) for t, i in best.items())


def test_near_dedup_decides_by_id_and_text(make_docs):
    rows = _rows_of_few_ids()
    number = lambda i: 99 if i is None else i
    group = _groups(rows, 3, 90)
    ids = {g: min(number(i) for (i, _), h in zip(rows, group, strict=True) if h == g) for g in set(group)}
    kept = [(number(r.doc_id), r.text) for r in parity_join.keep_one(make_docs(rows)).collect()]
    of = {(number(i), t): g for (i, t), g in zip(rows, group, strict=True)}
    assert len(kept) == len(set(kept))
    # one row of every group, of the group's smallest id and with a text of that group
    assert sorted((of[k], k[0]) for k in kept) == sorted(ids.items())


def test_exact_groups_pair_each_row_with_its_own_hash(make_docs):
    rows = _rows_of_few_ids()
    docs = make_docs(rows)
    got = sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept, r.text_sha256)
                 for r in exact_dedup.with_text_hash(docs, exact_dedup.duplicate_groups(docs)).collect())
    want = []
    for i, t in rows:
        alike = [-1 if j is None else j for j, u in rows if (u or "").lower() == (t or "").lower()]
        keep = None if max(alike) < 0 else max(alike)
        want.append((str(i), str(keep), len(alike), i == keep, hashlib.sha256((t or "").lower().encode()).hexdigest()))
    assert got == sorted(want)


@pytest.mark.parametrize("members", [512, 7])
def test_number_of_links_of_each_row(make_docs, monkeypatch, members):
    monkeypatch.setattr(parity_join, "BLOCK_MEMBERS", members)  # 7: families are cut into many blocks
    rng = random.Random(6)
    base = [f"w{k}" for k in range(130)]
    rows = [(900, None), (901, "Hi"), (None, "hi"), (902, "alone here")]
    for i in range(60):
        words = base[:rng.choice([130, 130, 122, 115, 100])]
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(5)}"
        rows.append((i, " ".join(words)))
    rows += [rows[10], (77, rows[11][1].upper())]
    links = [0] * len(rows)
    for pair in _linked(rows, 3, 90):
        for i in pair:
            links[i] += 1
    got = parity_join.components_and_links(make_docs(rows)).collect()
    assert sorted((str(r.doc_id), r.n_links) for r in got) == sorted((str(i), k) for (i, _), k in zip(rows, links, strict=True))
    assert max(links) > 10


@pytest.mark.parametrize("light", [2, 6, 256])
@pytest.mark.parametrize("size, percent", [(5, 80), (3, 90)])
def test_frequent_parts_lose_no_link(make_docs, monkeypatch, light, size, percent):
    """Families, shared passages and short texts; small bounds make most shared parts heavy."""
    monkeypatch.setattr(parity_join, "_candidates", functools.partial(parity_join._candidates, light=light))
    rng = random.Random(light + size)
    passages = [[f"p{k}x{i}" for i in range(60)] for k in range(4)]
    texts = []
    for k in range(14):
        own = [f"o{k}x{rng.randrange(200)}" for _ in range(rng.choice([4, 8, 20, 60, 150]))]
        base = own + rng.choice(passages) + (rng.choice(passages) if k % 3 else [])
        base = base if k % 4 else own
        for _ in range(rng.choice([1, 3, 12])):
            words = list(base)
            for _ in range(rng.randint(0, max(1, len(words) // 25))):
                words[rng.randrange(len(words))] = f"e{rng.randrange(6)}"
            texts.append(" ".join(words[:rng.randint(max(1, len(words) - 6), len(words))]))
    rows = list(enumerate(texts))
    group = _groups(rows, size, percent)
    first = {g: min(i for (i, _), h in zip(rows, group, strict=True) if h == g) for g in set(group)}
    got = {r.doc_id: r.component_id for r in parity_join.components(make_docs(rows), size, percent).collect()}
    assert got == {i: first[g] for (i, _), g in zip(rows, group, strict=True)}
    assert 20 < len(set(group)) < len(rows) if percent == 90 else len(set(group)) < len(rows)


def test_rows_without_ids_are_read_once(spark, make_docs, monkeypatch):
    """Near copies without doc_id meet their members by digest: one row each, not the square of them."""
    base = [f"w{k}" for k in range(120)]
    rows = [(None, " ".join([*base[:k % 100], f"x{k}", *base[k % 100:]])) for k in range(600)] + [(None, "again " * 20)] * 300
    read = spark.sparkContext.accumulator(0)
    sets = parity_join._sets

    def counting(batches, lower, size):
        for batch, grams in sets(batches, lower, size):
            read.add(len(grams))
            yield batch, grams

    monkeypatch.setattr(parity_join, "_sets", counting)
    got = parity_join.components_and_links(make_docs(rows)).collect()
    assert len(got) == 900 and read.value <= 8 * 900
    assert max(r.n_links for r in got) >= 299


def test_candidates_read_their_parts_once(make_docs):
    """Parts, shared parts and pairs are one map each: no branch makes the exchanges anew."""
    docs = make_docs([(k, f"a b c d {k} e f g h") for k in range(20)])
    plan = parity_join._candidates(docs, 3, 90)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 3, plan


@pytest.mark.parametrize("cut", [1, 2, 3, 7, 50])
def test_stars_and_pairs_from_one_stream(cut):
    """Heavy keys, of few sets or many and cut anywhere, give a star to their smallest set."""
    info = parity_join._info(np.int64(30), 1, 0, 4 * (int(np.searchsorted([b[0] for b in parity_join.bands(90)], 30, "right")) - 1))
    rows = [(key, sig, parity_join.HEAVY if key % 2 else int(info)) for key, n in enumerate([2, 1, 3, 2, 4, 9, 1, 30]) for sig in range(key, key + n)]
    batches = [pa.RecordBatch.from_pydict(dict(zip(("key", "sig", "info"), map(list, zip(*rows[k:k + cut])))))
               for k in range(0, len(rows), cut)]
    got = set()
    for out in parity_join._meet(90, 4)(iter(batches)):
        got |= {(r["a"], r["b"]) for r in out.to_pylist() if r["place"] == -1}
    assert got == {(sig, key) for key, sig, x in rows if x == parity_join.HEAVY and sig != key}
    met = {(r["a"], r["b"]) for out in parity_join._meet(90, 4)(iter(batches)) for r in out.to_pylist() if r["place"] >= 0}
    light = {}
    for key, sig, x in rows:
        if x != parity_join.HEAVY:
            light.setdefault(key, []).append(sig)
    assert met == {(a, b) for sets in light.values() for a in sets for b in sets if a < b}


def test_texts_that_share_a_passage_form_no_cluster(make_docs):
    """Parts that more sets share than are paired are left out, too, as far as a link allows."""
    passage = [f"p{i}" for i in range(150)]
    docs = make_docs([(k, " ".join(passage + [f"o{k}x{i}" for i in range(105)])) for k in range(40)])
    assert parity_join._candidates(docs, 5, 80, light=4).isEmpty()


def test_sets_that_share_a_part_with_many_make_no_pairs(spark, make_docs, monkeypatch):
    """Sets that agree on one part with each of very many others, where a link needs 20, make no
    pairs; two that agree on 25 do."""
    rng = random.Random(11)
    sigs = [rng.randrange(-2 ** 63, 2 ** 63) for _ in range(120)]
    info = int(parity_join._info(np.int64(200), 20, 0, 4 * (int(np.searchsorted([b[0] for b in parity_join.bands(80)], 200, "right")) - 1)))
    shared = [rng.sample(sigs, 2) for _ in range(1800)] + [sigs[:2]] * 25
    rows = [(key << 24, sig, info) for key, pair in enumerate(shared, 1) for sig in pair]
    made = spark.sparkContext.accumulator(0)
    meet = parity_join._meet

    def counting(percent, light):
        def run(batches):
            for out in meet(percent, light)(batches):
                made.add(out.num_rows)
                yield out
        return run

    monkeypatch.setattr(parity_join, "_meet", counting)
    monkeypatch.setattr(parity_join, "_parts", lambda docs, size, percent: spark.createDataFrame(rows, "key long, sig long, info long"))
    edges = [set(r) for r in parity_join._candidates(make_docs([(1, "x")]), 5, 80).collect()]
    assert edges == [set(sigs[:2])] and made.value <= 100, (edges, made.value)


def test_partners_are_the_cells_that_are_on_enough_rows():
    bit = lambda *cells: int(np.array([sum(1 << c for c in cells)], np.uint64).view(np.int64)[0])
    rows = {"key": [1, 2, 3, 4], "info": [0, 0, 0, parity_join.HEAVY], "mates": [bit(3, 63), bit(63), bit(9), 0]}
    for least, want in [(2, [(1, bit(63)), (2, bit(63)), (4, 0)]), (0, [(k, bit(3, 9, 63)) for k in (1, 2, 3)] + [(4, 0)]), (3, [(4, 0)])]:
        got = parity_join._partners(pa.table(rows | {"sig": [5] * 4, "least": [least] * 4})).to_pylist()
        assert [(r["key"], r["partners"]) for r in got] == want


def test_sets_of_a_key_that_may_link_by_size():
    rng = random.Random(8)
    rows = [(key, rng.randrange(40, 200)) for key in range(60) for _ in range(rng.choice([2, 2, 3, 9]))]
    place = parity_join.LEVELS * int(np.searchsorted(parity_join._starts(80), 80, "right") - 1)
    lo, hi = parity_join.bands(80)[place // parity_join.LEVELS][:2]
    rows = [(k, n) for k, n in rows if lo <= n <= hi * 100 // 80]
    key, size = (np.array(c, np.int64) for c in zip(*rows, strict=True))
    want = [any(i != j and k == m and 100 * min(n, o) >= 80 * max(n, o) and min(n, o) <= hi for j, (m, o) in enumerate(rows))
            for i, (k, n) in enumerate(rows)]
    got = parity_join._may_link(key, parity_join._info(0, 0, 0, place) + (size << 32), 80)
    assert got.tolist() == want and 0 < sum(want) < len(want)


def test_mates_are_the_cells_of_the_other_sets():
    rng = random.Random(3)
    rows = sorted((key, rng.randrange(-2 ** 63, 2 ** 63) >> 50 << 50 | rng.randrange(4)) for key in range(40) for _ in range(rng.choice([1, 2, 3, 60])))
    rows = sorted(set(rows))
    key, sig = (np.array(c, np.int64) for c in zip(*rows, strict=True))
    cell = (sig >> 58) & 63
    want = [sum({1 << int(c) for c in cell[(key == k) & (sig != s)]}) for k, s in rows]
    assert parity_join._mates(key, sig).view(np.uint64).tolist() == want

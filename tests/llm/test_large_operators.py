"""Nearest neighbours, substring dedup, Jaccard join and BPE against brute force."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from notewise.llm import ann_tree, blocks, bpe, parity_join, queries, sketch_dedup, suffix_dedup

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def _corpus(seed, n=70):
    """Random texts with exact copies, edited copies, shared passages and odd rows."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(300)]
    text = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    passage = text(60)
    rows = [None, "", "   \t\n", "one", "two words", passage, "a" * 400, "ab" * 200, "a" * 300 + "b" * 200]
    rows += [text(rng.randint(1, 150)) for _ in range(n)]
    for _ in range(n):
        words = WORDS.findall(rng.choice(rows[9:9 + n]))
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        rows.append(" ".join(words))
    rows += [text(20) + " " + passage + "\n" + text(20) for _ in range(10)]
    ids = list(range(0, 2 * len(rows), 2))
    rng.shuffle(ids)
    return list(zip(ids, rows, strict=True))


def _cover(units, window, first, me):
    gone = [False] * len(units)
    for k in range(len(units) - window + 1):
        if first[tuple(units[k:k + window])] < me:
            gone[k:k + window] = [True] * window
    return gone


def _first(docs, window):
    first = {}
    for i, units in docs:
        for k in range(len(units) - window + 1):
            key = tuple(units[k:k + window])
            first[key] = min(first.get(key, i), i)
    return first


@pytest.mark.parametrize("block_bytes", [1 << 20, 3000])
def test_words_removed_like_brute_force(make_docs, block_bytes):
    rows = _corpus(1)
    rows += [(rows[20][0], rows[20][1]), (None, rows[21][1])]  # a repeated row; a null id is the largest
    number = lambda i: 10 ** 9 if i is None else i
    docs = [(number(i), WORDS.findall(t or "")) for i, t in rows]
    first = _first(docs, 13)
    want = []
    for (i, _), (me, words) in zip(rows, docs, strict=True):
        gone = _cover(words, 13, first, me)
        kept = " ".join(w for w, g in zip(words, gone, strict=True) if not g)
        want.append((i, len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    got = sketch_dedup.dedup(make_docs(rows, extra="1 as block;2 as payload"), block_bytes=block_bytes).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


@pytest.mark.parametrize("block_bytes", [1 << 20, 3000])
def test_bytes_removed_like_brute_force(make_docs, block_bytes, monkeypatch):
    rows = _corpus(2)
    rows += [(rows[20][0], rows[20][1]), (None, rows[21][1])]
    number = lambda i: 10 ** 9 if i is None else i
    docs = [(number(i), (t or "").encode()) for i, t in rows]
    first = _first(docs, 50)
    want = []
    for (i, _), (me, raw) in zip(rows, docs, strict=True):
        gone = _cover(raw, 50, first, me)
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        want.append((i, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest(), kept))
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept))
           for r in suffix_dedup.dedup(make_docs(rows, extra="1 as block;2 as slot"), block_bytes=block_bytes).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_substring_dedup_with_rows_in_another_order_each_time():
    """A shuffle that is read twice may bring a block's rows in two orders; answers must still fit."""
    rng = random.Random(9)
    shared = ["".join(rng.choice("abcdef ") for _ in range(120)) for _ in range(20)]
    texts = [shared[k % 20][k % 7:] + " own " + shared[(3 * k) % 20] for k in range(60)]
    docs = pa.table({"block": pa.array([0] * 60, pa.int64()), "doc_id": pa.array(range(60), pa.int64()), "text": texts})
    block = suffix_dedup._Block(docs, 50)
    answers = blocks.merge_cells(blocks.rows(blocks.ask_cells(0, 0, block.cells(1 << 20), 1 << 20, 1)))
    found = [suffix_dedup._Block(docs.take(order), 50).stretches(answers, 1 << 20, 4)
             for order in (list(range(60)), list(range(59, -1, -1)), rng.sample(range(60), 60))]
    for other in found[1:]:
        assert len(other[2]) > 40 and other[2] == found[0][2]
        assert all(np.array_equal(other[k], found[0][k]) for k in (3, 4, 5))


def test_substring_dedup_of_nothing(make_docs):
    empty = make_docs([(1, "x")]).where("false")
    assert suffix_dedup.dedup(empty).count() == 0 and sketch_dedup.dedup(empty).count() == 0
    got = suffix_dedup.dedup(make_docs([(1, None), (2, "")])).collect()
    assert all((r.n_bytes, r.n_removed, r.n_spans) == (0, 0, 0) for r in got) and len(got) == 2


@pytest.mark.parametrize("bucket", [1 << 18, 8])
def test_suffix_order_names_equal_windows(monkeypatch, bucket):
    monkeypatch.setattr(suffix_dedup, "SUFFIX_BUCKET", bucket)
    rng = random.Random(4)
    base = bytes(rng.choice(b"ab") for _ in range(70))
    stretches, places = [], []
    for _ in range(60):  # few letters: long ties, also between anchors at different offsets
        text = bytearray(base if rng.random() < 0.8 else bytes(rng.choice(b"ab") for _ in range(70)))
        if rng.random() < 0.7:
            text[rng.randrange(70)] = rng.choice(b"abc")
        a = rng.randrange(0, 20)
        stretches.append(bytes(text[a:a + rng.randint(50, 80)]).ljust(50, b"z"))
        places.append(rng.randrange(0, 30))
    label = suffix_dedup.same_windows(stretches, np.array(places))
    windows = [s[k:k + 50] for s in stretches for k in range(len(s) - 49)]
    by_text, by_label = {}, {}
    for w, x in zip(windows, label.tolist(), strict=True):
        # the layout makes windows comparable when anchors agree: same text, same residue
        by_label.setdefault(x, set()).add(w)
        by_text.setdefault(w, set()).add(x)
    assert all(len(v) == 1 for v in by_label.values())


def test_difference_cover_has_every_difference():
    cover = set(suffix_dedup.COVER.tolist())
    assert {(a - b) % 31 for a in cover for b in cover} == set(range(31))


def _sets(text):
    words = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    k = min(3, len(words))
    return frozenset(tuple(words[i:i + k]) for i in range(len(words) - k + 1))


def _components(rows):
    sets, parent = [_sets(t) for _, t in rows], list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[root(i)] = min(doc, least.get(root(i), doc))
    return sorted((doc, len(sets[i]), least[root(i)]) for i, (doc, _) in enumerate(rows))


@pytest.mark.parametrize("members", [512, 3])
def test_jaccard_components_like_brute_force(make_docs, monkeypatch, members):
    monkeypatch.setattr(parity_join, "BLOCK_MEMBERS", members)  # 3: families are cut into many blocks
    rng = random.Random(5)
    rows = [(i, t) for i, t in _corpus(3, 50)]
    base = [f"w{k}" for k in range(130)]
    for i in range(40):  # a family around one text, some members linked only through others
        words = list(base)
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(130)] = f"x{rng.randrange(9)}"
        rows.append((1001 + 2 * i, " ".join(words).upper() if i % 3 else " ".join(words)))
    rows.append((rows[-1][0], rows[-1][1]))
    got = parity_join.components(make_docs(rows, extra="1 as sig;2 as component")).collect()
    assert sorted(map(tuple, got)) == _components(rows)


def test_jaccard_join_edges(make_docs):
    got = {(r.doc_id, r.n_shingles, r.component_id)
           for r in parity_join.components(make_docs([(5, None), (6, ""), (7, "Hi"), (8, "hi"), (None, "hi"), (9, "a b")])).collect()}
    assert got == {(5, 0, 5), (6, 0, 6), (7, 1, 7), (8, 1, 7), (None, 1, 7), (9, 1, 9)}
    assert parity_join.components(make_docs([(1, "x")]).where("false")).count() == 0


def test_bands_hold_every_linked_pair():
    for a in range(1, 3000):
        b = 100 * a // 90  # the largest set that can link with one of size a
        assert set(parity_join._bands_of(a, 90)) & set(parity_join._bands_of(b, 90)) or (a + b) // 19 == 0


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16))
    x = (centres[rng.integers(0, 12, 3000)] + 0.4 * rng.normal(size=(3000, 16))).astype(np.float32)
    x[100:900] = x[100]  # one vector holds a good part of the rows
    rows = [(i, v.tolist(), 1.0) for i, v in enumerate(x)]
    rows += [(4000, None, 1.0), (4020, [0.0] * 16, 1.0), (4040, [float("nan")] + [1.0] * 15, 1.0), (4060, [1.0, None] * 8, 1.0),
             (None, x[0].tolist(), 1.0), (4080, [1.0] * 3, 1.0), (4100, [float("inf")] * 16, 1.0), (20, x[20].tolist(), 1.0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score double")
    got = ann_tree.search(table, F.col("id") % 20 == 0).collect()
    by_query = {}
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        by_query.setdefault(r.query_id, []).append((r.vec_id, r.score))
    y = x.astype(np.float64)
    hits = 0
    assert set(by_query) == set(range(0, 3000, 20))
    for q, found in by_query.items():
        scores = (y * y[q]).sum(1)
        best = [int(i) for i in np.lexsort((np.arange(3000), -scores)) if i != q][:20]
        assert len(found) == 20 and len({v for v, _ in found}) == 20 and q not in {v for v, _ in found}
        assert all(s == pytest.approx(scores[v], abs=1e-12) for v, s in found)
        assert found == sorted(found, key=lambda f: (-f[1], f[0]))
        hits += len(set(best) & {v for v, _ in found})
    assert hits / (20 * len(by_query)) >= 0.9
    alike = [v for v, _ in by_query[200] if 100 <= v < 900]  # equal vectors: the smallest ids
    assert alike == list(range(100, 100 + len(alike))) and alike


def test_nearest_neighbours_of_few_and_none(spark):
    table = spark.createDataFrame([(i, [float(i), 1.0]) for i in (0, 1, 2, 20)], "vec_id long, embedding array<double>")
    got = {(r.query_id, r["rank"], r.vec_id) for r in ann_tree.search(table, F.col("id") % 20 == 0).collect()}
    assert got == {(0, 1, 1), (0, 2, 2), (0, 3, 20), (20, 1, 2), (20, 2, 1), (20, 3, 0)}
    assert ann_tree.search(table.where("false"), F.col("id") % 20 == 0).count() == 0


TEXTS = [None, "", " \n ", "Hello WORLD's it's I'M 123 abc!!!???", "a<|endoftext|>b <|startoftext|>", "x\x1cy\x1d \x85z q",
         "İSTANBUL ΣΑΣ ß ﬁ é é Å", "日本語テキスト 🙂🙂", "ab" * 3000, "don'T 'S ſ K", "́abc", "١٢३ Ⅷ ²", "<|", "​﻿x"]


def test_bpe_equals_the_library(make_docs):
    path = queries.tokenizer_path()
    library, own = Tokenizer.from_file(path), bpe.load(path)
    rng = random.Random(6)
    texts = TEXTS + ["".join(rng.choice("ab'sStT lLdD12!.\t\né<|>ΣɐЖ ") for _ in range(rng.randint(0, 40))) for _ in range(500)]
    want = {}
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        assert own.encode(t) == ids and own.decode(ids) == text, t
        want[i] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    docs = make_docs(list(enumerate(texts)), extra="1 as ids")
    for cache in (600_000, 3):  # a cache too small for the texts only costs time
        got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip(docs, path, cache).collect()}
        assert got == want
    ids = {r.doc_id: r.ids for r in bpe.encode_documents(docs, path).collect()}
    assert all(ids[i] == own.encode(t) for i, t in enumerate(texts))
    assert bpe.round_trip(docs.where("false"), path).count() == 0

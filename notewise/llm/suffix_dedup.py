"""Substring dedup with suffix arrays built blockwise over a difference cover.

A byte is removed when a 50-byte string over it also starts in a document with a smaller
doc_id. Texts are UTF-8 bytes, matches never cross documents, and strings are judged on the
input.

Suffixes are dealt to buckets by content: of the 20-byte grams inside a 50-byte window the
one with the smallest hash is its anchor, and equal windows have equal anchors. A first round
of questions (see ``blocks``) leaves out anchors whose gram occurs once in the corpus, which
loses no repeated window. For the others a document sends the stretch of text whose windows
share the anchor, once per block and distinct stretch, to the anchor's bucket.

A bucket sorts its windows' suffixes one suffix bucket at a time (splitters are drawn from
the cover sample). Suffixes are compared on their first 32 bytes; longer ties are resolved by
precomputed ranks of a difference-cover sample: of the positions whose residue modulo 31 is
in the cover, so that any two suffixes have a common offset below 31 at which both are in the
sample. Stretches are laid out with their anchors at residue 0; suffixes tied at equal
residues then share the offset and sort as columns, and only ties between different residues
are compared pair by pair. Neighbours in the order that agree on 50 bytes are one string,
whose smallest doc_id decides.

Memory is bounded by a block or bucket of about ``block_bytes`` of text. A passage that very
many documents share is one stretch per block. Null text is empty. Rows with the same doc_id
never remove each other's bytes; a null doc_id counts as larger than any other. Every row
gives one row; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import cmp_to_key

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .blocks import (BLOCK_BYTES, ask_cells, answers_of, blocked, exchange, ids_of, merge_cells, pack, repeated_cells,
                     rows, text_bytes, unpack)
from .common import n_blocks
from .words import mix, powers, prefix_sums, texts_of

WINDOW = 50
GRAM = 20
CELLS_PER_BYTE = 64
SUFFIX_BUCKET = 1 << 18
# A difference cover modulo 31 (every residue is a difference of two of them).
PERIOD = 31
COVER = np.array([1, 5, 11, 24, 25, 27])
_CELL, _STRETCH = 0, 1
_SEGMENT = 1 << 23
_PLACE_BITS = np.uint64(24)


def _common_offsets() -> np.ndarray:
    """offset[r, s]: the smallest k with r + k and s + k both in the cover."""
    inside = np.isin(np.arange(2 * PERIOD) % PERIOD, COVER)
    out = np.zeros((PERIOD, PERIOD), np.int64)
    for r in range(PERIOD):
        for s in range(PERIOD):
            out[r, s] = next(k for k in range(PERIOD) if inside[(r + k) % PERIOD] and inside[(s + k) % PERIOD])
    return out


_OFFSET = _common_offsets()


def anchors(data: np.ndarray, offsets: np.ndarray, window: int = WINDOW, gram: int = GRAM):
    """Runs of window starts with one anchor: first start, last start, anchor, its gram's hash.

    ``data`` is at most _SEGMENT + window bytes long; windows lie within one text.
    """
    n = len(data) - window + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    sums = prefix_sums(data)
    h = mix((sums[gram:] - sums[:-gram]) * powers(len(data) + 1)[1][:len(data) - gram + 1], 31)
    low = (np.uint64(1) << _PLACE_BITS) - np.uint64(1)
    least = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    span, width = window - gram + 1, 1
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < span:
        least = np.minimum(least[:n], least[span - width:span - width + n])
    anchor = (least[:n] & low).astype(np.int64)
    crossing = np.zeros(len(data) + 1, np.int64)
    np.add.at(crossing, np.maximum(offsets[:-1], offsets[1:] - window + 1), 1)
    np.add.at(crossing, offsets[1:], -1)
    start = np.flatnonzero(np.cumsum(crossing[:n]) == 0)
    if not len(start):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    own = anchor[start]
    new = np.ones(len(start), bool)
    new[1:] = (own[1:] != own[:-1]) | (start[1:] != start[:-1] + 1)
    at = np.flatnonzero(new)
    return start[at], start[np.append(at[1:], len(start)) - 1], own[at], h[own[at]]


def _ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... count[0] numbers, then those of the next, as one array."""
    return np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())


def same_windows(stretches: list[bytes], places: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """A number for each window of each stretch, in order: equal exactly for equal windows.

    ``places`` are the offsets of the anchors in their stretches.
    """
    lengths = np.fromiter(map(len, stretches), np.int64, len(stretches))
    stride = PERIOD * (2 + -(-int(lengths.max()) // PERIOD))
    base = np.arange(len(stretches)) * stride + PERIOD - places % PERIOD
    text = np.zeros(stride * len(stretches) + 2 * window + 64, np.uint8)
    text[_ranges(base, lengths)] = np.frombuffer(b"".join(stretches), np.uint8)
    word = np.zeros(len(text) - 7, np.uint64)  # the eight bytes from each position, big end first
    for k in range(8):
        word |= text[k:len(text) - 7 + k].astype(np.uint64) << np.uint64(56 - 8 * k)

    # Ranks of the cover sample: its suffixes, to a depth that reaches beyond any window.
    inside = np.flatnonzero(np.isin(np.arange(stride * len(stretches)) % PERIOD, COVER))
    depth = range(0, window + 8, 8)
    order = inside[np.lexsort([word[inside + k] for k in reversed(depth)])]
    new = np.zeros(len(order), bool)
    for k in depth:
        new[1:] |= word[order[1:] + k] != word[order[:-1] + k]
    rank = np.zeros(len(text), np.int64)
    rank[order] = np.cumsum(new)

    start = _ranges(base, lengths - window + 1)
    label = np.empty(len(start), np.int64)
    sample = np.sort(word[order[::max(1, len(order) * SUFFIX_BUCKET // max(1, len(start)))]])
    bucket = np.searchsorted(sample, word[start], "right")
    used = 0
    for b in np.unique(bucket):
        mine = np.flatnonzero(bucket == b)
        sorted_, label_ = _sort_bucket(start[mine], word, rank, window)
        label[mine[sorted_]] = label_ + used
        used += int(label_[-1]) + 1
    return label


def _sort_bucket(start: np.ndarray, word: np.ndarray, rank: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes of one bucket, and numbers of their windows in that order."""
    residue = start % PERIOD
    heads = [word[start + k] for k in (0, 8, 16, 24)]
    order = np.lexsort([rank[start + _OFFSET[residue, residue]], residue, *reversed(heads)])
    tied = np.ones(len(order), bool)
    for h in heads:
        tied[1:] &= h[order[1:]] == h[order[:-1]]
    tied[0] = False
    group = np.cumsum(~tied)
    turn = np.flatnonzero(tied[1:] & (residue[order[1:]] != residue[order[:-1]])) + 1
    for g in np.unique(group[turn]):  # ties between different residues
        a, b = np.searchsorted(group, [g, g + 1])

        def compare(i: int, j: int) -> int:
            k = _OFFSET[residue[i], residue[j]]
            return int(rank[start[i] + k]) - int(rank[start[j] + k]) or int(i) - int(j)

        order[a:b] = sorted(order[a:b].tolist(), key=cmp_to_key(compare))
    at = start[order]
    new = ~tied
    for k in (*range(32, window - 7, 8), window - 8):
        new[1:] |= word[at[1:] + k] != word[at[:-1] + k]
    new[0] = False
    return order, np.cumsum(new)


class _Block:
    """The anchors of a block's documents."""

    def __init__(self, docs: pa.Table, window: int):
        self.window = window
        self.ids = ids_of(docs)
        self.block = docs.column("block")[0].as_py()
        self.texts: list[tuple[np.ndarray, np.ndarray]] = []
        lo, hi, place, gram, owner, slice_ = [], [], [], [], [], []
        row = 0
        for batch in docs.select(["text"]).combine_chunks().to_batches():
            for _, _, data, offsets in texts_of(batch):
                for a in range(0, max(1, len(data) - window + 1), _SEGMENT):
                    part = data[a:a + _SEGMENT + window - 1]
                    first, last, at, h = anchors(part, np.clip(offsets - a, 0, len(part)) if a else
                                                 np.minimum(offsets, len(part)), window)
                    lo.append(first + a)
                    hi.append(last + a)
                    place.append(at + a)
                    gram.append(h)
                    owner.append(np.searchsorted(offsets, first + a, "right") - 1 + row)
                    slice_.append(np.full(len(first), len(self.texts)))
                self.texts.append((data, offsets))
                row += len(offsets) - 1
        none = np.zeros(0, np.int64)
        self.lo, self.hi, self.place, self.owner, self.slice = (
            np.concatenate([none, *c]) for c in (lo, hi, place, owner, slice_))
        self.gram = np.concatenate([np.zeros(0, np.uint64), *gram])

    def cells(self, width: int) -> np.ndarray:
        return mix(self.gram, 41) & np.uint64(width - 1)

    def stretches(self, answers: pa.Table, width: int, buckets: int):
        """Of the anchors that the corpus repeats: their numbers, the number of each one's
        stretch; and the distinct stretches by bucket: text, smallest id, anchor, cuts."""
        keep = np.flatnonzero(repeated_cells(self.cells(width), answers, _CELL, width, buckets))
        known: dict[bytes, int] = {}
        found = np.empty(len(keep), np.int64)
        for number, (data, _) in enumerate(self.texts):
            mine = np.flatnonzero(self.slice[keep] == number)
            raw = data.tobytes() if len(mine) else b""
            ends = (self.hi[keep[mine]] + self.window).tolist()
            found[mine] = [known.setdefault(raw[a:b], len(known)) for a, b in zip(self.lo[keep[mine]].tolist(), ends, strict=True)]
        least = np.full(len(known), np.iinfo(np.int64).max)
        np.minimum.at(least, found, self.ids[self.owner[keep]])
        one = np.zeros(len(known), np.int64)
        one[found] = keep  # any anchor of the stretch
        bucket = ((mix(self.gram[one], 42) >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
        # By bucket and text: the order must not hang on that of the rows, which each reading of a
        # shuffle may bring in another one, as answers are found by their place.
        text = list(known)
        by_text = np.array(sorted(range(len(text)), key=text.__getitem__), np.int64)
        order = by_text[np.argsort(bucket[by_text], kind="stable")]
        back = np.empty(len(known), np.int64)
        back[order] = np.arange(len(known))
        cut = np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=np.uint64))
        return (keep, back[found] if len(found) else found, [text[i] for i in order.tolist()], least[order],
                (self.place[one] - self.lo[one])[order], cut)


def _merge_stretches(window: int, gram: int):
    def merge(asked: pa.Table) -> pa.Table:
        """For each window of each stretch of a block: is there a smaller id elsewhere?"""
        found = asked.to_pylist()
        known: dict[bytes, int] = {}
        places: list[int] = []
        which, ids = [], []
        for row in found:
            lengths, place, least, raw = unpack(row["payload"], np.uint8, np.uint8, np.int64, np.uint8)
            raw, ends = raw.tobytes(), np.cumsum(lengths, dtype=np.int64).tolist()
            own = []
            for a, b, p in zip([0, *ends[:-1]], ends, place.tolist(), strict=True):
                text = raw[a:b]
                number = known.setdefault(text, len(known))
                if number == len(places):
                    places.append(p)
                own.append(number)
            which.append(np.array(own, np.int64))
            ids.append(least)
        texts, place = list(known), np.array(places)
        least = np.full(len(texts), np.iinfo(np.int64).max)
        np.minimum.at(least, np.concatenate(which), np.concatenate(ids))
        count = np.fromiter(map(len, texts), np.int64, len(texts)) - window + 1
        first = np.cumsum(count) - count
        smallest = np.repeat(least, count)

        # A gram with one stretch only needs no sorting.
        by_gram: dict[bytes, list[int]] = {}
        for i, (text, p) in enumerate(zip(texts, places, strict=True)):
            by_gram.setdefault(text[p:p + gram], []).append(i)
        several = np.array([i for group in by_gram.values() if len(group) > 1 for i in group], np.int64)
        if len(several):
            label = same_windows([texts[i] for i in several.tolist()], place[several], window)
            at = _ranges(first[several], count[several])
            lowest = np.full(int(label.max()) + 1, np.iinfo(np.int64).max)
            np.minimum.at(lowest, label, smallest[at])
            smallest[at] = lowest[label]
        out = []
        for row, own, own_ids in zip(found, which, ids, strict=True):
            bits = smallest[_ranges(first[own], count[own])] < np.repeat(own_ids, count[own])
            out.append((row["slot"], row["block"], row["kind"], pack(np.packbits(bits))))
        return rows(out)

    return merge


def dedup(docs: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, texts: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the remaining bytes; null
    unless ``texts``)."""
    gram = GRAM
    if not gram + 12 <= window <= gram + PERIOD - 1:
        raise ValueError("window must be 32 to 50 bytes for grams of 20 and a cover modulo 31")
    total = text_bytes(docs)
    blocks = n_blocks(total, block_bytes)
    width = 1 << max(10, (CELLS_PER_BYTE * total - 1).bit_length())

    def first(part: pa.Table) -> pa.Table:
        own = _Block(part, window)
        return rows(ask_cells(own.block, _CELL, own.cells(width), width, blocks))

    def second(part: pa.Table, answers: pa.Table) -> pa.Table:
        if not part.num_rows:
            return rows([])
        own = _Block(part, window)
        _, _, text, least, place, cut = own.stretches(answers, width, blocks)
        out = []
        for bucket, (a, b) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)):
            if b > a:
                lengths = np.fromiter(map(len, text[a:b]), np.uint8, b - a)
                raw = np.frombuffer(b"".join(text[a:b]), np.uint8)
                out.append((_STRETCH * blocks + bucket, own.block, _STRETCH,
                            pack(lengths, place[a:b].astype(np.uint8), least[a:b], raw)))
        return rows(out)

    def last(part: pa.Table, answers: pa.Table) -> pa.Table:
        schema = pa.schema([("doc_id", part.schema.field("doc_id").type), ("n_bytes", pa.int64()), ("n_removed", pa.int64()),
                            ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])
        if not part.num_rows:
            return schema.empty_table()
        own = _Block(part, window)
        keep, found, text, least, _, cut = own.stretches(answers, width, blocks)
        count = np.fromiter(map(len, text), np.int64, len(text)) - window + 1
        begin = np.append(0, np.cumsum(count))
        smaller = np.zeros(int(begin[-1]), bool)
        for slot, payload in answers_of(answers, _STRETCH):
            a, b = begin[cut[slot - _STRETCH * blocks]], begin[cut[slot - _STRETCH * blocks + 1]]
            smaller[a:b] = np.unpackbits(unpack(payload, np.uint8)[0], count=int(b - a))
        later = own.ids[own.owner[keep]] > least[found] if len(keep) else np.zeros(0, bool)
        out: list[list] = [[], [], [], [], []]
        for number, (data, offsets) in enumerate(own.texts):
            mine = np.flatnonzero(own.slice[keep] == number)
            n = count[found[mine]]
            gone = smaller[_ranges(begin[found[mine]], n)] | np.repeat(later[mine], n)
            hits = np.zeros(len(data) + 1, np.int64)
            hits[_ranges(own.lo[keep[mine]], n) + 1] = gone
            upto = np.cumsum(hits)
            byte = np.arange(len(data))
            covered = upto[byte + 1] > upto[np.maximum(byte - window + 1, 0)]
            opens = covered.copy()
            opens[1:] &= ~covered[:-1]
            opens[offsets[:-1][offsets[:-1] < len(data)]] = covered[offsets[:-1][offsets[:-1] < len(data)]]
            removed, spans = (np.append(0, np.cumsum(x))[offsets] for x in (covered, opens))
            for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                cut_out = int(removed[i + 1] - removed[i])
                stays = data[a:b][~covered[a:b]].tobytes() if cut_out else data[a:b].tobytes()
                for column, value in zip(out, (b - a, cut_out, int(spans[i + 1] - spans[i]), hashlib.sha256(stays).hexdigest(),
                                               stays if texts else None), strict=True):
                    column.append(value)
        return pa.table([part.column("doc_id"), *(pa.array(c, schema.field(i + 1).type) for i, c in enumerate(out))], schema=schema)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return exchange(blocked(docs, blocks), first, merge_cells, second, _merge_stretches(window, gram), last,
                    f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")

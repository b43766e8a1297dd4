"""Substring dedup over word windows with a count-min prefilter.

Every block of documents counts its 13-word windows in a count-min sketch; the sketches of all
blocks are added, range of cells by range of cells, and may overestimate but never
underestimate a window's count. Only windows whose cells all count two or more are grouped
exactly (by a 96-bit fingerprint, to the smallest doc_id that has them), so no repeated
window is lost. A word is removed when a window over it also starts in a document with a
smaller doc_id; windows are judged on the input.

Sketch rows are as wide as the corpus needs (``CELLS_PER_BYTE`` of text) and travel sparse,
as the gaps between the cells a block counts, so width costs no memory; see ``blocks`` for
the exchange. Words are runs of anything but the six ASCII blanks, unchanged; null text has
none. Rows with the same doc_id never remove each other's words; a null doc_id counts as
larger than any other. Every row gives one row; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .blocks import (BLOCK_BYTES, ask_cells, answers_of, blocked, exchange, ids_of, merge_cells, pack, repeated_cells,
                     rows, text_bytes, unpack)
from .common import n_blocks
from .words import find_words, mix, texts_of, windows

WINDOW = 13
DEPTH = 2
CELLS_PER_BYTE = 2
_EXACT = DEPTH  # kind of the exact questions


class _Block:
    """The windows of a block: two hashes each, the row they are in, and its id."""

    def __init__(self, docs: pa.Table, size: int):
        self.ids = ids_of(docs)
        self.block = docs.column("block")[0].as_py()
        self.size = size
        self.slices = []
        row = 0
        h1, h2, owner = [], [], []
        for batch in docs.select(["text"]).combine_chunks().to_batches():
            for _, _, data, offsets in texts_of(batch):
                words, start, end, at = find_words(data, offsets, False)
                a, b = windows(words, size, 11), windows(words, size, 12)
                here = np.repeat(np.arange(len(at) - 1), np.diff(at))
                whole = here[:len(a)] == here[size - 1:] if len(a) else np.zeros(0, bool)
                h1.append(a[whole])
                h2.append((b[whole] >> np.uint64(32)).astype(np.uint32))
                owner.append(here[:len(a)][whole] + row)
                self.slices.append((data, start, end, at, np.flatnonzero(whole)))
                row += len(offsets) - 1
        self.h1 = np.concatenate(h1) if h1 else np.zeros(0, np.uint64)
        self.h2 = np.concatenate(h2) if h2 else np.zeros(0, np.uint32)
        self.owner = np.concatenate(owner) if owner else np.zeros(0, np.int64)

    def cells(self, kind: int, width: int) -> np.ndarray:
        return mix(self.h1, 20 + kind) & np.uint64(width - 1)

    def survivors(self, answers: pa.Table, width: int, ranges: int) -> np.ndarray:
        """Places of the windows whose every cell counts two or more."""
        keep = np.arange(len(self.h1))
        for kind in range(DEPTH):
            cells = self.cells(kind, width)
            keep = keep[repeated_cells(cells, answers, kind, width, ranges)[keep]]
        return keep

    def questions(self, keep: np.ndarray, ranges: int):
        """Distinct windows of ``keep`` in order, their smallest id, the cuts of the ranges,
        and for each of ``keep`` its place among them."""
        h1, h2, ids = self.h1[keep], self.h2[keep], self.ids[self.owner[keep]]
        order = np.lexsort((h2, h1))
        a, b = h1[order], h2[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        at = np.flatnonzero(new)
        least = np.minimum.reduceat(ids[order], at) if len(at) else np.zeros(0, np.int64)
        place = np.empty(len(a), np.int64)
        place[order] = np.cumsum(new) - 1
        edges = np.arange(1, ranges, dtype=np.uint64) * np.uint64((1 << 64) // max(ranges, 2))
        cut = np.concatenate([[0], np.searchsorted(a[at], edges), [len(at)]])
        return a[at], b[at], least, cut, place


def _merge_exact(asked: pa.Table) -> pa.Table:
    """Per distinct window of each block: is there a smaller id elsewhere?"""
    found = asked.to_pylist()
    parts = [unpack(r["payload"], np.uint64, np.uint32, np.int64) for r in found]
    h1, h2, ids = (np.concatenate(c) for c in zip(*parts, strict=True))
    order = np.lexsort((h2, h1))
    a, b = h1[order], h2[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    least = np.minimum.reduceat(ids[order], np.flatnonzero(new))
    smaller = np.empty(len(ids), bool)
    smaller[order] = least[np.cumsum(new) - 1] < ids[order]
    answers = np.split(smaller, np.cumsum([len(p[0]) for p in parts])[:-1])
    return rows([(r["slot"], r["block"], r["kind"], pack(np.packbits(x))) for r, x in zip(found, answers, strict=True)])


def dedup(docs: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES,
          cells_per_byte: int = CELLS_PER_BYTE, texts: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept (the kept words joined by one blank;
    null unless ``texts``)."""
    total = text_bytes(docs)
    blocks = n_blocks(total, block_bytes)
    width = 1 << max(10, (cells_per_byte * total - 1).bit_length())

    def first(part: pa.Table) -> pa.Table:
        own = _Block(part, window)
        return rows([q for kind in range(DEPTH) for q in ask_cells(own.block, kind, own.cells(kind, width), width, blocks)])

    def second(part: pa.Table, answers: pa.Table) -> pa.Table:
        if not part.num_rows:
            return rows([])
        own = _Block(part, window)
        h1, h2, least, cut, _ = own.questions(own.survivors(answers, width, blocks), blocks)
        return rows([(_EXACT * blocks + r, own.block, _EXACT, pack(h1[a:b], h2[a:b], least[a:b]))
                     for r, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if b > a])

    def last(part: pa.Table, answers: pa.Table) -> pa.Table:
        if not part.num_rows:
            return pa.table({"doc_id": part.column("doc_id"), "n_words": pa.array([], pa.int64()),
                             "n_removed": pa.array([], pa.int64()), "kept_sha256": pa.array([], pa.string()),
                             "kept": pa.array([], pa.string())})
        own = _Block(part, window)
        keep = own.survivors(answers, width, blocks)
        _, _, least, cut, place = own.questions(keep, blocks)
        smaller = np.zeros(len(least), bool)
        for slot, payload in answers_of(answers, _EXACT):
            r = slot - _EXACT * blocks
            smaller[cut[r]:cut[r + 1]] = np.unpackbits(unpack(payload, np.uint8)[0], count=int(cut[r + 1] - cut[r]))
        gone = np.zeros(len(own.h1), bool)
        gone[keep] = smaller[place] | (own.ids[own.owner[keep]] > least[place])
        n_words, n_removed, hashes, kept, at_window = [], [], [], [], 0
        for data, start, end, at, starts in own.slices:
            hits = np.zeros(len(start) + 1, np.int64)
            hits[starts + 1] = gone[at_window:at_window + len(starts)]
            at_window += len(starts)
            upto = np.cumsum(hits)
            word = np.arange(len(start))
            covered = upto[word + 1] > upto[np.maximum(word - window + 1, 0)]
            raw = data.tobytes()
            for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                stay = np.flatnonzero(~covered[a:b]) + a
                n_words.append(b - a)
                n_removed.append(b - a - len(stay))
                text = b" ".join([raw[s:e] for s, e in zip(start[stay].tolist(), end[stay].tolist(), strict=True)])
                hashes.append(hashlib.sha256(text).hexdigest())
                kept.append(text if texts else None)
        return pa.table({"doc_id": part.column("doc_id"), "n_words": pa.array(n_words, pa.int64()),
                         "n_removed": pa.array(n_removed, pa.int64()),
                         "kept_sha256": pa.array(hashes, pa.string()),
                         "kept": pa.array(kept, pa.binary()).cast(pa.string())})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return exchange(blocked(docs, blocks), first, merge_cells, second, _merge_exact, last,
                    f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string, kept string")

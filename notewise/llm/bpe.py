"""BPE encoding and decoding with a segment tree over the ranks of adjacent pairs.

For each word a segment tree holds, per position, the merge rank of the symbol there and its
right neighbour; every node holds the minimum of (rank, position), so the root names the
leftmost pair of lowest rank. A merge joins the pair, unlinks the right symbol and updates
three leaves (the merged one, its left neighbour and the unlinked one) on their paths to the
root, until the root finds no mergeable pair. Trees of many words are kept as rows of one
array and advance together, so a step costs a few array operations for thousands of words,
and a very long word costs n log n.

Normalisation and splitting follow the vocabulary file (NFC, white space to one blank, lower
case; contractions, letter runs, single digits, runs of other signs; bytes as letters), as
do the special tokens, which are matched in the raw text. The file's path is a parameter and
is read on each executor. Encoding is a map over the documents; no shuffle, no collection.
Chunks between blanks are encoded once and remembered per task, up to a number of bytes; rows
are taken by bytes too, so a task's memory follows neither the batch nor the vocabulary of the texts.

Null text counts as empty: no ids, and the hashes are those of the empty string. Every row
of the input gives one row (repeated rows too); extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from functools import lru_cache
from sys import getsizeof

import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import lean, release_unused
from .words import texts_of

CACHE_BYTES = 48 << 20
#: A remembered chunk's place in the dictionary.
ENTRY_BYTES = 100
SLICE_BYTES = 1 << 19
#: Positions of words that are merged together.
MERGE_CELLS = 1 << 17
_NONE = np.int64(2 ** 62)
# Controls that Python's split takes for blanks and the vocabulary's splitter does not.
_ODD_BLANKS = re.compile("[\x1c-\x1f]")
# Latin text is normalised and split here; for anything beyond, whose case and letter classes
# depend on the Unicode version, the vocabulary's own normaliser and splitter are called.
_BEYOND_LATIN = re.compile("[^\x00-\u024f]")
_WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")


class Bpe:
    """The vocabulary file with lookup tables for the merges."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        suffix = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.special_re = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        # Normaliser and splitter alone: a second copy of vocabulary and merges would serve nothing.
        library = Tokenizer.from_str(json.dumps(spec | {"added_tokens": [], "model": model | {"vocab": {}, "merges": [], "unk_token": None}}))
        self.normalise, self.split = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        # Initial symbols: one per byte, with the word-end form for the last. The splitter
        # shows each byte as a letter; the letter of a byte is found by asking it.
        self.byte_of = {}
        for code in [*range(128), *range(0xA0, 0x800, 0x40), *range(0x800, 0x10000, 0x800), *range(0x10000, 0x110000, 0x8000)]:
            for extra in range(0x40 if 0xA0 <= code < 0x800 else 1):
                if 0xD800 <= code + extra < 0xE000:
                    continue
                char = chr(code + extra)
                for shown, _ in self.split(char):
                    self.byte_of |= dict(zip(shown, char.encode(), strict=True))
        self.inner = np.full(256, -1, np.int64)
        self.final = np.full(256, -1, np.int64)
        for letter, byte in self.byte_of.items():
            self.inner[byte] = self.vocab.get(letter, -1)
            self.final[byte] = self.vocab.get(letter + suffix, -1)
        size = max(self.token) + 1
        self.id_text = [str(i) for i in range(size)]
        self.token_text = [self.token.get(i, "") for i in range(size)]
        pairs = [(self.vocab[a] << 32 | self.vocab[b], rank, self.vocab[a + b])
                 for rank, (a, b) in enumerate(m.split(" ") if isinstance(m, str) else m for m in model["merges"])]
        pairs.sort()
        self.pair_key = np.array([p[0] for p in pairs], np.int64)
        self.pair_rank = np.array([p[1] for p in pairs], np.int64)
        self.pair_made = np.array([p[2] for p in pairs], np.int64)

    def _lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (or _NONE) of each pair and its place in the merge table."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
        return np.where((self.pair_key[at] == key) & (left >= 0) & (right >= 0), self.pair_rank[at], _NONE), at

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word, by segment trees that advance together."""
        out: list[list[int]] = [[] for _ in words]
        by_width: dict[int, list[int]] = {}
        for i, word in enumerate(words):
            if word:
                by_width.setdefault(max(2, 1 << (len(word) - 1).bit_length()), []).append(i)
        for width, rows in by_width.items():
            step = max(1, MERGE_CELLS // width)
            for at in range(0, len(rows), step):
                part = rows[at:at + step]
                for i, ids in zip(part, self._merge([words[i] for i in part], width), strict=True):
                    out[i] = ids
        return out

    def _merge(self, words: list[bytes], width: int) -> list[list[int]]:
        n = len(words)
        lengths = np.fromiter(map(len, words), np.int64, n)
        code = np.frombuffer(b"".join(words), np.uint8)
        sym = np.full((n, width), -1, np.int64)
        sym[np.arange(width) < lengths[:, None]] = self.inner[code]
        last = np.cumsum(lengths) - 1
        sym[np.arange(n), lengths - 1] = self.final[code[last]]
        nxt = np.tile(np.arange(1, width + 1), (n, 1))
        prv = np.tile(np.arange(-1, width - 1), (n, 1))
        # tree[:, width + p] is the leaf of position p: rank * width + p, so that the minimum
        # is the lowest rank and, among equal ranks, the leftmost.
        tree = np.full((n, 2 * width), _NONE, np.int64)
        right = np.full((n, width), -1, np.int64)
        right[:, :-1] = sym[:, 1:]
        rank, _ = self._lookup(sym, right)
        tree[:, width:] = np.where(rank < _NONE, rank * width + np.arange(width), _NONE)
        node = width
        while node > 1:
            tree[:, node // 2:node] = np.minimum(tree[:, node:2 * node:2], tree[:, node + 1:2 * node:2])
            node //= 2

        live = np.flatnonzero(tree[:, 1] < _NONE)
        while live.size:
            p = tree[live, 1] % width
            q = nxt[live, p]
            _, place = self._lookup(sym[live, p], sym[live, q])
            sym[live, p] = self.pair_made[place]
            sym[live, q] = -1
            after, before = nxt[live, q], prv[live, p]
            nxt[live, p] = after
            has_after, has_before = after < width, before >= 0
            prv[live[has_after], after[has_after]] = p[has_after]
            self._point_update(tree, live, q, np.full(live.size, _NONE), width)
            value = sym[live, np.minimum(after, width - 1)]
            rank, _ = self._lookup(sym[live, p], np.where(has_after, value, -1))
            self._point_update(tree, live, p, np.where(rank < _NONE, rank * width + p, _NONE), width)
            row, b = live[has_before], before[has_before]
            rank, _ = self._lookup(sym[row, b], sym[row, p[has_before]])
            self._point_update(tree, row, b, np.where(rank < _NONE, rank * width + b, _NONE), width)
            live = live[tree[live, 1] < _NONE]
        flat = sym[sym >= 0].tolist()
        ends = np.cumsum((sym >= 0).sum(axis=1)).tolist()
        return [flat[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    @staticmethod
    def _point_update(tree: np.ndarray, rows: np.ndarray, pos: np.ndarray, value: np.ndarray, width: int) -> None:
        node = pos + width
        tree[rows, node] = value
        while width > 1:
            node = node >> 1
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
            width >>= 1

    def _split_chunk(self, chunk: str) -> list[bytes]:
        """The words of a text without blanks, as bytes."""
        if _BEYOND_LATIN.search(chunk):
            words = self.split(self.normalise(chunk))
            return [bytes(map(self.byte_of.__getitem__, word)) for word, _ in words]
        return [w.encode() for w in _WORDS.findall(unicodedata.normalize("NFC", chunk).lower())]

    def encode_chunks(self, chunks: list[str]) -> list[list[int]]:
        """Ids of texts without blanks (each may hold several words)."""
        split = list(map(self._split_chunk, chunks))
        distinct = list({w for words in split for w in words})
        ids_of = dict(zip(distinct, self.encode_words(distinct), strict=True))
        return [ids_of[words[0]] if len(words) == 1 else [i for w in words for i in ids_of[w]] for words in split]

    def encode(self, text: str | None) -> list[int]:
        """Ids of one text."""
        ids: list[int] = []
        for part in self.special_re.split(text or ""):
            if part in self.special:
                ids.append(self.special[part])
            elif part:
                chunks = [part] if _ODD_BLANKS.search(part) else part.split()
                for found in self.encode_chunks(chunks) if chunks else []:
                    ids.extend(found)
        return ids

    def decode(self, ids: list[int]) -> str:
        """Token texts joined by a blank: the vocabulary file names no decoder."""
        return " ".join([self.token_text[i] for i in ids])


@lru_cache(maxsize=2)
def load(path: str) -> Bpe:
    bpe = Bpe(path)
    release_unused()  # the parsed file
    return bpe


class _Digests:
    """Per task: the ids (32 bits each) of the chunks met lately, in two generations that share
    ``limit`` bytes: the older goes when the recent one is full."""

    def __init__(self, bpe: Bpe, limit: int):
        self.bpe, self.limit = bpe, limit
        self.recent, self.older, self.held = {}, {}, 0

    def _known(self, distinct: set[str]) -> dict[str, bytes]:
        """The ids of these chunks; those that are not among the recent ones join them."""
        known, new, late = {}, [], {}
        for chunk in distinct:
            if (entry := self.recent.get(chunk)) is not None:
                known[chunk] = entry
            elif (entry := self.older.get(chunk)) is not None:
                late[chunk] = entry
            else:
                new.append(chunk)
        if new:
            late.update(zip(new, [array("i", ids).tobytes() for ids in self.bpe.encode_chunks(new)], strict=True))
        for chunk, entry in late.items():
            self.recent[chunk] = entry
            self.held += ENTRY_BYTES + getsizeof(chunk) + getsizeof(entry)
            if 2 * self.held > self.limit:
                self.recent, self.older, self.held = {}, self.recent, 0
        return known | late

    def of(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """Number of ids, hash of the ids and hash of the tokens of each text."""
        plain = [None if "<|" in t or _ODD_BLANKS.search(t) else t.split() for t in texts]
        known = self._known(set().union(*(c for c in plain if c)))
        out = []
        for text, chunks in zip(texts, plain, strict=True):
            if chunks is None:
                ids = self.bpe.encode(text)
            else:
                ids = array("i", b"".join(map(known.__getitem__, chunks))).tolist()
            written = " ".join(map(self.bpe.id_text.__getitem__, ids))
            out.append((len(ids), hashlib.sha256(written.encode()).hexdigest(),
                        hashlib.sha256(self.bpe.decode(ids).encode("utf-8")).hexdigest()))
        return out


def round_trip(docs: DataFrame, path: str, cache_bytes: int = CACHE_BYTES) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every row of ``docs``."""

    def run(batches):
        digests = _Digests(load(path), cache_bytes)
        for batch in batches:
            for row, end, _, _ in texts_of(batch, limit=SLICE_BYTES):
                part = batch.slice(row, end - row)
                rows = digests.of([t or "" for t in part.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([r[0] for r in rows], pa.int64()),
                     pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        lean(run), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and the ids themselves, for a training set."""

    def run(batches):
        bpe = load(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([bpe.encode(t.as_py()) for t in batch.column("text")],
                                                  pa.list_(pa.int32()))], names=["doc_id", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text")).mapInArrow(run, f"doc_id {kind}, ids array<int>")

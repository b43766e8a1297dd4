"""Documents in blocks that ask the corpus about their strings and get one bit per question.

Both substring operators must know, for hashes or strings of a block, whether the rest of the
corpus has them too. A block sends its distinct questions, sorted and compressed, as one row
per range of the question space; the range's task merges the rows of all blocks and sends
each block one bit per question, in the order asked. So a string that a third of all
documents share is one question per block, and nothing grows with the square of a group.

Documents are dealt to blocks by the hash of their id and shuffled once; the exchange is
reused by every step of the one plan, and a lost executor is made good from lineage. A block
and a range hold about ``block_bytes`` of text each (a longer text is a block's own matter):
raise it with the executors' memory, as the number of rows is blocks times ranges.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_BYTES = 8 << 20
ROW_SCHEMA = "slot long, block long, kind int, payload binary"
NO_ID = np.int64(2 ** 63 - 1)  # a null doc_id counts as larger than any other


def text_bytes(docs: DataFrame) -> int:
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def blocked(docs: DataFrame, blocks: int) -> DataFrame:
    """block, doc_id, text."""
    return docs.select(F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).alias("block"), "doc_id", "text")


def pack(*arrays: np.ndarray) -> bytes:
    """Compressed columns: bytes of equal place together, so that leading zeros vanish."""
    parts = [np.array([len(a) for a in arrays], np.int64).tobytes()]
    for a in arrays:
        planes = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T if len(a) else np.zeros(0, np.uint8)
        parts.append(planes.tobytes())
    raw = b"".join(parts)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(payload: bytes, *dtypes) -> list[np.ndarray]:
    raw = pa.decompress(payload[8:], int.from_bytes(payload[:8], "little"), codec="zstd", asbytes=True)
    lengths = np.frombuffer(raw, np.int64, len(dtypes))
    out, at = [], 8 * len(dtypes)
    for n, dtype in zip(lengths.tolist(), dtypes, strict=True):
        width = np.dtype(dtype).itemsize
        planes = np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n)
        out.append(np.ascontiguousarray(planes.T).view(dtype).reshape(n))
        at += n * width
    return out


def rows(found: list[tuple[int, int, int, bytes]]) -> pa.Table:
    """Rows of ROW_SCHEMA."""
    slot, block, kind, payload = zip(*found, strict=True) if found else ([], [], [], [])
    return pa.table({"slot": pa.array(slot, pa.int64()), "block": pa.array(block, pa.int64()),
                     "kind": pa.array(kind, pa.int32()), "payload": pa.array(payload, pa.binary())})


def ids_of(docs: pa.Table) -> np.ndarray:
    return docs.column("doc_id").cast(pa.int64()).combine_chunks().fill_null(int(NO_ID)).to_numpy(zero_copy_only=False)


def ask_cells(block: int, kind: int, cells: np.ndarray, width: int, ranges: int) -> list[tuple[int, int, int, bytes]]:
    """Questions "does this cell count two or more?" for the distinct cells of a block.

    A row is the part of the block's sketch that falls on one range: the cells it counts,
    as gaps, and which of them the block itself counts twice.
    """
    own = np.sort(cells)
    first = np.ones(len(own), bool)
    first[1:] = own[1:] != own[:-1]
    at = np.flatnonzero(first)
    own, twice = own[at], np.diff(np.append(at, len(own))) > 1
    cut = np.searchsorted(own, np.arange(ranges + 1, dtype=np.uint64) * np.uint64(-(-width // ranges)))
    out = []
    for r in range(ranges):
        part = own[cut[r]:cut[r + 1]]
        if len(part):
            gaps = np.diff(part, prepend=np.uint64(0))
            out.append((kind * ranges + r, block, kind, pack(gaps, np.packbits(twice[cut[r]:cut[r + 1]]))))
    return out


def merge_cells(asked: pa.Table) -> pa.Table:
    """Add the sketches of all blocks on one range; answer one bit per cell."""
    found = asked.to_pylist()
    cells, twice = [], []
    for row in found:
        gaps, flags = unpack(row["payload"], np.uint64, np.uint8)
        cells.append(np.cumsum(gaps, dtype=np.uint64))
        twice.append(np.unpackbits(flags, count=len(gaps)).astype(bool))
    _, place, count = np.unique(np.concatenate(cells), return_inverse=True, return_counts=True)
    often = count > 1
    often[place[np.concatenate(twice)]] = True
    answers = np.split(often[place], np.cumsum(list(map(len, cells)))[:-1])
    return rows([(row["slot"], row["block"], row["kind"], pack(np.packbits(a)))
                 for row, a in zip(found, answers, strict=True)])


def answers_of(answers: pa.Table, kind: int) -> Iterator[tuple[int, bytes]]:
    """(slot, payload) of one kind, in the order of slots, which is the order of questions."""
    mine = [r for r in answers.to_pylist() if r["kind"] == kind]
    return ((r["slot"], r["payload"]) for r in sorted(mine, key=lambda r: r["slot"]))


def repeated_cells(cells: np.ndarray, answers: pa.Table, kind: int, width: int, ranges: int) -> np.ndarray:
    """For each of a block's cells, the answer to its question."""
    own, place = np.unique(cells, return_inverse=True)
    cut = np.searchsorted(own, np.arange(ranges + 1, dtype=np.uint64) * np.uint64(-(-width // ranges)))
    often = np.zeros(len(own), bool)
    for slot, payload in answers_of(answers, kind):
        r = slot - kind * ranges
        bits = unpack(payload, np.uint8)[0]
        often[cut[r]:cut[r + 1]] = np.unpackbits(bits, count=int(cut[r + 1] - cut[r])).astype(bool)
    return often[place]


def exchange(docs: DataFrame, first: Callable, merge_first: Callable, second: Callable, merge_second: Callable,
             last: Callable, schema: str) -> DataFrame:
    """Two rounds of questions and answers per block, then the block's result.

    ``first(docs)`` and ``second(docs, answers)`` return questions, ``last(docs, answers)``
    rows of ``schema``; answers are those of all rounds so far.
    """
    by_block = docs.groupBy("block")
    answers1 = by_block.applyInArrow(first, ROW_SCHEMA).groupBy("slot").applyInArrow(merge_first, ROW_SCHEMA)
    asked2 = by_block.cogroup(answers1.groupBy("block")).applyInArrow(second, ROW_SCHEMA)
    answers2 = asked2.groupBy("slot").applyInArrow(merge_second, ROW_SCHEMA)
    return by_block.cogroup(answers1.unionByName(answers2).groupBy("block")).applyInArrow(last, schema)

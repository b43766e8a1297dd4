"""Target-distribution importance resampling with bit-sliced weights.

A document's features are all runs of 1 to ``longest`` consecutive words (lower-cased A-Z;
a word is a run of bytes other than ASCII signs), hashed by CRC-32 into ``buckets`` buckets.
Every bucket has an integer gain: the scaled log ratio of its smoothed shares in the target and
in the corpus. A document's weight is the floored mean of the gains of its features. Gumbel
noise that depends on doc_id alone makes drawing the highest scores a draw without
replacement in proportion to the weights.

Bit slicing: the bucket counts of a document are cut into planes of ``buckets`` bits, plane j
holding bit j of every count; the gains are cut into signed planes (two's complement, the last
plane counts negative). The sum of gains is the sum over all pairs of planes of
popcount(count plane AND gain plane) times a power of two: integer arithmetic, exact.

Scale: both passes over the texts are maps; what crosses the network is one count per bucket
and task, and narrow rows of the documents that may be drawn. The driver holds one number per
bucket. The draw is by score: counts per score (scores are whole numbers within about 115,000
values, whatever the corpus) give the lowest drawn score and each score's first rank, and rows
of one score are ranked among themselves, equal rows as one. So no task sorts all documents.

Null text has no features and weight 0. A null doc_id draws the noise of the empty id, is
larger than any other, and rows that repeat are separate rows. Empty tables give empty
results; extra columns are ignored.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise
from .words import texts_of

BUCKETS = 10_000
LONGEST = 1
SEED = 2024
PERCENT = 10
MIN_WORDS = 20
#: Documents whose count planes are held at once.
_GROUP = 64
#: Words longer than this are hashed one by one.
_LONG = 48

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.zeros(256, bool)
_IN_WORD[48:58] = _IN_WORD[97:123] = _IN_WORD[128:] = True


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1).astype(np.uint32)
    return c


_CRC = _crc_table()


def feed(state: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 registers after the bytes data[start:end] of each row."""
    state, size = state.copy(), end - start
    for i in np.flatnonzero(size > _LONG).tolist():
        done = zlib.crc32(data[start[i]:end[i]].tobytes(), int(state[i]) ^ 0xFFFFFFFF)
        state[i] = done ^ 0xFFFFFFFF
    live = np.flatnonzero(size <= _LONG)
    for k in range(_LONG):
        live = live[size[live] > k]
        if not len(live):
            break
        now = state[live]
        state[live] = (now >> np.uint32(8)) ^ _CRC[(now & np.uint32(255)) ^ data[start[live] + k]]
    return state


def features(data: np.ndarray, offsets: np.ndarray, buckets: int, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts laid end to end: words per text, and text and bucket of every feature."""
    data = _LOWER[data]
    inside = _IN_WORD[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    at = np.searchsorted(start, offsets)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(at))
    state = feed(np.full(len(start), 0xFFFFFFFF, np.uint32), data, start, end)
    owners, found, blank = [], [], np.full(1, 32, np.uint8)
    for n in range(1, longest + 1):
        first = np.arange(max(0, len(start) - n + 1))
        first = first[owner[first] == owner[first + n - 1]]  # runs inside one text
        if n > 1:  # the register after n - 1 words goes on over a blank and the next word
            none = np.zeros(len(first), np.int64)
            spaced = feed(state[first], blank, none, none + 1)
            state[first] = feed(spaced, data, start[first + n - 1], end[first + n - 1])
        owners.append(owner[first])
        found.append(((state[first] ^ np.uint32(0xFFFFFFFF)) % np.uint32(buckets)).astype(np.int64))
    return np.diff(at), np.concatenate(owners), np.concatenate(found)


def bucket_counts(docs: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> np.ndarray:
    """How many features of all texts fall into each bucket."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, data, offsets in texts_of(batch):
                total += np.bincount(features(data, offsets, buckets, longest)[2], minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for row in docs.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row.bucket] = row.n
    return out


def gains_of(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the ratio of smoothed shares) of each bucket."""
    s, t, size = corpus.sum(), target.sum(), len(corpus)
    return np.array([math.floor(1000 * math.log(float(b + 1) * float(s + size) / (float(a + 1) * float(t + size))))
                     for a, b in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def _bits(rows: np.ndarray) -> np.ndarray:
    """Rows of 0/1 as rows of 64-bit words."""
    packed = np.packbits(rows.astype(bool), axis=1)
    return np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8))).view(np.uint64)


def gain_planes(gains: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(signed power of two, plane) of the two's complement of the gains."""
    width = max(int(np.abs(gains).max(initial=0)).bit_length(), 1) + 1
    planes = _bits((gains[None, :] >> np.arange(width)[:, None]) & 1)
    return [(-(1 << k) if k == width - 1 else 1 << k, planes[k]) for k in range(width) if planes[k].any()]


def gain_sums(counts: np.ndarray, planes: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """Sum of gains of each row of bucket counts, by planes."""
    total = np.zeros(len(counts), np.int64)
    for j in range(int(counts.max(initial=0)).bit_length()):
        plane = _bits((counts >> j) & 1)
        for power, gain in planes:
            total += (power << j) * np.bitwise_count(plane & gain).sum(axis=1, dtype=np.int64)
    return total


def weigh(docs: DataFrame, gains: np.ndarray, longest: int = LONGEST) -> DataFrame:
    """doc_id, n_words, n_features, weight for every row of ``docs``."""
    buckets = len(gains)
    planes = gain_planes(gains)

    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id")
            for row, end, data, offsets in texts_of(batch):
                words, owner, bucket = features(data, offsets, buckets, longest)
                order = np.argsort(owner, kind="stable")
                owner, bucket = owner[order], bucket[order]
                sizes, sums = np.bincount(owner, minlength=end - row), np.zeros(end - row, np.int64)
                for lo in range(0, end - row, _GROUP):
                    n = min(_GROUP, end - row - lo)
                    mine = slice(*np.searchsorted(owner, [lo, lo + n]))
                    counts = np.bincount((owner[mine] - lo) * buckets + bucket[mine], minlength=n * buckets)
                    sums[lo:lo + n] = gain_sums(counts.reshape(n, buckets), planes)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(row, end - row), pa.array(words.astype(np.int64)), pa.array(sizes.astype(np.int64)),
                     pa.array(sums // np.maximum(sizes, 1))], names=["doc_id", "n_words", "n_features", "weight"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words long, n_features long, weight long")


def gumbel(seed: int):
    """Whole-number Gumbel noise of a doc_id."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def draw(scored: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """Ranks of the drawn: of the N rows with enough words the floor(percent N / 100) highest scores.

    ``scored`` has doc_id, n_words, n_features, weight, score and is read several times.
    """
    fit = F.col("n_words") >= min_words
    above = Window.orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(1))
    # One row per score: at most about 115,000, as gains and noise are bounded whole numbers.
    per_score = scored.where(fit).groupBy("score").agg(F.count(F.lit(1)).alias("n"))
    places = (per_score.withColumns({"before": F.coalesce(F.sum("n").over(above), F.lit(0)),
                                     "k": F.floor(F.sum("n").over(every) * percent / F.lit(100)).cast("long")})
              .where("before < k").select(F.col("score").alias("p_score"), "before", "k"))
    marked = scored.join(F.broadcast(places), fit & (F.col("score") == F.col("p_score")), "left")
    columns = ["doc_id", "n_features", "weight", "score"]
    # Rows that are alike are ranked as one and dealt out again.
    alike = marked.where("k is not null").groupBy(*columns, "before", "k").agg(F.count(F.lit(1)).alias("n"))
    within = (Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last(), "n_features", "weight")
              .rowsBetween(Window.unboundedPreceding, -1))
    ranked = (alike.withColumn("first", F.col("before") + F.coalesce(F.sum("n").over(within), F.lit(0)) + 1)
              .select(*columns, "k", F.explode(F.sequence("first", F.col("first") + F.col("n") - 1)).alias("place"))
              .select(*columns, F.when(F.col("place") <= F.col("k"), F.col("place")).alias("rank")))
    return ranked.unionByName(marked.where("k is null").select(*columns, F.lit(None).cast("long").alias("rank")))


def resample(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST, seed: int = SEED,
             percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, n_features, weight, score, rank (null: not drawn) for every row of ``docs``, drawn
    towards the texts of ``target``."""
    gains = gains_of(bucket_counts(docs, buckets, longest), bucket_counts(target, buckets, longest))
    scored = materialise(weigh(docs, gains, longest).withColumn("score", F.col("weight") + gumbel(seed)))
    return draw(scored, percent, min_words)

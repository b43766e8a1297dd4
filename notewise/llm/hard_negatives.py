"""Hard-negative mining by a secondary-sort shuffle.

Every row of an anchor's own label may be one of its positives: the first ``positives`` by
score (integer inner product with the anchor, higher first, ties by smaller id). A positive
with score p opens the window low * p <= 100 * s <= high * p; its negatives are the first
``negatives`` rows of other labels whose score s lies in it.

Secondary sort: scored pairs carry the packed key (anchor, descending score, kind, id); they
are dealt out by anchor and sorted within partitions, and an iterator reads them as a
stream: a positive opens its window, a negative is given to every open window that it falls
into, a window closes when it is full or the scores fall below it. What is kept at a time is one
anchor's open windows, never an anchor's rows. At equal scores positives come before
negatives, since a window includes its positive's score.

Scale: anchors and rows meet in tasks of bounded size (chunk of anchors, chunk of rows), dealt
by a hash, so neither a hot label nor a hot id gathers anywhere. The scores of a task are
matrix products over slices. Before the shuffle a task combines without loss: of positives
only its own first ones can be among the first of all; once those are known, only the first
rows of each window can be returned. So an anchor has at most positives * (1 + negatives) rows
from each chunk of rows, not one per row. Work grows with anchors times rows, as every
anchor is searched against the whole table.

A component x becomes floor(scale * x). Rows with a null label or vector or with a null or
non-finite component take no part; an empty vector scores 0 with everything, and where vectors
differ in length the missing components count as 0. Rows that repeat an id are rows of their own
(one is a candidate for the other). A null id is never an anchor and comes after all
others. Scores are exact while they fit in 64 bits. Empty tables give empty results; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, n_blocks

SCALE = 256
POSITIVES = 5
NEGATIVES = 5
LOW, HIGH = 80, 100
#: Rows and anchors that meet in a task at most.
ROWS_PER_TASK = 8192
ANCHORS_PER_TASK = 4096
#: Scores held at once.
_SCORES = 1 << 21
_NO_ID = np.iinfo(np.int64).max
_PAIR = "anchor long, anchor_id long, score long, kind int, id long"


def prepare(vectors: DataFrame, anchors: Column, label: Column, scale: int = SCALE) -> DataFrame:
    """uid, id, label, anchor, vector (integers) of the rows that take part, read from a checkpoint.

    ``anchors`` and ``label`` are expressions on the rows of ``vectors`` (vec_id, embedding, label).
    """
    wide = F.transform("embedding", lambda x: x.cast("double"))
    sound = ~F.exists(wide, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return materialise(
        vectors.where(F.col("embedding").isNotNull() & F.col("label").isNotNull() & sound)
        .select(F.monotonically_increasing_id().alias("uid"), F.col("vec_id").cast("long").alias("id"), label.alias("label"),
                F.coalesce(anchors, F.lit(False)).alias("anchor"),
                F.transform(wide, lambda x: F.floor(F.lit(float(scale)) * x).cast("long")).alias("vector")))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors as rows; missing components are 0."""
    lists = column.combine_chunks()
    flat, ends = lists.flatten().to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
    size = np.diff(ends)
    width = int(size.max(initial=0))
    out = np.zeros((len(size), width), np.int64)
    out[np.arange(width)[None, :] < size[:, None]] = flat
    return out


def _scores(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Inner products; by floating point where that is exact."""
    width = min(left.shape[1], right.shape[1])
    left, right = left[:, :width], right[:, :width]
    most = float(np.abs(left).max(initial=0)) * float(np.abs(right).max(initial=0)) * width
    if most < 2.0 ** 53:
        return (left.astype(np.float64) @ right.T.astype(np.float64)).astype(np.int64)
    return left @ right.T


def _first(score: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """The first n of the places ``at`` by score, ties in the order of places."""
    if len(at) > n:
        least = np.partition(score[at], len(at) - n)[len(at) - n]
        at = at[score[at] >= least]
    return at[np.lexsort((at, -score[at]))][:n]


def _meet(anchors: DataFrame, rows: DataFrame, pick, a_chunks: int, r_chunks: int) -> DataFrame:
    """Rows of _PAIR that ``pick`` chooses for each anchor in each chunk of rows.

    pick(anchor table, i, scores, row labels, row uids) gives places of rows and their kind.
    """

    def task(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], [], []]
        if left.num_rows and right.num_rows:
            ids = right.column("id").fill_null(int(_NO_ID)).to_numpy()
            order = np.argsort(ids, kind="stable")
            ids, label = ids[order], right.column("label").to_numpy()[order]
            uid, matrix = right.column("uid").to_numpy()[order], _matrix(right.column("vector"))[order]
            mine, own = _matrix(left.column("vector")), left.drop_columns(["vector"]).to_pydict()
            step = max(1, _SCORES // len(ids))
            for lo in range(0, len(mine), step):
                for i, score in enumerate(_scores(mine[lo:lo + step], matrix), lo):
                    for kind, at in pick(own, i, score, label, uid):
                        out[0].append(np.full(len(at), own["uid"][i]))
                        out[1].append(np.full(len(at), own["id"][i]))
                        out[2].append(score[at])
                        out[3].append(np.full(len(at), kind))
                        out[4].append(ids[at])
        flat = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in out]
        missing = pa.array(flat[4], mask=flat[4] == _NO_ID, type=pa.int64())
        return pa.table({"anchor": pa.array(flat[0], pa.int64()), "anchor_id": pa.array(flat[1], pa.int64()),
                         "score": pa.array(flat[2], pa.int64()), "kind": pa.array(flat[3], pa.int32()), "id": missing})

    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    chunk = lambda n: F.pmod(F.xxhash64("uid"), F.lit(n)).cast("int")
    own = anchors.select(*[F.col(c).alias(c) for c in anchors.columns])  # both sides come from one table
    left = own.withColumn("a_chunk", chunk(a_chunks)).withColumn("r_chunk", every(r_chunks))
    right = rows.drop("anchor").withColumn("r_chunk", chunk(r_chunks)).withColumn("a_chunk", every(a_chunks))
    return (left.groupBy("a_chunk", "r_chunk").cogroup(right.groupBy("a_chunk", "r_chunk"))
            .applyInArrow(task, _PAIR))


def windows(pairs: Iterator[tuple], negatives: int, positives: int, low: int, high: int) -> Iterator[tuple]:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) from sorted pairs
    (anchor, anchor_id, score, kind, id): positives of kind 0, negatives of kind 1."""
    now, opened, seen = None, [], 0
    for anchor, anchor_id, score, kind, other in pairs:
        if anchor != now:
            now, opened, seen = anchor, [], 0
        if kind == 0:
            if seen < positives:
                opened.append([score, other, 0])
            seen += 1
            continue
        done = False
        for window in opened:
            top, positive, n = window
            if n < negatives and low * top <= 100 * score <= high * top:
                window[2] += 1
                yield anchor_id, positive, n + 1, other, top, score
            done |= window[2] >= negatives or 100 * score < low * top
        if done:
            opened = [w for w in opened if w[2] < negatives and 100 * score >= low * w[0]]


def mine(rows: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of the rows of ``prepare``."""
    if not 0 < low <= high <= 100:
        raise ValueError("windows lie at or below their positive's score: 0 < low <= high <= 100")
    anchors = rows.where("anchor").drop("anchor")
    n_rows, n_anchors = rows.agg(F.count(F.lit(1)), F.count_if("anchor")).first()
    chunks = (n_blocks(n_anchors, ANCHORS_PER_TASK), n_blocks(n_rows, ROWS_PER_TASK))

    def same_label(own, i, score, label, uid):
        return [(0, _first(score, np.flatnonzero((label == own["label"][i]) & (uid != own["uid"][i])), positives))]

    def in_windows(own, i, score, label, uid):
        other = label != own["label"][i]
        found = []
        for top in set(own["tops"][i]):
            inside = other & (100 * score >= low * top) & (100 * score <= high * top)
            found.append(_first(score, np.flatnonzero(inside), negatives))
        return [(1, np.unique(np.concatenate(found)))]

    order = [F.col("score").desc(), F.col("id").asc_nulls_last()]
    first = materialise(_meet(anchors, rows, same_label, *chunks)
                        .withColumn("place", F.row_number().over(Window.partitionBy("anchor").orderBy(*order)))
                        .where(F.col("place") <= positives).drop("place"))
    tops = first.groupBy("anchor").agg(F.collect_list("score").alias("tops"))
    opened = anchors.join(tops.withColumnRenamed("anchor", "uid"), "uid")
    pairs = first.unionByName(_meet(opened, rows, in_windows, *chunks))
    packed = pairs.select("anchor_id", "score", F.struct(
        "anchor", (-F.col("score")).alias("falling"), "kind", F.col("id").isNull().alias("none"), "id").alias("key"))
    dealt = packed.repartition(F.col("key.anchor")).sortWithinPartitions("key")

    def stream(batches):
        def read():
            for batch in batches:
                columns = batch.to_pydict()
                yield from ((k["anchor"], a, s, k["kind"], k["id"]) for k, a, s in
                            zip(columns["key"], columns["anchor_id"], columns["score"], strict=True))

        def batch_of(found):
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)], names=names)

        names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        held = []
        for row in windows(read(), negatives, positives, low, high):
            held.append(row)
            if len(held) == 10_000:
                yield batch_of(held)
                held = []
        if held:
            yield batch_of(held)

    return dealt.mapInArrow(stream, "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")

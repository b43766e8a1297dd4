"""Approximate nearest neighbours with a hierarchical k-means tree and best-bin-first search.

Fit: a k-means tree is built from at most ``sample_rows`` vectors (those whose ids have the
smallest hash), so it has a bounded number of leaves. Calibrate: queries of that sample walk
the tree with a priority queue, best bin first, and the number of leaves to visit is widened
until the sample's exact neighbours are found with ``target`` recall. Index: every vector
goes to a leaf. Search: every query walks the tree the same way, visits at least that many
leaves and as many more as it takes to meet k candidates, and is compared with every vector
of the leaves it visits; its best k are kept.

Scale: the vectors of a leaf are cut into chunks and the queries that visit it too, so a
task compares bounded blocks however common a vector or a leaf is (leaf counts, at most one
per leaf, reach the driver). Each block returns k rows a query; the rest is a top-k by query.

Nearness is the inner product of the original vectors in double precision, ties to the
smaller id. Vectors that are null, all zero, of another length than most of the sample's, or
hold null or non-finite components take no part, nor do rows with a null id; rows that
repeat an id are one vector, the smallest array. Extra columns are ignored.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

SAMPLE_ROWS = 16384
LEAF_ROWS = 128
BRANCHES = 8
TARGET = 0.95
CALIBRATION_QUERIES = 256
CHUNK_VECTORS = 4096
CHUNK_QUERIES = 1024


@dataclass
class Tree:
    """Node i has centre centres[i] and children children[i] (none: leaf number leaf[i])."""

    centres: np.ndarray
    children: list[np.ndarray]
    leaf: np.ndarray
    leaves: int
    visits: int = 1
    counts: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    def assign(self, x: np.ndarray) -> np.ndarray:
        """Leaf number of each row: down the tree to the nearest centre."""
        out = np.empty(len(x), np.int64)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            kids = self.children[node]
            if not len(kids):
                out[rows] = self.leaf[node]
            elif len(rows):
                c = self.centres[kids]
                near = np.argmin((c * c).sum(1) - 2 * (x[rows] @ c.T), axis=1)
                todo.extend((int(kids[b]), rows[near == b]) for b in range(len(kids)))
        return out

    def best_bins(self, q: np.ndarray):
        """Leaf numbers in best-bin-first order."""
        queue = [(0.0, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            kids = self.children[node]
            if not len(kids):
                yield int(self.leaf[node])
                continue
            for score, kid in zip((self.centres[kids] @ q).tolist(), kids.tolist(), strict=True):
                heapq.heappush(queue, (-score, kid))

    def visit(self, q: np.ndarray, k: int) -> list[int]:
        """The leaves a query visits: the calibrated number, and until k other rows are met."""
        out, met = [], 0
        for leaf in self.best_bins(q):
            if len(out) >= self.visits and met > k:
                break
            if self.counts[leaf]:
                out.append(leaf)
                met += int(self.counts[leaf])
        return out


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """Cluster number of each row (Lloyd's rounds from k different rows)."""
    centres = x[rng.choice(len(x), k, replace=False)]
    near = np.zeros(len(x), np.int64)
    for _ in range(rounds):
        now = np.argmin((centres * centres).sum(1) - 2 * (x @ centres.T), axis=1)
        if (now == near).all():
            break
        near = now
        for b in range(k):
            if (near == b).any():
                centres[b] = x[near == b].mean(0)
    return near


def fit(x: np.ndarray, leaf_rows: int = LEAF_ROWS, branches: int = BRANCHES, seed: int = 5) -> Tree:
    """The tree of a sample; a node whose rows are all alike is a leaf."""
    rng = np.random.default_rng(seed)
    centres, children, leaf, leaves = [x.mean(0)], [np.zeros(0, np.int64)], [-1], 0
    todo = [(0, np.arange(len(x)))]
    while todo:
        node, rows = todo.pop()
        near = _kmeans(x[rows], min(branches, len(rows)), rng) if len(rows) > leaf_rows else np.zeros(len(rows), np.int64)
        parts = [rows[near == b] for b in np.unique(near)]
        if len(parts) < 2:
            leaf[node] = leaves
            leaves += 1
            continue
        kids = []
        for part in parts:
            kids.append(len(centres))
            centres.append(x[part].mean(0))
            children.append(np.zeros(0, np.int64))
            leaf.append(-1)
            todo.append((kids[-1], part))
        children[node] = np.array(kids)
    return Tree(np.array(centres), children, np.array(leaf), leaves)


def calibrate(tree: Tree, x: np.ndarray, k: int, target: float = TARGET, queries: int = CALIBRATION_QUERIES) -> int:
    """Leaf visits at which the sample's own neighbours are found with the target recall."""
    at = np.arange(0, len(x), max(1, len(x) // queries))[:queries]
    home = tree.assign(x)
    scores = x[at] @ x.T
    scores[np.arange(len(at)), at] = -np.inf
    k = min(k, len(x) - 1)
    if k < 1:
        return 1
    found = np.zeros(tree.leaves + 1)  # neighbours found by the n-th visit, over all queries
    for row, q in enumerate(at):
        best = np.argpartition(-scores[row], k - 1)[:k]
        turn = np.empty(tree.leaves, np.int64)
        for n, leaf in enumerate(tree.best_bins(x[q]), 1):
            turn[leaf] = n
        np.add.at(found, turn[home[best]], 1)
    recall = np.cumsum(found) / (len(at) * k)
    return int(np.argmax(recall >= target)) or 1


def _usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(vector, lambda v: v != 0)


def usable_vectors(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id, vector of the rows that take part, one per id."""
    rows = (table.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"))
            .where(F.col("id").isNotNull() & _usable(F.col("vector"))))
    again = rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id")
    if again.isEmpty():
        return rows
    once = rows.join(again, "id", "left_semi").groupBy("id").agg(F.min("vector").alias("vector"))
    return rows.join(again, "id", "left_anti").unionByName(once)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.flatten()
    return np.asarray(flat, dtype=np.float64).reshape(-1, dim)


def _top(scores: np.ndarray, k: int) -> np.ndarray:
    """Places whose score is among the k best, or within rounding of the k-th."""
    if len(scores) <= k:
        return np.arange(len(scores))
    edge = np.partition(scores, len(scores) - k)[len(scores) - k]
    return np.flatnonzero(scores >= edge - 1e-9 * max(1.0, abs(edge)))


def search(table: DataFrame, queries: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding",
           sample_rows: int = SAMPLE_ROWS, target: float = TARGET) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every row for which ``queries``
    (a condition on the column id) holds."""
    result = "query_id long, rank int, vec_id long, score double"
    spark = table.sparkSession
    rows = usable_vectors(table, id_col, vector_col)
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(sample_rows).toPandas()  # sample_rows at most
    if sample.empty:
        return spark.createDataFrame([], result)
    dim = int(sample["vector"].map(len).mode()[0])
    x = np.array([v for v in sample["vector"] if len(v) == dim], dtype=np.float64)
    rows = rows.where(F.size("vector") == dim)
    tree = fit(x)
    tree.visits = calibrate(tree, x, k, target)

    def index(batches):
        for batch in batches:
            leaves = tree.assign(_matrix(batch.column("vector"), dim))
            yield pa.RecordBatch.from_arrays([pa.array(leaves, pa.int64()), batch.column("id"), batch.column("vector")],
                                             names=["leaf", "id", "vector"])

    kind = dict(rows.dtypes)["vector"]
    indexed = rows.mapInArrow(index, f"leaf long, id long, vector {kind}")
    tree.counts = np.zeros(tree.leaves, np.int64)
    for leaf, n in indexed.groupBy("leaf").count().collect():  # one row per leaf of the bounded tree
        tree.counts[leaf] = n

    def walk(batches):
        for batch in batches:
            where = [tree.visit(q, k) for q in _matrix(batch.column("vector"), dim)]
            at = np.repeat(np.arange(batch.num_rows), list(map(len, where)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([np.array(w, np.int64) for w in where]) if where else [], pa.int64()),
                 batch.column("id").take(pa.array(at)), batch.column("vector").take(pa.array(at))],
                names=["leaf", "id", "vector"])

    visits = materialise(rows.where(queries).mapInArrow(walk, f"leaf long, id long, vector {kind}"))
    asked = np.zeros(tree.leaves, np.int64)
    for leaf, n in visits.groupBy("leaf").count().collect():
        asked[leaf] = n
    v_parts = np.maximum(1, -(-tree.counts // CHUNK_VECTORS))
    q_parts = np.maximum(1, -(-asked // CHUNK_QUERIES))

    # Chunk numbers per leaf, as a table of one row per leaf.
    parts = F.broadcast(spark.createDataFrame(
        [(i, int(v_parts[i]), int(q_parts[i])) for i in range(tree.leaves) if asked[i]], "leaf long, vp int, qp int"))
    spread = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = (indexed.join(parts, "leaf").withColumn("vc", spread("vp")).withColumn("qc", every("qp"))
            .select("leaf", "vc", "qc", "id", "vector"))
    right = (visits.join(parts, "leaf").withColumn("qc", spread("qp")).withColumn("vc", every("vp"))
             .select("leaf", "vc", "qc", "id", "vector"))

    def compare(vectors: pa.Table, asking: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score"]
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if vectors.num_rows and asking.num_rows:
            v, q = (_matrix(t.column("vector").combine_chunks(), dim) for t in (vectors, asking))
            v_id, q_id = (t.column("id").to_numpy() for t in (vectors, asking))
            for at in range(0, len(q), 256):
                scores = q[at:at + 256] @ v.T
                for i, row in enumerate(scores, at):
                    row[v_id == q_id[i]] = -np.inf
                    near = _top(row, k)
                    near = near[v_id[near] != q_id[i]]
                    # Summed alike for every vector, so that equal vectors have equal scores.
                    exact = (v[near] * q[i]).sum(axis=1)
                    best = np.lexsort((v_id[near], -exact))[:k]
                    out.append((np.full(len(best), q_id[i]), v_id[near][best], exact[best]))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [[], [], []]
        return pa.table([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()),
                         pa.array(columns[2], pa.float64())], names=names)

    keys = ["leaf", "vc", "qc"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(
        compare, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))

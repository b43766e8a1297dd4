"""Connected components by alternating large-star and small-star steps, in DataFrames.

A step replaces every edge by one to the smallest neighbour; the number of steps grows with
the logarithm of a component's diameter. Minima are aggregated map-side, and the joins back
shuffle both sides, so that a node with very many edges can be split. Every step is cut off
with a checkpoint in the shared folder; the driver sees two numbers per step.

Nodes that are numbers (others may be of any length): before each step a task joins what
``BLOCK_EDGES`` edges at a time connect and returns stars, so that paths get short; edges that
fit one block are done then, without a step. These tables of edges are read in as many tasks as
they have blocks, not in one per shuffle partition.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, materialise, n_blocks

#: What a task joins at once: edges, of 16 bytes each.
BLOCK_EDGES = 1 << 16


def smallest_reached(size: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For each of ``size`` nodes the smallest one that the edges connect it with."""
    label = np.arange(size)
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        for at in (left, right, label[left], label[right]):
            np.minimum.at(new, at, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _stars(block: int):
    """Edges (u, v) as stars: every node of ``block`` edges or fewer with the smallest that it reaches."""

    def run(batches):
        held, n = [], 0
        for batch in itertools.chain(batches, [None]):
            for part in [batch.slice(at, block) for at in range(0, batch.num_rows, block)] if batch is not None else [None]:
                if n and (part is None or n + part.num_rows > block):
                    nodes, ends = np.unique(np.concatenate(held, axis=1), return_inverse=True)
                    left, right = ends.reshape(2, -1)
                    least = smallest_reached(len(nodes), left, right)
                    other = np.flatnonzero(least != np.arange(len(nodes)))
                    yield pa.RecordBatch.from_arrays([pa.array(nodes[x], pa.int64()) for x in (other, least[other])], names=["u", "v"])
                    held, n = [], 0
                if part is not None:
                    held.append(np.array([part.column(c).to_numpy() for c in ("u", "v")], np.int64))
                    n += part.num_rows

    return run


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def _to_smallest(edges: DataFrame, key: str, other: str) -> DataFrame:
    """u, v, m: the edges of ``key`` with its smallest neighbour (or itself)."""
    least = edges.groupBy(key).agg(F.min(other).alias("m")).select(
        F.col(key).alias("k"), F.least(F.col(key), F.col("m")).alias("m"))
    return edges.join(least, F.col(key) == F.col("k")).drop("k")


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node) for every node of ``edges`` (columns u and v).

    Self loops, repeated edges and edges with a null end are ignored; nodes without an edge
    are not listed.
    """
    now = materialise(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    numbers = [kind for _, kind in now.dtypes] == ["bigint"] * 2
    mark = _mark(now)
    while mark[0]:
        blocks = n_blocks(mark[0], BLOCK_EDGES)
        if numbers:
            now = materialise(now.coalesce(blocks).mapInArrow(lean(_stars(BLOCK_EDGES)), "u long, v long"))
            if blocks == 1:
                break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (_to_smallest(both, "u", "v").where("v > u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        small = _to_smallest(large, "u", "v")
        now = materialise(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                          .unionByName(small.select("u", F.col("m").alias("v"))).distinct())
        after = _mark(now)
        if after == mark:
            break
        mark = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())

"""Helpers shared by the operators of this package."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir

WS_CLASS = r"\x20\x09-\x0D"  # the six ASCII blanks; every other character is part of a word
_WS_CHARS = " \t\n\x0b\x0c\r"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z only; null becomes the empty text."""
    return F.translate(F.coalesce(col, F.lit("")), _UPPER, _UPPER.lower())


def word_count(col: Column) -> Column:
    """Number of words (runs of anything but the six ASCII blanks); 0 for null."""
    body = F.btrim(F.coalesce(col, F.lit("")), F.lit(_WS_CHARS))
    return F.when(body == "", F.lit(0)).otherwise(F.size(F.split(body, f"[{WS_CLASS}]+"))).cast("long")


def materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the cluster's shared folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def release_unused() -> None:
    """Give memory that this process has freed back to the system (Arrow's own, and malloc's)."""
    for pool in (pa.default_memory_pool(), pa.system_memory_pool()):
        pool.release_unused()


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """``run`` for mapInArrow. A Python worker outlives its task, and what it freed but kept
    would count beside the memory of the stages that follow."""

    def task(batches):
        yield from run(batches)
        release_unused()

    return task


def n_blocks(rows: int, per_block: int) -> int:
    """How many blocks of about ``per_block`` rows hold ``rows`` rows (at least one)."""
    return max(1, math.ceil(rows / per_block))


def keep_rows(docs: DataFrame, stay: DataFrame, digest: Column) -> DataFrame:
    """The rows of ``docs`` that are in ``stay`` (doc_id, digest: one row per row of ``docs``
    that may stay), all columns; rows that repeat both doc_id and digest stay once.

    ``digest`` is computed from a row of ``docs`` and tells texts of one doc_id apart. The text
    moves once, against narrow rows; only when rows repeat do these take the second path.
    """
    listed = materialise(stay.groupBy(F.col("doc_id").alias("k_id"), F.col("digest").alias("k_digest"))
                         .agg((F.count(F.lit(1)) > 1).alias("k_again")))
    # The digest is in the join key, so rows that share a doc_id (or have none) are spread.
    same = F.col("doc_id").eqNullSafe(F.col("k_id")) & (F.col("k_own") == F.col("k_digest"))
    own = docs.withColumn("k_own", digest)
    kept = lambda again: own.join(listed.where(F.col("k_again") == again).hint("shuffle_hash"), same, "left_semi")
    single = kept(False).drop("k_own")
    if listed.where("k_again").isEmpty():
        return single
    return single.unionByName(kept(True).dropDuplicates(["doc_id", "k_own"]).drop("k_own"))

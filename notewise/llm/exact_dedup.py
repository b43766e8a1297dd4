"""Exact dedup by progressive refinement: length, then prefix hash, then full hash.

Each level only looks at rows whose group is still larger than one. Levels one and two move
(doc_id, length, 64-bit prefix hash) and never the text; the text of a row is moved and
hashed in full only when another row shares both its length and its prefix hash.

Texts are equal when identical after lower-casing A-Z; null counts as empty. Of equal texts
the row with the largest doc_id stays (a null doc_id is smaller than any other). Rows that
repeat both doc_id and text belong to one document: all of them carry the same verdict.
Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, keep_rows, materialise

PREFIX_CHARS = 128


def _keys(id_col: str, text_col: str, prefix_chars: int) -> list[Column]:
    """doc_id, byte length and prefix hash: a lower-cased ASCII letter keeps its length."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return [
        F.col(id_col).alias("doc_id"),
        F.octet_length(text).cast("long").alias("len"),
        F.xxhash64(ascii_lower(F.substring(text, 1, prefix_chars))).alias("pre"),
    ]


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    text_sha256 is the SHA-256 of the row's own normalised text. It is carried along with the
    row, as a doc_id may have several texts; a caller that does not read it does not pay for it.
    """
    keyed = docs.select(*_keys(id_col, text_col, prefix_chars))

    # Level 1 and 2 keep the rows of groups of two or more. A group's row is only
    # (key, count), so the join moves narrow rows, and AQE can split a hot length.
    by_len = keyed.groupBy("len").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("len")
    level1 = keyed.join(by_len, "len", "left_semi")
    by_pre = (level1.groupBy("len", "pre").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
              .select(F.col("pre").alias("k_pre"), F.col("len").alias("k_len")))
    # pre alone is the join key: the aggregate is partitioned by (len, pre), so both sides
    # are shuffled for the join and a hot prefix can be split.
    level2 = level1.join(by_pre, (F.col("pre") == F.col("k_pre")) & (F.col("len") == F.col("k_len")),
                         "left_semi").select(F.col("doc_id").alias("s_id"), F.col("len").alias("s_len"),
                                             F.col("pre").alias("s_pre")).distinct()

    # Level 3: the full text of the survivors, moved and hashed once.
    full = materialise(docs.select(*_keys(id_col, text_col, prefix_chars), F.col(text_col).alias("text"))
            .join(level2.hint("shuffle_hash"),
                  F.col("doc_id").eqNullSafe(F.col("s_id")) & (F.col("len") == F.col("s_len"))
                  & (F.col("pre") == F.col("s_pre")), "left_semi")
            .select("doc_id", "len", F.sha2(ascii_lower(F.col("text")), 256).alias("sha")))
    groups = (full.groupBy("len", "sha")
              .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
              .select(F.col("sha").alias("g_sha"), "keep_id", "group_size"))
    same = (full.join(groups, F.col("sha") == F.col("g_sha"))
            .select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
                    F.col("sha").alias("text_sha256")))
    hashed = docs.select(*_keys(id_col, text_col, prefix_chars), F.sha2(ascii_lower(F.col(text_col)), 256).alias("text_sha256"))
    alone = (hashed.join(level2, F.col("doc_id").eqNullSafe(F.col("s_id")) & (F.col("len") == F.col("s_len"))
                        & (F.col("pre") == F.col("s_pre")), "left_anti")
             .select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
                     F.lit(True).alias("kept"), "text_sha256"))
    return alone.unionByName(same)


def with_text_hash(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """The rows of ``groups`` (of ``docs``) with text_sha256: one row per row of ``docs``."""
    return groups.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; rows that repeat both doc_id and
    text stay once."""
    stay = duplicate_groups(docs).where("kept").select("doc_id", F.col("text_sha256").alias("digest"))
    return keep_rows(docs, stay, F.sha2(ascii_lower(F.col("text")), 256))

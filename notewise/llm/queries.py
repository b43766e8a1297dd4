"""One registered query per operator: the whole intended table, the full result."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir
from . import ann_tree, bpe, chat_format, exact_dedup, hard_negatives, importance, mixing, parity_join, secret_ledger, sketch_dedup, suffix_dedup, toxicity, url_filter
from .common import read_table


def op1_ann_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann_tree.search(read_table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(read_table(spark, sf_dir, "documents"), texts=False).drop("kept")


def op3_sketch_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch_dedup.dedup(read_table(spark, sf_dir, "documents"), texts=False).drop("kept")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(read_table(spark, sf_dir, "pages"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return exact_dedup.with_text_hash(docs, exact_dedup.duplicate_groups(docs))


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents"))


def op7_parity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parity_join.components_and_links(read_table(spark, sf_dir, "documents"))


def op8_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A first run: the ledger starts empty, in a folder of its own."""
    ledger = f"{checkpoint_dir(spark)}/secret-ledger-{uuid.uuid4().hex}"
    return secret_ledger.scan_paths(read_table(spark, sf_dir, "documents"), ledger)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.learn(docs, read_table(spark, sf_dir, "labels")))


def tokenizer_path() -> str:
    """The vocabulary file, installed on every machine; never copied into this repository."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(read_table(spark, sf_dir, "documents"), tokenizer_path())


def chat_vocabulary() -> tuple[str, str]:
    """File and pattern of the byte-level vocabulary, installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one, -1, whose texts consist of control strings."""
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("<|im_end|><|im_start|>assistant ok").alias("text"))
    path, pattern = chat_vocabulary()
    return chat_format.read_back(chat_format.format_conversations(turns.unionByName(tricky), path, pattern), path, pattern)


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(hard_negatives.prepare(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ann_tree": op1_ann_tree,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_sketch_dedup": op3_sketch_dedup,
    "op4_url_filter": op4_url_filter,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_source_mix": op6_source_mix,
    "op7_parity_join": op7_parity_join,
    "op8_secret_ledger": op8_secret_ledger,
    "op9_toxicity": op9_toxicity,
    "op10_bpe": op10_bpe,
    "op11_chat_format": op11_chat_format,
    "op12_importance": op12_importance,
    "op13_hard_negatives": op13_hard_negatives,
}

"""Mixing sources to target weights by a low-discrepancy source schedule.

The mix is a sequence of slots of ``block_tokens`` words. Slot i gets the golden-ratio point
frac(i * phi), which is mapped through the cumulative weights of the sources; the slots of a
source are ranked, and rank r takes block r of the source's shuffled documents (the shuffled
order is read again from its start when the target exceeds the source). Everything is native
DataFrame code.

Scale: slot ranks and positions within a source are two-level prefix sums (chunks of slots,
hash ranges of documents), so a source with a third of all rows is never one task. Ranks and
documents meet on (source, block), a fine-grained key.

Definitions: a document's size is its number of words (null text: 0). Sources are ordered by
code point with null last and weigh 5, 2, 1, repeating. Together they take 150% of all
words; a target stops at twice its source's size, and the excess is shared again by weight.
Documents without words take nothing. Repeated rows are separate rows with the same id.
Empty tables give empty results; extra columns are ignored. The shuffled order depends on
doc_id and the seed alone, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, n_blocks, word_count

BLOCK_TOKENS = 512
DOCS_PER_RANGE = 2048
SLOTS_PER_CHUNK = 4096
_MODULUS = 2 ** 31
_STEP = 1327217885  # 2**31 / golden ratio, odd: i * _STEP mod 2**31 walks the golden points


def _source_key(source: Column) -> Column:
    """A key that is never null, so that the null source joins like any other."""
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source))


def sized_documents(docs: DataFrame) -> DataFrame:
    """uid, doc_id, source, skey, size, h: one narrow row per document, read from a checkpoint."""
    return materialise(docs.select(
        F.monotonically_increasing_id().alias("uid"), "doc_id", "source",
        _source_key(F.col("source")).alias("skey"), word_count(F.col("text")).alias("size")))


def source_targets(sized: DataFrame, weights=(5, 2, 1), share: float = 1.5, repeat_cap: float = 2.0) -> DataFrame:
    """One row per source: skey, source_size, target (double), take (whole words).

    A target is min(cap, level * weight) for the one level at which the targets sum to the
    share: with sources ordered by cap / weight, the level is found where capping all
    sources before it leaves the rest below their caps.
    """
    per = sized.groupBy("skey", "source").agg(F.sum("size").alias("source_size"))
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    pos = (F.row_number().over(in_order) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (pos + 1).cast("int"))
    fill = Window.orderBy("q", "skey").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(1))
    per = (per.withColumn("weight", weight)
           .withColumn("cap", F.col("source_size") * F.lit(float(repeat_cap)))
           .withColumn("q", F.col("cap") / F.col("weight")))
    per = (per.withColumn("capped", F.coalesce(F.sum("cap").over(fill), F.lit(0.0)))
           .withColumn("rest", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(fill), F.lit(0.0)))
           .withColumn("lam", (F.lit(float(share)) * F.sum("source_size").over(every) - F.col("capped")) / F.col("rest"))
           .withColumn("level", F.min(F.when(F.col("lam") <= F.col("q"), F.struct("q", "lam"))).over(every)["lam"]))
    target = F.least(F.col("cap"), F.coalesce(F.col("level"), F.lit(float("inf"))) * F.col("weight"))
    return per.select("skey", "source_size", target.alias("target"), F.round(target).cast("long").alias("take"))


def schedule(spark, targets: DataFrame, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """The slots: slot, skey, rank. Every source gets exactly ceil(take / block) ranks, 0 up.

    Points go through the cumulative shares of the sources (found by a join on a cell of the
    unit interval, not a range join). Ranks beyond a source's quota are not needed; the few
    ranks that the points left out, at most their discrepancy, follow at the end.
    """
    quota = targets.withColumn("slots", F.ceil(F.col("take") / F.lit(block_tokens)).cast("long")).where("slots > 0")
    total = quota.agg(F.sum("slots")).first()[0] or 0
    cells = 4096
    width = _MODULUS // cells
    upto = Window.orderBy("skey").rowsBetween(Window.unboundedPreceding, 0)
    cum = (quota.withColumn("hi", F.sum("slots").over(upto))
           .withColumn("lo", F.col("hi") - F.col("slots"))
           .select("skey", "slots",
                   F.floor(F.col("lo") / F.lit(max(total, 1)) * F.lit(_MODULUS)).alias("lo"),
                   F.floor(F.col("hi") / F.lit(max(total, 1)) * F.lit(_MODULUS)).alias("hi"))
           .where("hi > lo"))
    by_cell = cum.withColumn("cell", F.explode(F.sequence(
        F.floor(F.col("lo") / F.lit(width)), F.floor((F.col("hi") - 1) / F.lit(width)))))
    x = F.pmod((F.col("id") + 1) % F.lit(_MODULUS) * F.lit(_STEP), F.lit(_MODULUS))
    points = (spark.range(total).select(F.col("id").alias("slot"), x.alias("x"))
              .withColumn("cell", F.floor(F.col("x") / F.lit(width))))
    drawn = (points.join(by_cell, "cell").where("x >= lo and x < hi")
             .select("slot", "skey", "slots", F.floor(F.col("slot") / F.lit(SLOTS_PER_CHUNK)).alias("chunk")))
    per_chunk = drawn.groupBy("skey", "chunk").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("skey").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_chunk.select("skey", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("skey", "chunk").orderBy("slot")
    ranked = (drawn.withColumn("r", F.row_number().over(within) - 1)
              .join(offsets, ["skey", "chunk"])
              .select("slot", "skey", (F.col("r") + F.col("offset")).alias("rank"), "slots")
              .where("rank < slots"))
    have = per_chunk.groupBy("skey").agg(F.sum("n").alias("n"))
    late = (quota.join(have, "skey", "left").withColumn("n", F.coalesce("n", F.lit(0))).where("n < slots")
            .select(F.lit(total).alias("slot"), "skey",
                    F.explode(F.sequence(F.col("n"), F.col("slots") - 1)).alias("rank")))
    return ranked.select("slot", "skey", "rank").unionByName(late)


def source_order(sized: DataFrame, targets: DataFrame, seed: int = 17) -> DataFrame:
    """Add start (the words before the document in its source's shuffled order) and the
    source's columns. Prefix sums over hash ranges, then inside a range."""
    ranges = n_blocks(sized.count(), DOCS_PER_RANGE)
    h = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id")), 1)
    spread = sized.withColumn("h", h).withColumn(
        "range", F.least(F.floor(F.col("h") / F.lit(2.0 ** 63) * ranges), F.lit(ranges - 1)).cast("long"))
    per_range = spread.groupBy("skey", "range").agg(F.sum("size").alias("n"))
    before = Window.partitionBy("skey").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (per_range.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0)))
               .select("skey", "range", "offset").join(targets, "skey"))
    inside = (Window.partitionBy("skey", "range").orderBy("h", "doc_id", "size", "uid")
              .rowsBetween(Window.unboundedPreceding, -1))
    return (spread.withColumn("inner", F.coalesce(F.sum("size").over(inside), F.lit(0)))
            .join(offsets, ["skey", "range"])
            .withColumn("start", F.col("inner") + F.col("offset")).drop("inner", "offset", "range", "h"))


def mix(docs: DataFrame, weights=(5, 2, 1), share: float = 1.5, repeat_cap: float = 2.0,
        block_tokens: int = BLOCK_TOKENS, seed: int = 17) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, taken."""
    sized = sized_documents(docs)
    targets = materialise(source_targets(sized, weights, share, repeat_cap))
    placed = source_order(sized, targets, seed)
    passes = int(-(-repeat_cap // 1))
    block = F.lit(block_tokens)
    out = ["uid", "doc_id", "size", "source_size", "target"]
    lo = F.col("pass") * F.col("source_size") + F.col("start")
    pieces = (placed.where("size > 0").withColumn("pass", F.explode(F.array(*[F.lit(p).cast("long") for p in range(passes)])))
              .withColumn("lo", lo).withColumn("hi", F.least(lo + F.col("size"), F.col("take"))).where("hi > lo")
              .withColumn("rank", F.explode(F.sequence(F.floor(F.col("lo") / block), F.floor((F.col("hi") - 1) / block))))
              .withColumn("words", F.least("hi", (F.col("rank") + 1) * block) - F.greatest("lo", F.col("rank") * block)))
    used = (pieces.join(schedule(docs.sparkSession, targets, block_tokens), ["skey", "rank"])
            .groupBy(*out).agg(F.sum("words").alias("taken")))
    unused = placed.where((F.col("size") == 0) | (F.col("start") >= F.col("take"))).select(
        *out, F.lit(0).cast("long").alias("taken"))
    return used.unionByName(unused).drop("uid")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as rows of ``docs``: a document appears once for every pass that takes it.

    A document is not cut: the one at which a source's last pass ends stays whole. Documents
    that the mix leaves out, or that have no words, do not appear. Rows that repeat an id
    appear as often as the one of them that is taken most.
    """
    copies = (mix(docs, **options).where("taken > 0").groupBy("doc_id")
              .agg(F.max(F.ceil(F.col("taken") / F.col("size"))).cast("int").alias("c_n"))
              .select(F.col("doc_id").alias("c_id"), "c_n").hint("shuffle_hash"))
    names = docs.columns
    return (docs.join(copies, F.col("doc_id").eqNullSafe(F.col("c_id")))
            .select(*names, F.explode(F.array_repeat(F.lit(1), F.col("c_n"))).alias("c_pass")).drop("c_pass"))

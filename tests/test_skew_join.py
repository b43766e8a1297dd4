"""AQE splits a hot order in the derived ledger's join (thresholds scaled to the fixture)."""

from pyspark.sql import functions as F

from notewise.operators.notes import rebuild_notes
from notewise.sources.derived import derive_ledger

SKEW_CONF = {
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
}


def test_hot_order_is_split_and_exact(spark, sf_small, tmp_path):
    lines = spark.read.parquet(f"{sf_small}/lineitem.parquet")
    n = lines.count()
    hot_key = lines.select(F.min("l_orderkey")).first()[0]
    # varied rows moved onto the hot order (identical copies would compress to nothing,
    # and AQE measures skew in shuffled bytes)
    extra = lines.filter(F.col("l_orderkey") != hot_key).limit(n // 2) \
        .withColumn("l_orderkey", F.lit(hot_key).cast("bigint"))
    base = str(tmp_path)
    rest = lines.join(extra.select("l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice"),
                      ["l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice"], "left_anti")
    skewed = rest.unionByName(extra)
    skewed.repartition(8).write.parquet(f"{base}/lineitem.parquet")
    for t in ("orders", "customer"):
        spark.read.parquet(f"{sf_small}/{t}.parquet").write.parquet(f"{base}/{t}.parquet")

    saved = {k: spark.conf.get(k) for k in SKEW_CONF}
    try:
        for k, v in SKEW_CONF.items():
            spark.conf.set(k, v)
        notes = rebuild_notes(derive_ledger(spark, base))
        rows = notes.collect()
        plan = notes._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in saved.items():
            spark.conf.set(k, v)
    assert "skew=true" in plan, "\n".join(
        l[:140] for l in plan.split("\n") if "Join" in l or "AQEShuffleRead" in l or "QueryStage" in l)
    stored = spark.read.parquet(f"{base}/lineitem.parquet")
    hot_lines = stored.filter(F.col("l_orderkey") == hot_key).count()
    assert hot_lines * 4 > stored.count()  # about a third of all lines
    hot_note = [r for r in rows if r["loanID"] == hot_key][0]
    assert hot_note["cyclesTotal"] == hot_lines
    assert len(rows) == stored.select("l_orderkey").distinct().count()

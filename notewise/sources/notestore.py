"""Stored notes to which batches of payments are applied exactly once.

A store is a folder: ``notes`` (Parquet, in ``bucket`` partitions by a hash of the loan),
``payments`` (what every run applied, per batch and loan), ``log`` (one row per batch),
``done`` (one row per finished run) and ``pending`` (the notes of the last run).

``apply_payments`` takes payments that carry a batch id. Batches that the log knows are left out
by an anti join before anything is added up or shuffled, so a batch given again changes nothing, whatever else is given with it. Only
the buckets of the paid loans are read and rewritten (dynamic partition overwrite); all other
notes stay where they are.

Recovery: the new rows of the touched buckets are written to ``pending`` first. Appending to the log
commits the run; only then are the buckets overwritten, from ``pending``, and the run is marked
done. A run that ended before the log has changed nothing; one that ended after it is finished by
the next call (or ``recover``), as writing the same rows again is harmless. One writer at a time.

Payments are combined map-side per batch and loan before the shuffle. The driver sees the
touched bucket numbers (at most ``buckets``) and ids of open runs.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notewise.functions.loanmath import from_units, round_units, to_units
from notewise.operators.notes import apply_transactions, is_paid
from notewise.sources.schema import MONEY_SCALE, NOTE_KEYS

BUCKETS = 64
#: Ids of the log up to this many are broadcast; beyond, payments are joined with them by batch.
BROADCAST_IDS = 1 << 18
_LOG = "run string, batchId string, payments long, amount double, unmatchedPayments long"


def _bucket(buckets: int) -> Column:
    """Bucket of a loan; notes without a loanID, which no payment reaches, are spread by their key."""
    loan = F.xxhash64("loanID")
    return F.pmod(F.when(F.col("loanID").isNull(), F.xxhash64(*NOTE_KEYS[1:])).otherwise(loan), F.lit(buckets)).cast("int")


def create_store(notes: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Write ``notes`` (as of ``note_summary``) as a new store at ``path``."""
    spark = notes.sparkSession
    notes.withColumn("bucket", _bucket(buckets)).repartition("bucket").write.partitionBy("bucket").parquet(f"{path}/notes")
    spark.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.parquet(f"{path}/meta")
    spark.createDataFrame([], "run string").coalesce(1).write.parquet(f"{path}/done")
    spark.createDataFrame([], _LOG).coalesce(1).write.parquet(f"{path}/log")


def read_notes(spark: SparkSession, path: str) -> DataFrame:
    """The notes with all committed batches applied (after ``recover``)."""
    return spark.read.parquet(f"{path}/notes").drop("bucket")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """One row per applied batch: batchId, payments, amount, unmatchedPayments (of loans without a note)."""
    return spark.read.schema(_LOG).parquet(f"{path}/log").drop("run")


def _publish(spark: SparkSession, path: str, run: str) -> None:
    """Replace the buckets of ``pending`` and mark the run as done; repeating it is harmless."""
    (spark.read.parquet(f"{path}/pending").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("bucket").parquet(f"{path}/notes"))
    spark.createDataFrame([(run,)], "run string").coalesce(1).write.mode("append").parquet(f"{path}/done")


def recover(spark: SparkSession, path: str) -> None:
    """Finish a run that was committed but not published."""
    done = spark.read.schema("run string").parquet(f"{path}/done")
    opened = spark.read.schema(_LOG).parquet(f"{path}/log").select("run").distinct().join(done, "run", "left_anti")
    for row in opened.collect():  # one at most: every call starts with a recovery
        _publish(spark, path, row.run)


def apply_payments(spark: SparkSession, path: str, payments: DataFrame) -> int:
    """Apply the batches of ``payments`` (ledger rows with a ``batchId``) that are new; their number.

    Rows without a payment date are no payments. A payment without a batch id is an error, as
    it could not be recognised again. Payments of loans without a note are logged.
    """
    recover(spark, path)
    paid = payments.where(is_paid()).select(F.col("batchId").cast("string").alias("batchId"), "loanID", "totalPaid")
    known = spark.read.schema(_LOG).parquet(f"{path}/log").select("batchId")
    # Before the aggregate, and without dealing payments out by batch: few batches hold all of them.
    new = paid.join(F.broadcast(known) if known.count() <= BROADCAST_IDS else known, "batchId", "left_anti")
    units = to_units("totalPaid", MONEY_SCALE)
    run, buckets = uuid.uuid4().hex, spark.read.parquet(f"{path}/meta").first().buckets
    per_loan = (new.groupBy("batchId", "loanID").agg(F.sum(units).alias("units"), F.count(F.lit(1)).alias("n"))
                .withColumn("bucket", _bucket_of_loan(buckets)))
    per_loan.write.parquet(f"{path}/payments/run={run}")
    per_loan = spark.read.parquet(f"{path}/payments/run={run}")
    if not per_loan.where("batchId is null").isEmpty():
        raise ValueError("a payment without a batch id cannot be applied exactly once")
    touched = [r.bucket for r in per_loan.select("bucket").distinct().collect()]
    if not touched:
        return 0
    notes = spark.read.parquet(f"{path}/notes").where(F.col("bucket").isin([b for b in touched if b is not None]))
    transactions = per_loan.groupBy("loanID").agg(
        from_units(round_units(F.sum("units"), MONEY_SCALE - 2)).alias("totalPaid"), F.sum("n").alias("numPayments"))
    (apply_transactions(notes, transactions).withColumn("amountRepayed", F.round("amountRepayed", 2))
     .repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/pending"))
    have = notes.select(F.col("loanID").alias("n_loan"), F.lit(True).alias("known")).distinct()
    (per_loan.join(have, F.col("loanID") == F.col("n_loan"), "left").groupBy("batchId")
     .agg(F.sum("n").alias("payments"), from_units(round_units(F.coalesce(F.sum("units"), F.lit(0).cast("long")), MONEY_SCALE - 2)).alias("amount"),
          F.coalesce(F.sum(F.when(F.col("known").isNull(), F.col("n"))), F.lit(0)).cast("long").alias("unmatchedPayments"))
     .select(F.lit(run).alias("run"), "batchId", "payments", "amount", "unmatchedPayments")
     .coalesce(1).write.mode("append").parquet(f"{path}/log"))
    _publish(spark, path, run)
    return spark.read.schema(_LOG).parquet(f"{path}/log").where(F.col("run") == run).count()


def _bucket_of_loan(buckets: int) -> Column:
    return F.when(F.col("loanID").isNotNull(), F.pmod(F.xxhash64("loanID"), F.lit(buckets))).cast("int")

"""Notes kept as a catalog table that is bucketed by loan.

Buckets are written once; payments that come later are shuffled to them by loanID, while the notes
stay where they are: the join has an exchange on the side of the payments only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64


def save_notes(notes: DataFrame, table: str, buckets: int = BUCKETS, path: str | None = None) -> None:
    """Write ``notes`` as the new table ``table``, one file per bucket, sorted by loanID.

    ``path`` names a shared folder; without it the table goes to the warehouse. Choose
    ``buckets`` for about 1-2 million notes each.
    """
    writer = (notes.repartition(buckets, "loanID").write.format("parquet")
              .bucketBy(buckets, "loanID").sortBy("loanID"))
    (writer.option("path", path) if path else writer).saveAsTable(table)


def bucket_count(spark: SparkSession, table: str) -> int:
    """The number of buckets of ``table``, from the catalog."""
    rows = spark.sql(f"DESCRIBE TABLE EXTENDED {table}").where("col_name = 'Num Buckets'").collect()
    if not rows:
        raise ValueError(f"{table} is not bucketed")
    return int(rows[0]["data_type"])


def apply_to_table(spark: SparkSession, table: str, transactions: DataFrame) -> DataFrame:
    """The notes of ``table`` with ``transactions`` (one row per loanID, see ``loan_transactions``)
    added, as ``notes.apply_transactions`` does, but joined bucket by bucket.

    The join is on loanID itself, so a bucket's notes are not moved: the payments are dealt into
    as many partitions as the table has buckets, as Spark would otherwise shuffle the notes when
    the payments come in more. Notes without a loanID get no payments; they share one bucket.
    """
    notes = spark.read.table(table)
    paid = (transactions.select(F.col("loanID").alias("t_loan"), "totalPaid", "numPayments")
            .repartition(bucket_count(spark, table), "t_loan"))
    sums = {
        "cyclesRemaining": F.col("cyclesRemaining") - F.coalesce(F.col("numPayments"), F.lit(0)),
        "amountRepayed": F.col("amountRepayed") + F.coalesce(F.col("totalPaid"), F.lit(0.0)),
    }
    joined = notes.join(paid.hint("merge"), notes["loanID"] == F.col("t_loan"), "left")
    return joined.select(*[sums[c].alias(c) if c in sums else c for c in notes.columns])

"""Data-quality reports: the conditions that make the formulas meaningless are rows in
a report instead of job failures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notewise.sources.ledger import CORRUPT
from notewise.sources.schema import GRADE_BAD_DEBT_RATES, ledger_schema


def _zero_or_null(c: str) -> Column:
    return F.coalesce(F.col(c) == 0, F.lit(True))


def note_rules() -> dict[str, Column]:
    """Rule name -> predicate on a note row (note_summary / rebuild_notes output)."""
    known = [g for g, _ in GRADE_BAD_DEBT_RATES]
    return {
        "unknown_grade": F.coalesce(~F.col("grade").isin(known), F.lit(True)),
        "negative_fees": F.col("fees") < 0,
        "negative_principal": F.col("principal") < 0,
        "negative_bad_debt_funds": F.col("badDebtFunds") < 0,
        "negative_profits": F.col("profits") < 0,
        "negative_unit_payment": F.col("unitPayment") < 0,
        "zero_unit_payment": _zero_or_null("unitPayment"),
        "zero_rate": _zero_or_null("interestRate"),
        "zero_principal": _zero_or_null("principal"),
    }


def dq_note_violations(notes: DataFrame) -> DataFrame:
    """Notes breaking at least one rule, with the rule names in ``violations``."""
    flags = F.array(*[F.when(p, F.lit(name)) for name, p in note_rules().items()])
    found = F.filter(flags, lambda x: x.isNotNull())
    return notes.withColumn("violations", found).filter(F.size("violations") > 0)


def dq_duplicate_loans(notes: DataFrame) -> DataFrame:
    """loanIDs that appear under more than one note key (payments are joined by loanID
    alone, so such a loan's payments would count for every key)."""
    return (
        notes.groupBy("loanID")
        .agg(F.count(F.lit(1)).alias("noteKeys"))
        .filter(F.col("noteKeys") > 1)
    )


def dq_corrupt_rows(raw: DataFrame) -> DataFrame:
    """Rows a PERMISSIVE read could not fit to the schema (needs ``keep_corrupt``)."""
    return raw.filter(F.col(CORRUPT).isNotNull())


def ledger_rules() -> dict[str, Column]:
    """Rule name -> predicate on a ledger row: values whose absence changes a note unseen."""
    null = {f"null_{c}": F.col(c).isNull() for c in (
        "loanID", "grade", "interestRate", "totalScheduled", "interestScheduled", "fees", "dueDate")}
    return null | {"null_paid_amount": F.col("datePaid").isNotNull() & F.col("totalPaid").isNull()}


def dq_ledger_report(ledger: DataFrame) -> DataFrame:
    """One row per rule of the ledger's rows with its count, in one global aggregate; a ledger
    read with ``on_bad="keep"`` also has its corrupt rows counted. Never empty."""
    rules = ledger_rules()
    if CORRUPT in ledger.columns:
        rules["corrupt_row"] = F.col(CORRUPT).isNotNull()
    totals = ledger.agg(*[F.count(F.when(p, F.lit(1))).alias(n) for n, p in rules.items()])
    return totals.select(F.inline(F.array(*[
        F.struct(F.lit(n).alias("rule"), F.col(n).alias("violations")) for n in rules])))


def dq_report(notes: DataFrame) -> DataFrame:
    """One row per rule with its count (notes; loans for ``duplicate_loan``). Never empty.

    One chain over the notes: a per-loan aggregate (rule counts and note keys per loan,
    combined map-side) and one global aggregate, stacked into rows by a generator.
    """
    rules = note_rules()
    per_loan = notes.groupBy("loanID").agg(
        F.count(F.lit(1)).alias("_noteKeys"),
        *[F.count(F.when(p, F.lit(1))).alias(n) for n, p in rules.items()],
    )
    totals = per_loan.agg(
        *[F.sum(n).alias(n) for n in rules],
        F.count(F.when(F.col("_noteKeys") > 1, F.lit(1))).alias("duplicate_loan"),
    )
    names = list(rules) + ["duplicate_loan"]
    zero = F.lit(0).cast("bigint")
    return totals.select(F.inline(F.array(*[
        F.struct(F.lit(n).alias("rule"),
                 F.coalesce(F.col(n).cast("bigint"), zero).alias("violations"))
        for n in names
    ])))


def quarantine(ledger: DataFrame, path: str) -> dict[str, int]:
    """Write the good rows of a ledger read with ``on_bad="keep"`` to ``path/quality=good``
    and the bad ones to ``path/quality=bad``, in one job over one read, and count them on the way.

    Returns rows, bad rows and null rows per rule of ``ledger_rules`` as observed during the
    write. ``path`` must be new. A stage that runs again may count a row twice; the
    files hold every row once, so ``read_quarantined`` decides where it matters.
    """
    bad = F.col(CORRUPT).isNotNull()
    rules = {"rows": F.lit(True), "corrupt_row": bad} | ledger_rules()
    seen = Observation("quarantine")
    (ledger.observe(seen, *[F.count(F.when(p, F.lit(1))).alias(n) for n, p in rules.items()])
     .withColumn("quality", F.when(bad, "bad").otherwise("good"))
     .write.partitionBy("quality").parquet(path))
    return {n: seen.get[n] for n in rules}


def read_quarantined(spark: SparkSession, path: str, quality: str) -> DataFrame:
    """The ``good`` (ledger columns) or ``bad`` rows (with what was wrong) that ``quarantine``
    wrote; without rows when it wrote none of that kind."""
    rows = spark.read.schema(_quarantine_schema()).parquet(path).where(F.col("quality") == quality)
    return rows.drop("quality", *([CORRUPT] if quality == "good" else []))


def _quarantine_schema() -> T.StructType:
    text = T.StringType()
    return T.StructType([*ledger_schema().fields, T.StructField(CORRUPT, text), T.StructField("quality", text)])

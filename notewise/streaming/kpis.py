"""The KPI strip kept up to date from a stream of ledger rows.

A stateful aggregate holds each note's totals, as in ``payments``. Every micro-batch brings the new
totals of the notes that it touches together with the batch's own rows, so a note's totals before
the batch are the new ones minus what its rows add: no store of notes is read. Each touched note is
then valued twice, and its old version is retracted from the running totals and the new one added.
A batch costs its own rows and notes, whatever the portfolio's size.

Every KPI is a function of sums except diversification, which needs the largest principal. A batch
that retracts the largest without replacing it looks it up in ``principals``, the log of how many
notes have which principal; all others take the larger of the old one and the batch's.

Running totals are written per micro-batch (``totals/batchId=n``) from those of the batch before, so
a batch that runs again writes the same. The batch itself is written once (``work``) before it is
read twice, as a stateful plan may not run twice. All sums are exact (integers and decimals), so
retracting a value leaves no trace.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from notewise.functions.loanmath import from_units, to_units
from notewise.operators.metrics import current_growth, is_excluded, projected_growth
from notewise.operators.notes import finish_notes, is_paid, note_aggregate
from notewise.operators.waterfall import analyze_notes
from notewise.sources.dims import grade_dim
from notewise.sources.schema import NOTE_KEYS
from notewise.streaming.payments import BATCH, read_ledger_stream, stream_session

_ROW = [*NOTE_KEYS, "fees", "interestScheduled", "totalScheduled", "totalPaid", "dueDate", "datePaid"]
_SUMS = ["cyclesTotal", "fees_units", "interest_units", "total_units", "total_rows", "all_repaid", "all_payments",
         "fees_rows", "interest_rows"]
#: A sum is null as long as none of its rows has a value.
_ROWS_OF = {"fees_units": "fees_rows", "interest_units": "interest_rows", "total_units": "total_rows"}
_PRODUCT = "decimal(28,6)"


def _totals(ledger: DataFrame) -> DataFrame:
    """Note totals whose every sum tells missing from zero."""
    counted = ledger.withColumns({"has_fees": F.col("fees").isNotNull(), "has_interest": F.col("interestScheduled").isNotNull()})
    return note_aggregate(counted, more=[F.count_if("has_fees").alias("fees_rows"), F.count_if("has_interest").alias("interest_rows")])


def kpi_stream(ledger: DataFrame) -> DataFrame:
    """Of each micro-batch: the new totals of the touched notes (``state``), and its own rows."""
    rows = ledger.select(*_ROW).withColumn("state", F.lit(False))
    return _totals(ledger).withColumn("state", F.lit(True)).unionByName(rows, allowMissingColumns=True)


def _versions(batch: DataFrame) -> DataFrame:
    """Touched notes, analyzed: the new version with sign 1 and the old one, if any, with sign -1."""
    state = F.col("state")
    paid = ~state & is_paid()
    units = {"fees_units": "fees", "interest_units": "interestScheduled", "total_units": "totalScheduled"}
    own = {c: F.sum(F.when(~state, to_units(x, 4))) for c, x in units.items()}
    own |= {_ROWS_OF[c]: F.count(F.when(~state, F.col(x))) for c, x in units.items()}
    own |= {"cyclesTotal": F.count(F.when(~state, 1)), "all_payments": F.count(F.when(paid, 1)),
            "all_repaid": F.sum(F.when(paid, to_units("totalPaid", 4)))}
    # One aggregate brings a note's state row and its own rows together (null keys included).
    both = batch.groupBy(*NOTE_KEYS).agg(
        F.min(F.when(state, F.col("firstDueDate"))).alias("firstDueDate"),
        *[F.max(F.when(state, F.col(c))).alias(c) for c in _SUMS], *[F.coalesce(own[c], F.lit(0)).alias(f"own_{c}") for c in _SUMS])
    before = {c: F.coalesce(F.col(c), F.lit(0)) - F.col(f"own_{c}") for c in _SUMS}
    before |= {c: F.when(before[rows] > 0, before[c]) for c, rows in _ROWS_OF.items()}
    version = lambda sign, of: F.struct(F.lit(sign).alias("sign"), *[of[c].cast("long").alias(c) for c in _SUMS])
    now = {c: F.col(c) for c in _SUMS}
    each = (both.select(*NOTE_KEYS, "firstDueDate", F.explode(F.array(version(1, now), version(-1, before))).alias("v"))
            .select(*NOTE_KEYS, "firstDueDate", "v.*").where("cyclesTotal > 0"))
    return analyze_notes(finish_notes(each, F.broadcast(grade_dim(batch.sparkSession)), keep=["sign"]))


def _changes(versions: DataFrame, by: Sequence[str]) -> DataFrame:
    """Signed sums per group: what the batch adds to the running totals."""
    sign, out = F.col("sign"), {}
    add = lambda x: F.coalesce(F.sum(sign * x), F.lit(0))
    out["notes"] = add(F.lit(1).cast("long"))
    out["notesExcluded"] = add(F.when(is_excluded(), 1).otherwise(0).cast("long"))
    out["excluded_units"] = add(F.when(is_excluded(), to_units("principal")))
    out["earnings_units"] = add(to_units("badDebtFundsReceived") + to_units("profitsReceived"))
    out["principal_units"] = add(to_units("principal"))
    out["outstanding_units"] = add(to_units("principalOutstanding"))
    for name, growth in (("current", current_growth()), ("net", projected_growth())):
        out[f"{name}_grown"] = add((growth * F.col("principal")).try_cast(_PRODUCT))
        out[f"{name}_units"] = add(F.when(growth.isNotNull(), to_units("principal")))
    cast = lambda name: "decimal(38,6)" if name.endswith("grown") else "long"
    return versions.groupBy(*by).agg(*[c.cast(cast(n)).alias(n) for n, c in out.items()])


def _same(left: str, right: str, by: Sequence[str]) -> Column:
    cond = F.lit(True)
    for c in by:
        cond = cond & F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}"))
    return cond


def _largest(spark: SparkSession, out: str, batch_id: int, before: DataFrame, by: Sequence[str]) -> DataFrame:
    """Largest principal per group after the batch, whose changes are in the log already."""
    log = spark.read.parquet(f"{out}/principals").where(F.col(BATCH) <= batch_id)
    own = log.where(F.col(BATCH) == batch_id)
    added = own.where("n > 0").groupBy(*by).agg(F.max("principal").alias("added"))
    joined = before.select(*by, F.col("largest").alias("old")).alias("b").join(
        own.alias("o"), _same("b", "o", by) & (F.col("o.principal") == F.col("b.old")) & (F.col("o.n") < 0), "left")
    state = joined.select(*[F.col(f"b.{c}").alias(c) for c in by], "old", F.col("o.n").isNotNull().alias("gone"))
    merged = state.unionByName(added, allowMissingColumns=True).groupBy(*by).agg(
        F.max("old").alias("old"), F.max("added").alias("added"), F.coalesce(F.bool_or("gone"), F.lit(False)).alias("gone"))
    lost = F.col("gone") & ~F.coalesce(F.col("added") >= F.col("old"), F.lit(False))
    merged = merged.withColumn("lost", lost)
    found = merged.where("not lost").select(*by, F.greatest("old", "added").alias("largest"))
    if merged.where("lost").isEmpty():
        return found
    looked_up = (log.alias("l").join(merged.where("lost").alias("m"), _same("l", "m", by), "left_semi")
                 .groupBy(*by, "principal").agg(F.sum("n").alias("n")).where("n > 0")
                 .groupBy(*by).agg(F.max("principal").alias("largest")))
    return found.unionByName(looked_up)


def _writer(out: str, by: Sequence[str]):
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        work = f"{out}/work/{BATCH}={batch_id}"
        batch.write.mode("overwrite").parquet(f"{work}/rows")
        _versions(spark.read.parquet(f"{work}/rows")).write.mode("overwrite").parquet(f"{work}/versions")
        versions = spark.read.parquet(f"{work}/versions")
        (versions.where("principal is not null").groupBy(*by, "principal").agg(F.sum("sign").cast("long").alias("n")).where("n <> 0")
         .write.mode("overwrite").parquet(f"{out}/principals/{BATCH}={batch_id}"))
        earlier = spark.read.parquet(f"{out}/totals").where(F.col(BATCH) < batch_id)
        last = earlier.agg(F.max(BATCH)).first()[0]
        before = earlier.where(F.col(BATCH) == F.lit(last)).drop(BATCH)
        largest = _largest(spark, out, batch_id, before, by)
        changes = _changes(versions, by)
        sums = [c for c in changes.columns if c not in by]
        totals = before.select(*by, *sums).unionByName(changes).groupBy(*by).agg(
            *[F.sum(c).cast(changes.schema[c].dataType).alias(c) for c in sums])
        (totals.alias("t").join(largest.alias("x"), _same("t", "x", by), "left")
         .select(*[F.col(f"t.{c}").alias(c) for c in by], *sums, "largest")
         .write.mode("overwrite").parquet(f"{out}/totals/{BATCH}={batch_id}"))
    return write


def start_kpi_stream(spark: SparkSession, source: str, out: str, checkpoint: str, by: Sequence[str] = ("grade",), fmt: str = "parquet",
                     max_files_per_trigger: int | None = None, state_partitions: int | None = None) -> StreamingQuery:
    """Keep the KPI totals under ``out`` up to date with the ledger files of ``source`` until all are
    read. ``by`` are note columns (an empty list: one group)."""
    own, by = stream_session(spark, state_partitions), list(by)
    # Batch -1: an empty portfolio.
    empty = own.createDataFrame([], _totals_schema(own, by))
    empty.coalesce(1).write.mode("ignore").parquet(f"{out}/totals/{BATCH}=-1")
    stream = read_ledger_stream(own, source, fmt, max_files_per_trigger)
    return (kpi_stream(stream).writeStream.outputMode("update").foreachBatch(_writer(out, by))
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def _totals_schema(spark: SparkSession, by: Sequence[str]):
    from notewise.sources.schema import ledger_schema

    rows = spark.createDataFrame([], ledger_schema())
    none = spark.createDataFrame([], kpi_stream(rows).schema)
    return _changes(_versions(none), by).withColumn("largest", F.lit(None).cast("double")).schema


def kpis_at(spark: SparkSession, out: str, total_funds: float | None = None, batch_id: int | None = None) -> DataFrame:
    """The KPIs after a micro-batch (the last one if none is given), as ``metrics.portfolio_kpis``."""
    totals = spark.read.parquet(f"{out}/totals")
    if batch_id is None:
        batch_id = totals.agg(F.max(BATCH)).first()[0]
    now = totals.where((F.col(BATCH) == batch_id) & (F.col("notes") > 0))
    made = ("notes", "notesExcluded", "excluded_units", "earnings_units", "principal_units", "outstanding_units", "current_grown",
            "current_units", "net_grown", "net_units", "largest", BATCH)
    roi = lambda name: F.round((F.try_divide(F.col(f"{name}_grown").cast("double"), from_units(f"{name}_units")) - 1.0) * 100, 4)
    out_columns = {
        "notes": F.col("notes"), "notesExcluded": F.col("notesExcluded"), "principalExcluded": from_units("excluded_units"),
        "totalEarnings": from_units("earnings_units"), "currentRoi": roi("current"), "netRoi": roi("net"),
        "diversification": F.round(F.try_divide(F.col("largest"), from_units("principal_units")) * 100, 4),
    }
    if total_funds is not None:
        funds = F.lit(float(total_funds))
        out_columns["fundsRemaining"] = F.round(funds - from_units("outstanding_units"), 2)
        out_columns["fundsUninvested"] = F.round(funds - from_units("principal_units"), 2)
    return now.select(*[c for c in now.columns if c not in made], *[c.alias(n) for n, c in out_columns.items()])

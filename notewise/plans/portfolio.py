"""End-to-end plans over the test tables, and the registry of named queries.

``analyzed_notes(ledger)`` is the flagship composition: ledger -> notes with payments
(one aggregate) -> waterfall + progress (projections). Every registered query takes
``(spark, sf_dir)``, derives the ledger from that folder's tables and returns a lazy
DataFrame.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notewise.operators import datasets, metrics, quality, selection
from notewise.operators.notes import (
    loan_transactions, note_summary, notes_with_transactions, paid_instalments, rebuild_notes,
)
from notewise.operators.timeframe import earnings_by_period, earnings_timeframe
from notewise.operators.waterfall import analyze_notes, note_progress, waterfall
from notewise.session import checkpoint_dir
from notewise.sources.derived import derive_ledger, edge_ledger, null_ledger
from notewise.sources.dims import grade_dim
from notewise.sources.ledger import normalise_titles, read_ledger, to_titles
from notewise.sources.ledgerfolder import read_ledger_folder
from notewise.sources.notestore import apply_payments, create_store, read_log, read_notes
from notewise.sources.notetable import apply_to_table, save_notes
from notewise.streaming.kpis import kpis_at, start_kpi_stream
from notewise.streaming.payments import compact_notes, start_note_stream, stream_session

# Parameters of the registered queries.
TOTAL_FUNDS = 5_000_000_000.0
TOP_K = 20
PREVIEW_ROWS = 5
PROGRESS_GRADE = "C"
TIMEFRAME_AS_OF = "2000-06-30"
TIMEFRAME = "year"
STREAM_BATCHES = 3
STREAM_FILES = 64
STREAM_FILE_ROWS = 2_000_000
STREAM_RANGE_ROWS = 1_000_000
STATE_ROWS = 2_000_000
STORE_GAP = 19
STORE_BUCKETS = 16
STORE_YEARS = (1997, 1999, 1999)
TABLE_BUCKETS = 16


def analyzed_notes(ledger: DataFrame, cap_spillover: bool = False) -> DataFrame:
    """Notes with payments, waterfall, months to break-even and completion."""
    return analyze_notes(rebuild_notes(ledger), cap_spillover=cap_spillover)


def _ledger(spark, sf_dir):
    return derive_ledger(spark, sf_dir)


def _analyzed(spark, sf_dir):
    return analyzed_notes(_ledger(spark, sf_dir))


def _notes(spark, sf_dir):
    return note_summary(_ledger(spark, sf_dir))


def _rebuilt(spark, sf_dir):
    return rebuild_notes(_ledger(spark, sf_dir))


def _faulty(spark, sf_dir):
    return derive_ledger(spark, sf_dir, faulty=True)


def q_grade_dim(spark, sf_dir):
    """The grade table conformed against the ledger: instalments per grade (0 if none)."""
    g = grade_dim(spark)
    rows = _ledger(spark, sf_dir).select("grade", F.lit(1).alias("hit"))
    zeros = g.select("grade", F.lit(0).alias("hit"))
    return (
        rows.unionByName(zeros)
        .join(F.broadcast(g), "grade")
        .groupBy("gradeOrder", "grade", "badDebtRate")
        .agg(F.sum("hit").cast("bigint").alias("instalments"))
    )


def q_note_principal(spark, sf_dir):
    return _notes(spark, sf_dir).select(
        "loanID", "unitPayment", "interestRate", "cyclesTotal", "principal")


def q_note_bad_debt(spark, sf_dir):
    return _notes(spark, sf_dir).select(
        "loanID", "grade", "principal", "cyclesTotal", "badDebtFunds", "profits")


def q_note_progress(spark, sf_dir):
    return _analyzed(spark, sf_dir).select(
        "loanID", "cyclesRemaining", "nextPrincipalPayment", "principalOutstanding",
        "unitPayment", "monthsToBreakeven", "completed")


def _run_folder(spark, name):
    return f"{checkpoint_dir(spark).rstrip('/')}/notewise-{name}-{uuid.uuid4().hex}"


def _stage_ledger(ledger, sf_dir, path):
    """Write the ledger in ranges of due date and loan. Returned: the files that a micro-batch should
    take (a third of the ranges, and never more than STREAM_FILES files of STREAM_FILE_ROWS rows)
    and the state partitions.

    Both numbers follow the lines and the cores, not the session's shuffle partitions: every state
    partition is a store that keeps its files open in an executor, and a task that deals rows out
    to 200 partitions has 200 more of them open.
    """
    spark = ledger.sparkSession
    parts = lambda rows, each: max(spark.sparkContext.defaultParallelism, -(-rows // each))
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    ranges = parts(rows, STREAM_RANGE_ROWS)
    staged = ledger.repartitionByRange(ranges, "dueDate", "loanID")
    staged.write.option("maxRecordsPerFile", STREAM_FILE_ROWS).parquet(path)
    return min(-(-ranges // STREAM_BATCHES), STREAM_FILES), parts(rows, STATE_ROWS)


def q_portfolio_kpis_stream(spark, sf_dir):
    """The KPIs by grade after the ledger has gone by as a stream, from running totals."""
    run = _run_folder(spark, "kpi-run")
    files, state = _stage_ledger(_faulty(spark, sf_dir), sf_dir, f"{run}/ledger")
    start_kpi_stream(spark, f"{run}/ledger", f"{run}/kpis", f"{run}/checkpoint", by=["grade"],
                     max_files_per_trigger=files, state_partitions=state).awaitTermination()
    return kpis_at(spark, f"{run}/kpis", TOTAL_FUNDS)


def _filled_store(spark, sf_dir):
    """A store of the notes (but those of every 19th loan) to which payments were applied by
    year of payment: three years, then those and two more again, then all five once more."""
    path = _run_folder(spark, "note-store")
    ledger = _ledger(spark, sf_dir)
    create_store(note_summary(ledger.where(F.col("loanID") % STORE_GAP != 0)), path, buckets=STORE_BUCKETS)
    # Written once: every call would derive the ledger anew.
    staged = f"{path}-payments"
    paid_instalments(ledger).select("loanID", "totalPaid", "datePaid", F.year("datePaid").cast("string").alias("batchId")).write.parquet(staged)
    payments = spark.read.parquet(staged)
    for last in STORE_YEARS:
        apply_payments(spark, path, payments.where(F.col("batchId") <= str(last)))
    return path


def q_stored_notes(spark, sf_dir):
    return read_notes(spark, _filled_store(spark, sf_dir))


def q_stored_notes_log(spark, sf_dir):
    return read_log(spark, _filled_store(spark, sf_dir))


def q_analyzed_notes_stream(spark, sf_dir):
    """The analyzed notes computed incrementally: the derived ledger is staged under the
    shared checkpoint folder in ranges of due date and loan, as many files as the data
    needs (a popular date spreads over several), and replayed as a stream of micro-batches
    of a bounded number of files; the result is each note's newest version, compacted.

    A registered query leaves its run folder to the caller, who owns the shared folder.
    """
    run = _run_folder(spark, "stream-run")
    files, state = _stage_ledger(_ledger(spark, sf_dir), sf_dir, f"{run}/ledger")
    query = start_note_stream(spark, f"{run}/ledger", f"{run}/notes", checkpoint=f"{run}/checkpoint",
                              max_files_per_trigger=files, state_partitions=state)
    query.awaitTermination()
    # As many partitions as the stream: executors still have its stores open.
    compact_notes(stream_session(spark, state), f"{run}/notes", f"{run}/compacted")
    return spark.read.parquet(f"{run}/compacted")


def q_ledger_titled(spark, sf_dir):
    """The ledger under the titles of its file."""
    return to_titles(_ledger(spark, sf_dir))


def _titled_text(ledger):
    """The ledger as text under literal titles, in another order than the usual one, with
    company names that hold quotes and commas."""
    money = {"Interest Scheduled": "interestScheduled", "Principal Scheduled": "principalScheduled",
             "Total Scheduled": "totalScheduled", "Interest Owed": "interestOwed", "Principal Owed": "principalOwed",
             "Total Owed": "totalOwed", "Interest Paid": "interestPaid", "Principal Paid": "principalPaid",
             "Total Paid": "totalPaid", "Fees Paid to Loop": "fees"}
    rest = {"Status": "status", "Date Paid": "datePaid", "Due Date": "dueDate", "Risk Band": "grade",
            "Interest Rate": "interestRate", "Loan Name": "loanName", "Loan Id": "loanID", "Payment Type": "paymentType"}
    company = F.concat(F.lit('The "Best", '), F.col("company"))
    return ledger.select(*[F.col(c).cast("string").alias(t) for t, c in rest.items()], company.alias("Company"),
                         *[F.col(c).cast("string").alias(t) for t, c in reversed(money.items())])


def _write_text(titled, path):
    titled.write.options(header=True, quote='"', escape='"').csv(path)


def q_ledger_csv(spark, sf_dir, infer_schema=False):
    """The ledger through its file: a CSV with doubled quotes, commas inside fields and
    reordered columns, written under the shared checkpoint folder and read by title."""
    path = _run_folder(spark, "ledger-csv")
    _write_text(_titled_text(_ledger(spark, sf_dir)), path)
    return read_ledger(spark, path, fmt="csv", infer_schema=infer_schema)


def q_ledger_folder(spark, sf_dir):
    """The ledger through three files of different layouts, by loan: the titles in their usual
    order with one that nobody knows, in another order, and without a status."""
    path = _run_folder(spark, "ledger-folder")
    text = _titled_text(_ledger(spark, sf_dir)).withColumn("_part", F.col("`Loan Id`").cast("bigint") % 3)
    part = lambda k: text.where(F.col("_part") == k).drop("_part")
    _write_text(part(0).withColumn("Remark", F.lit("old, export")), f"{path}/0")
    _write_text(part(1).select(*[f"`{c}`" for c in reversed(part(1).columns)]), f"{path}/1")
    _write_text(part(2).drop("Status"), f"{path}/2")
    return read_ledger_folder(spark, path, optional=["status"])


def _corrupt_ledger(spark, sf_dir):
    """The ledger file with bad fields, read with a trace: every 29th loan has a due date and
    every 23rd a paid amount that does not fit."""
    path = _run_folder(spark, "ledger-corrupt")
    titled = _titled_text(_ledger(spark, sf_dir))
    loan = F.col("`Loan Id`").cast("bigint")
    _write_text(titled.withColumns({
        "Due Date": F.when(loan % 29 == 0, F.lit("soon")).otherwise(F.col("`Due Date`")),
        "Total Paid": F.when(loan % 23 == 0, F.lit("ten")).otherwise(F.col("`Total Paid`")),
    }), path)
    return read_ledger(spark, path, fmt="csv", on_bad="keep")


def q_dq_corrupt(spark, sf_dir):
    return quality.dq_ledger_report(_corrupt_ledger(spark, sf_dir))


def q_ledger_quarantine(spark, sf_dir):
    """Rows and scheduled amounts of the good and of the bad rows that the ledger file was parted
    into, read back from the two places."""
    path = _run_folder(spark, "ledger-quarantine")
    quality.quarantine(_corrupt_ledger(spark, sf_dir), path)
    read = {q: quality.read_quarantined(spark, path, q).select(F.lit(q).alias("quality"), "loanID", "totalScheduled")
            for q in ("good", "bad")}
    return read["good"].unionByName(read["bad"]).groupBy("quality").agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("loanID").alias("loans"),
        F.sum("totalScheduled").cast("double").alias("scheduled"))


def q_bucketed_notes(spark, sf_dir):
    """Notes kept as a table bucketed by loan, with all payments joined to the buckets."""
    ledger, run = _ledger(spark, sf_dir), _run_folder(spark, "note-table")
    table = f"notes_{run[-32:]}"
    save_notes(note_summary(ledger), table, TABLE_BUCKETS, path=run)
    return apply_to_table(spark, table, loan_transactions(ledger))


def q_notes_positions(spark, sf_dir):
    """Every note's place on the chart: its position in the app's order."""
    return selection.with_positions(_analyzed(spark, sf_dir).select(
        "loanID", "company", "loanName", "interestRate", "grade", "principal"))


def q_dq_ledger_report(spark, sf_dir):
    return quality.dq_ledger_report(null_ledger(_ledger(spark, sf_dir)))


def q_dq_report(spark, sf_dir):
    return quality.dq_report(note_summary(_faulty(spark, sf_dir)))


def _kpis(ledger, by=None):
    return metrics.portfolio_kpis(analyzed_notes(ledger), TOTAL_FUNDS, by=by)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "ledger": _ledger,
    "ledger_renamed": lambda s, d: normalise_titles(to_titles(_ledger(s, d))),
    "grade_dim": q_grade_dim,
    "paid_instalments": lambda s, d: paid_instalments(_ledger(s, d)),
    "note_summary": _notes,
    "note_principal": q_note_principal,
    "note_bad_debt": q_note_bad_debt,
    "loan_transactions": lambda s, d: loan_transactions(_ledger(s, d)),
    "notes_with_transactions": lambda s, d: notes_with_transactions(_ledger(s, d)),
    "rebuild_notes": _rebuilt,
    "waterfall": lambda s, d: waterfall(_rebuilt(s, d)),
    "note_progress": q_note_progress,
    "open_notes": lambda s, d: selection.open_notes(_analyzed(s, d)),
    "notes_ordered": lambda s, d: selection.order_notes(_analyzed(s, d), "app"),
    "notes_top_k": lambda s, d: selection.top_notes(_analyzed(s, d), TOP_K, "notebook"),
    "notes_preview": lambda s, d: selection.preview(_analyzed(s, d), PREVIEW_ROWS),
    "note_annualized_return": lambda s, d: metrics.note_annualized_return(_analyzed(s, d)),
    "weighted_avg_rate": lambda s, d: metrics.weighted_avg(
        _notes(s, d), "interestRate", "principal", name="weightedAvgRate"
    ).select(F.round("weightedAvgRate", 6).alias("weightedAvgRate")),
    "kpi_total_earnings": lambda s, d: metrics.kpi_total_earnings(_analyzed(s, d)),
    "kpi_current_roi": lambda s, d: metrics.kpi_current_roi(_analyzed(s, d)),
    "kpi_net_roi": lambda s, d: metrics.kpi_net_roi(_analyzed(s, d)),
    "kpi_diversification": lambda s, d: metrics.kpi_diversification(_analyzed(s, d)),
    "kpi_funds_remaining": lambda s, d: metrics.kpi_funds_remaining(_analyzed(s, d), TOTAL_FUNDS),
    "kpi_funds_uninvested": lambda s, d: metrics.kpi_funds_uninvested(_analyzed(s, d), TOTAL_FUNDS),
    "portfolio_kpis": lambda s, d: _kpis(_ledger(s, d), by=["grade"]),
    "funds_allocation": lambda s, d: datasets.funds_allocation(_analyzed(s, d), TOTAL_FUNDS),
    "grade_distribution": lambda s, d: datasets.grade_distribution(_notes(s, d)),
    "progress_series": lambda s, d: datasets.progress_series(_analyzed(s, d)),
    "progress_by_grade": lambda s, d: datasets.progress_series(_analyzed(s, d), PROGRESS_GRADE),
    "progress_annotations": lambda s, d: datasets.progress_annotations(_analyzed(s, d)),
    "earnings_timeframe": lambda s, d: earnings_timeframe(_ledger(s, d), TIMEFRAME_AS_OF, TIMEFRAME),
    "earnings_timeframe_month": lambda s, d: earnings_timeframe(_ledger(s, d), TIMEFRAME_AS_OF, "month"),
    "earnings_timeframe_all": lambda s, d: earnings_timeframe(_ledger(s, d), TIMEFRAME_AS_OF, "all"),
    "earnings_by_month": lambda s, d: earnings_by_period(_ledger(s, d), "month"),
    "earnings_by_quarter_and_grade": lambda s, d: earnings_by_period(_faulty(s, d), "quarter", by=["grade"]),
    "dq_report": q_dq_report,
    "analyzed_notes_stream": q_analyzed_notes_stream,
    "portfolio_kpis_stream": q_portfolio_kpis_stream,
    "stored_notes": q_stored_notes,
    "stored_notes_log": q_stored_notes_log,
    "ledger_csv": q_ledger_csv,
    "ledger_csv_inferred": lambda s, d: q_ledger_csv(s, d, infer_schema=True),
    "ledger_folder": q_ledger_folder,
    "ledger_quarantine": q_ledger_quarantine,
    "bucketed_notes": q_bucketed_notes,
    "notes_positions": q_notes_positions,
    "ledger_titled": q_ledger_titled,
    "dq_corrupt": q_dq_corrupt,
    "dq_ledger_report": q_dq_ledger_report,
    "note_summary_edge": lambda s, d: note_summary(edge_ledger(_ledger(s, d))),
    "rebuild_notes_nulls": lambda s, d: rebuild_notes(null_ledger(_ledger(s, d))),
    "notes_with_transactions_nulls": lambda s, d: notes_with_transactions(null_ledger(_ledger(s, d))),
    "portfolio_kpis_total": lambda s, d: _kpis(_ledger(s, d)),
    "portfolio_kpis_rollup": lambda s, d: metrics.portfolio_kpis_rollup(
        analyzed_notes(_faulty(s, d)), ["grade", "completed"], TOTAL_FUNDS),
    "portfolio_kpis_faulty": lambda s, d: _kpis(_faulty(s, d)),
    "portfolio_kpis_text": lambda s, d: metrics.kpi_text(_kpis(_ledger(s, d), by=["grade"])),
    "grade_distribution_faulty": lambda s, d: datasets.grade_distribution(
        note_summary(_faulty(s, d)), remainder=True),
}

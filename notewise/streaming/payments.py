"""Incremental analyzed notes from a stream of ledger rows.

A stateful streaming aggregate keeps, per note key, the same absolute totals as
``rebuild_notes`` (instalments, fees, interest, mean instalment, first due date, paid
amount and count). Because the state holds absolute totals rather than deltas, a replayed
micro-batch cannot count a payment twice (the additive ``apply_transactions`` could).

Each micro-batch emits only the notes it touched (update mode); ``foreachBatch`` completes
them (principal, reserve, waterfall, progress) as ordinary DataFrame work and writes them to
``<out>/batchId=<id>`` with overwrite, so a retried batch rewrites the same folder.
``latest_notes`` reads the folder and keeps each note's newest version with one ``max_by``
per column (hash aggregates combined map-side; no sort). ``compact_notes`` writes those
newest versions to a folder of their own; the caller removes old folders.

State is one aggregation buffer per note, in a RocksDB state store, and lives in the
checkpoint under the shared ``spark.checkpoint.dir`` unless a location is given. The job
runs in a session of its own, so its settings touch nobody else's.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from notewise.operators.notes import finish_notes, note_aggregate
from notewise.operators.waterfall import analyze_notes
from notewise.session import RECOMMENDED, checkpoint_dir
from notewise.sources.dims import grade_dim
from notewise.sources.ledger import DATE_FORMAT, csv_options, parse_ledger, text_schema
from notewise.sources.schema import LEDGER_TITLES, NOTE_KEYS, ledger_schema

BATCH = "batchId"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def note_state_stream(ledger_stream: DataFrame) -> DataFrame:
    """Streaming per-note totals (use with output mode ``update``)."""
    return note_aggregate(ledger_stream)


def _writer(out_path: str, cap_spillover: bool):
    def write(batch: DataFrame, batch_id: int) -> None:
        notes = finish_notes(batch, F.broadcast(grade_dim(batch.sparkSession)))
        analyzed = analyze_notes(notes, cap_spillover=cap_spillover)
        analyzed.write.mode("overwrite").parquet(f"{out_path}/{BATCH}={batch_id}")
    return write


def read_ledger_stream(spark: SparkSession, source: str, fmt: str = "parquet",
                       max_files_per_trigger: int | None = None,
                       date_format: str | Sequence[str] = DATE_FORMAT, on_bad: str = "fail",
                       titles: Sequence[str] | None = None) -> DataFrame:
    """A streaming ledger from files (CSV with titles, or parquet/json/orc with names).

    CSV is parsed as in ``read_ledger``; ``titles`` is the header's order when it is not
    the usual one (a file with another header fails the job).
    """
    if fmt == "csv":
        columns = titles or [title for title, _ in LEDGER_TITLES]
        reader = spark.readStream.format("csv").options(**csv_options()).schema(text_schema(columns))
    else:
        reader = spark.readStream.format(fmt).schema(ledger_schema())
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = reader.load(source)
    formats = (date_format,) if isinstance(date_format, str) else tuple(date_format)
    return parse_ledger(stream, formats, on_bad) if fmt == "csv" else stream


def stream_session(spark: SparkSession, state_partitions: int | None = None) -> SparkSession:
    """A session for one streaming job: the caller's settings, RECOMMENDED where the caller has
    none, and a RocksDB state store."""
    own = spark.newSession()
    for key, value in RECOMMENDED.items():
        own.conf.set(key, spark.conf.get(key, value))
    # Without a second argument: Spark's own default when nobody has set it.
    partitions = spark.conf.get("spark.sql.shuffle.partitions") if state_partitions is None else str(state_partitions)
    own.conf.set("spark.sql.shuffle.partitions", partitions)
    own.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return own


def start_note_stream(
    spark: SparkSession,
    source: str,
    out_path: str,
    fmt: str = "parquet",
    checkpoint: str | None = None,
    max_files_per_trigger: int | None = None,
    available_now: bool = True,
    processing_time: str | None = None,
    cap_spillover: bool = False,
    state_partitions: int | None = None,
    date_format: str | Sequence[str] = DATE_FORMAT,
    on_bad: str = "fail",
) -> StreamingQuery:
    """Start the incremental job; ``available_now`` processes what is there and stops.

    ``state_partitions`` fixes the number of state-store partitions (it cannot change
    after the first run of a checkpoint); size it to the number of notes. Default: the
    session's ``spark.sql.shuffle.partitions``. ``date_format`` and ``on_bad`` (``fail`` or
    ``null``) are those of ``read_ledger`` for CSV sources. The default checkpoint belongs to
    the source, its format and the output together.
    """
    if checkpoint is None:
        tag = hashlib.sha256("\n".join((source, fmt, out_path)).encode()).hexdigest()[:16]
        checkpoint = f"{checkpoint_dir(spark).rstrip('/')}/notewise-notes-stream-{tag}"
    own = stream_session(spark, state_partitions)
    stream = read_ledger_stream(own, source, fmt, max_files_per_trigger, date_format, on_bad)
    writer = (note_state_stream(stream).writeStream.outputMode("update")
              .foreachBatch(_writer(out_path, cap_spillover))
              .option("checkpointLocation", checkpoint))
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif processing_time:
        writer = writer.trigger(processingTime=processing_time)
    return writer.start()


def latest_notes(spark: SparkSession, out_path: str) -> DataFrame:
    """The newest version of every note written by ``start_note_stream``."""
    df = spark.read.parquet(out_path)
    cols = [c for c in df.columns if c != BATCH]
    newest = df.groupBy(*NOTE_KEYS).agg(*[F.max_by(c, BATCH).alias(c) for c in cols if c not in NOTE_KEYS])
    return newest.select(*cols)


def compact_notes(spark: SparkSession, out_path: str, target: str) -> int:
    """Write every note's newest version to ``target`` and return the newest batch it holds.

    Batches up to that one are then superseded by ``target``; removing them is the caller's.
    """
    upto = spark.read.parquet(out_path).agg(F.max(BATCH)).first()[0]
    latest_notes(spark, out_path).write.parquet(target)
    return upto

"""Secret scans with an incremental ledger of content-addressed blobs.

Every version of every path is addressed by the SHA-256 of its whole text. The ledger records
which (blob, rule, rule version) pairs have been scanned and what was found. A run scans only
pairs the ledger lacks, appends them, and joins the findings back to all paths; a rule whose
version changes is scanned again, other rules are not. The ledger is a Parquet folder; a run
writes its own new part folder once, so a retried or lost task leaves no half-written rows.

Scale: blobs are found on (hash, id) rows; a text is moved once, and only when its blob has
an unseen pair. Paths join findings on the hash with a splittable shuffle join, so thousands
of copies of one blob do not meet in one task.

Null text is the empty blob. Paths that repeat (same id, any text) give one row each. A null
id is an ordinary id. Empty tables give empty results; extra columns are ignored. Spans are
whole matches in code points, end exclusive.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern``, leftmost and non-overlapping, whose ``group`` is long enough.

    A match that is too short is dropped but still consumes its text.
    """

    kind: str
    version: int
    pattern: str
    group: int = 0
    shortest: int = 1
    any_case: bool = False

    def spans(self, text: str) -> list[tuple[int, int]]:
        found = re.finditer(self.pattern, text, re.ASCII | (re.IGNORECASE if self.any_case else 0))
        return [m.span() for m in found if len(m[self.group]) >= self.shortest]


BASE_RULES = (
    Rule("assign", 1, r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
         group=2, shortest=8, any_case=True),
    Rule("access", 1, r"AKIA[A-Z0-9]+", shortest=16),
    # A run of 32 or more is what is left of all runs once the short ones are dropped.
    Rule("hex", 1, r"[0-9a-f]{32,}"),
)
RULES = (*BASE_RULES, Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----"))

LEDGER_SCHEMA = "blob string, kind string, version int, spans array<struct<start:int,end:int>>"
_SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32())])


def address(text: Column) -> Column:
    """The content address of a version."""
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def unseen(docs: DataFrame, ledger: DataFrame, rules=RULES) -> DataFrame:
    """blob, one id that holds it, and the kinds to scan there."""
    blobs = (docs.select("doc_id", address(F.col("text")).alias("blob"))
             .groupBy("blob").agg(F.min("doc_id").alias("holder")))
    wanted = F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules])
    pairs = blobs.select("blob", "holder", F.explode(wanted).alias("rule")).select("blob", "holder", "rule.*")
    seen = ledger.select("blob", "kind", "version")
    return (pairs.join(seen, ["blob", "kind", "version"], "left_anti")
            .groupBy("blob", "holder").agg(F.collect_set("kind").alias("kinds")))


def scan(docs: DataFrame, ledger: DataFrame, rules=RULES) -> DataFrame:
    """Ledger rows of the unseen pairs."""
    by_kind = {r.kind: r for r in rules}

    def run(batches):
        for batch in batches:
            out = []
            kinds = batch.column("kinds").to_pylist()
            for blob, text, todo in zip(batch.column("blob"), batch.column("text"), kinds, strict=True):
                whole = text.as_py() or ""
                for kind in todo:
                    spans = [{"start": a, "end": b} for a, b in by_kind[kind].spans(whole)]
                    out.append((blob.as_py(), kind, by_kind[kind].version, spans))
            columns = list(zip(*out, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()),
                 pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.list_(_SPAN))],
                names=["blob", "kind", "version", "spans"])

    todo = unseen(docs, ledger, rules).select(F.col("blob").alias("t_blob"), "holder", "kinds").hint("shuffle_hash")
    texts = docs.select("doc_id", "text").join(todo, F.col("doc_id").eqNullSafe(F.col("holder")))
    return (texts.withColumn("blob", address(F.col("text"))).where("blob = t_blob")
            .select("blob", "text", "kinds").mapInArrow(run, LEDGER_SCHEMA))


def update(docs: DataFrame, ledger_path: str, rules=RULES) -> DataFrame:
    """Scan what the ledger lacks, append it, and return the ledger (current rules only)."""
    spark = docs.sparkSession
    # The start marker makes the folder readable before anything is scanned.
    spark.createDataFrame([], LEDGER_SCHEMA).write.mode("overwrite").parquet(f"{ledger_path}/run=start")
    seen = spark.read.schema(LEDGER_SCHEMA).option("recursiveFileLookup", "true").parquet(ledger_path)
    scan(docs, seen, rules).write.parquet(f"{ledger_path}/run={uuid.uuid4().hex}")
    now = spark.read.schema(LEDGER_SCHEMA).option("recursiveFileLookup", "true").parquet(ledger_path)
    current = F.array(*[F.lit(f"{r.kind}:{r.version}") for r in rules])
    return now.where(F.array_contains(current, F.concat_ws(":", "kind", "version")))


def findings(docs: DataFrame, ledger: DataFrame, rules=RULES) -> DataFrame:
    """doc_id and hits: array of (start, place of the kind in the rules, kind, end), sorted."""
    place = F.array_position(F.array(*[F.lit(r.kind) for r in rules]), F.col("kind")).cast("int")
    hits = (ledger.where(F.size("spans") > 0).select("blob", "kind", place.alias("place"), F.explode("spans").alias("s"))
            .select("blob", F.struct(F.col("s.start"), "place", "kind", F.col("s.end")).alias("hit"))
            .groupBy("blob").agg(F.array_sort(F.collect_set("hit")).alias("hits"))
            # A key of its own, so that the join shuffles both sides and can split a hot blob.
            .select(F.concat(F.col("blob"), F.lit("/")).alias("h_key"), "hits"))
    paths = docs.select("doc_id", F.concat(address(F.col("text")), F.lit("/")).alias("p_key"))
    return paths.join(hits, F.col("p_key") == F.col("h_key"), "left").select("doc_id", "hits")


def _joined(hits: Column) -> Column:
    return F.concat_ws(",", F.transform(hits, lambda h: F.concat_ws(
        ":", h["kind"], h["start"].cast("string"), h["end"].cast("string"))))


def report(found: DataFrame, base=BASE_RULES) -> DataFrame:
    """The digest columns per path: counts of the base kinds, their hash, and all spans."""
    hits = F.coalesce(F.col("hits"), F.array().cast("array<struct<start:int,place:int,kind:string,end:int>>"))
    of = lambda kinds: F.filter(hits, lambda h: h["kind"].isin(kinds))
    return found.select(
        "doc_id", *[F.size(of([r.kind])).cast("long").alias(f"n_{r.kind}") for r in base],
        F.sha2(_joined(of([r.kind for r in base])), 256).alias("base_sha256"), _joined(hits).alias("spans"))


def scan_paths(docs: DataFrame, ledger_path: str, rules=RULES) -> DataFrame:
    """Update the ledger and report every path."""
    return report(findings(docs, update(docs, ledger_path, rules), rules))

"""Filters, orderings and limits over notes.

Orderings always end with the whole note key, which is unique even where one loanID has
several notes, so that a limit after them is deterministic. A
limit after an ordering plans as ``TakeOrderedAndProject`` (per-partition top-k, then a
merge of k rows per partition), never a full sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notewise.session import checkpoint_dir
from notewise.sources.schema import NOTE_KEYS

# Sort presets: (column, ascending).
SORT_PRESETS = {
    "app": [("principal", True), ("interestRate", True)],
    "notebook": [
        ("feesPaid", True),
        ("principal", True),
        ("principalOutstanding", False),
        ("interestRate", True),
        ("cyclesTotal", True),
    ],
}


def open_notes(analyzed: DataFrame) -> DataFrame:
    """Notes that are not completed."""
    return analyzed.filter(~F.col("completed"))


def by_grade(df: DataFrame, grade: str | None = None) -> DataFrame:
    """Keep one grade; ``None`` keeps all (the filter reaches the scan when it can)."""
    return df if grade is None else df.filter(F.col("grade") == F.lit(grade))


def sort_keys(preset: str = "app") -> list[Column]:
    keys = [F.col(c).asc() if asc else F.col(c).desc() for c, asc in SORT_PRESETS[preset]]
    return keys + [F.col(c).asc() for c in NOTE_KEYS]


def order_notes(df: DataFrame, preset: str = "app") -> DataFrame:
    """Notes in a preset order (a range shuffle; use only where order is consumed)."""
    return df.orderBy(*sort_keys(preset))


def with_positions(df: DataFrame, preset: str = "app", name: str = "position") -> DataFrame:
    """Number the rows 0, 1, 2, ... in a preset order, without a single-task window.

    The rows are dealt out by ranges of the sort keys and sorted there; a row's place is its
    place in its range plus the rows of the ranges before, of which there is one count each.
    The sorted rows go through a checkpoint, as both steps must see the same ranges.
    """
    checkpoint_dir(df.sparkSession)
    place = F.monotonically_increasing_id()  # range * 2**33 + place in the range
    ordered = df.orderBy(*sort_keys(preset)).withColumn("_place", place).checkpoint()
    part = F.shiftright("_place", 33)
    sizes = ordered.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    # One row for each shuffle partition, so the window and the broadcast are small.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    local = F.col("_place") - F.shiftleft(part, 33)
    return (ordered.join(F.broadcast(starts), part == F.col("_part"))
            .select(*df.columns, (F.col("_start") + local).cast("bigint").alias(name)))


def top_notes(df: DataFrame, k: int, preset: str = "notebook") -> DataFrame:
    """The first ``k`` notes in a preset order."""
    return df.orderBy(*sort_keys(preset)).limit(k)


def preview(df: DataFrame, n: int = 5, order_by: str = "loanID") -> DataFrame:
    """First ``n`` rows in an explicit order, without a storage ``_id`` column."""
    if "_id" in df.columns:
        df = df.drop("_id")
    ties = [F.col(c).asc() for c in NOTE_KEYS if c in df.columns and c != order_by]
    return df.orderBy(F.col(order_by).asc(), *ties).limit(n)

"""Earnings over a timeframe (All Time / This Month / This Year).

The waterfall is cumulative, so re-running it on the payments of a period alone would pay
fees and principal first again. Period earnings are instead earnings as of the period
end minus earnings as of the period start, from one aggregate with conditional sums and
two waterfalls in the same projection.

``earnings_by_period`` gives every month, quarter or year at once: payments are summed per note
and period, a window runs them up to each period's end, and a waterfall before and
after each period gives what the note earned in it. A note has one row per period in which it
was paid, whatever the number of its instalments, so a hot loan is combined before any shuffle.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from notewise.operators.metrics import money_sum
from notewise.operators.notes import (
    _grades, finish_notes, is_paid, note_aggregate, rebuild_notes,
)
from notewise.operators.waterfall import waterfall
from notewise.sources.schema import NOTE_KEYS

PERIODS = {"month": 1, "quarter": 3, "year": 12}
TIMEFRAMES = ("all", "year", "month")


def timeframe_bounds(as_of, timeframe: str = "all") -> tuple[dt.date | None, dt.date]:
    """(start, end): earnings after the end of day ``start`` up to the end of ``end``."""
    end = as_of if isinstance(as_of, dt.date) else dt.date.fromisoformat(str(as_of))
    if timeframe == "all":
        return None, end
    if timeframe == "year":
        return dt.date(end.year, 1, 1) - dt.timedelta(days=1), end
    if timeframe == "month":
        return dt.date(end.year, end.month, 1) - dt.timedelta(days=1), end
    raise ValueError(f"timeframe must be one of {TIMEFRAMES}")


def earnings_timeframe(ledger: DataFrame, as_of, timeframe: str = "all",
                       grades: DataFrame | None = None, by=None) -> DataFrame:
    """(periodStart, periodEnd, earningsAtStart, earningsAtEnd, earnings)."""
    start, end = timeframe_bounds(as_of, timeframe)
    cond = {"end": F.col("datePaid") <= F.lit(end)}
    if start is not None:
        cond["start"] = F.col("datePaid") <= F.lit(start)
    notes = rebuild_notes(ledger, grades, as_of=cond)
    notes = waterfall(notes, paid="end_repaid", suffix="_end")
    earned_end = F.col("badDebtFundsReceived_end") + F.col("profitsReceived_end")
    if start is not None:
        notes = waterfall(notes, paid="start_repaid", suffix="_start")
        earned_start = F.col("badDebtFundsReceived_start") + F.col("profitsReceived_start")
    else:
        earned_start = F.lit(0.0)
    agg = notes.groupBy(*(by or [])).agg(
        money_sum(earned_start).alias("earningsAtStart"),
        money_sum(earned_end).alias("earningsAtEnd"),
    )
    return agg.select(
        *(by or []),
        F.lit(start).cast("date").alias("periodStart"),
        F.lit(end).alias("periodEnd"),
        "earningsAtStart", "earningsAtEnd",
        F.round(F.col("earningsAtEnd") - F.col("earningsAtStart"), 2).alias("earnings"),
    )


def earnings_by_period(ledger: DataFrame, period: str = "month", grades: DataFrame | None = None, by=None) -> DataFrame:
    """Earnings of every period from the first with a payment to the last, one row each (per group
    of ``by``, note columns that a note does not change, such as its grade): periodStart (the
    day before the period), periodEnd, notesPaid, notesExcluded, earningsAtStart, earningsAtEnd,
    earnings.

    A row equals ``earnings_timeframe`` at its bounds. Periods without payments earn 0.
    ``notesExcluded`` counts the notes paid in the period whose earnings are unknown (say, of an
    unknown grade); those are in no sum.
    """
    if period not in PERIODS:
        raise ValueError(f"period must be one of {tuple(PERIODS)}")
    by = list(by or [])
    grades = _grades(ledger, grades)
    of = F.when(is_paid(), F.trunc("datePaid", period))
    # First level: one row per note and period, combined map-side; second: the note's own rows.
    parts = note_aggregate(ledger.withColumn("period", of), keys=["period"])
    # One order serves every window, so a task sorts its rows once: a note has one row per period.
    note = Window.partitionBy(*NOTE_KEYS).orderBy(F.col("period").asc_nulls_first())
    upto = note.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = note.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    paid = F.coalesce(F.col("all_repaid"), F.lit(0).cast("bigint"))
    sums = ["cyclesTotal", "fees_units", "interest_units", "total_units", "total_rows", "all_payments"]
    runs = parts.withColumns(
        {c: F.sum(c).over(whole) for c in sums}
        | {"firstDueDate": F.min("firstDueDate").over(whole), "all_repaid": F.sum(paid).over(upto), "own_repaid": paid,
           "own_payments": F.col("all_payments"), "first": F.row_number().over(note) == 1})
    before = {"before_repaid": F.col("all_repaid") - F.col("own_repaid"), "before_payments": F.lit(0)}
    notes = finish_notes(runs.withColumns(before), grades, as_of={"before": None}, keep=["period", "own_payments", "first"])
    notes = waterfall(waterfall(notes, suffix="_end"), paid="before_repaid", suffix="_start")
    earned = {s: F.col(f"badDebtFundsReceived_{s}") + F.col(f"profitsReceived_{s}") for s in ("start", "end")}
    paid_in = F.col("own_payments") > 0
    # What notes have earned before any payment (0 but for negative categories) counts from the start.
    per = notes.groupBy(*by, "period").agg(
        money_sum(F.when(F.col("first"), earned["start"])).alias("base"),
        money_sum(F.when(paid_in, earned["end"])).alias("end"), money_sum(F.when(paid_in, earned["start"])).alias("start"),
        F.count(F.when(paid_in, F.lit(1))).alias("paid"), F.count(F.when(paid_in & earned["end"].isNull(), F.lit(1))).alias("out"))
    # From here on there is one row per period (and group): a calendar, not data.
    group, every = Window.partitionBy(*(by or [F.lit(1)])), Window.partitionBy(F.lit(1))
    step = F.expr(f"interval {PERIODS[period]} month")
    calendar = (per.withColumns({"low": F.min("period").over(every), "high": F.max("period").over(every)})
                .select(*by, "low", "high").distinct().where("low is not null")
                .select(*by, F.explode(F.sequence("low", "high", step)).alias("period"),
                        *[F.lit(0.0).alias(c) for c in ("base", "end", "start")], *[F.lit(0).cast("long").alias(c) for c in ("paid", "out")]))
    dense = per.unionByName(calendar).groupBy(*by, "period").agg(*[F.sum(c).alias(c) for c in ("base", "end", "start", "paid", "out")])
    gain = F.round(F.col("end") - F.col("start"), 2)
    run = group.orderBy(F.col("period").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = F.round(F.sum("base").over(group) + F.sum("gain").over(run), 2)
    return (dense.withColumn("gain", gain).withColumn("total", total).where("period is not null")
            .select(*by, F.date_sub("period", 1).alias("periodStart"), F.last_day(F.add_months("period", PERIODS[period] - 1)).alias("periodEnd"),
                    F.col("paid").alias("notesPaid"), F.col("out").alias("notesExcluded"),
                    F.round(F.col("total") - F.col("gain"), 2).alias("earningsAtStart"),
                    F.col("total").alias("earningsAtEnd"), F.col("gain").alias("earnings")))

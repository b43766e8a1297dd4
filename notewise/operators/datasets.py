"""Chart-ready datasets as tidy DataFrames (the rendering itself is out of scope).

Each dataset is one Spark job: no per-series actions and no positional alignment of
separately collected lists; every row carries its own keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notewise.functions.fmt import money_text, short_amount_text
from notewise.operators.metrics import money_sum
from notewise.operators.selection import by_grade
from notewise.sources.dims import grade_dim
from notewise.sources.schema import FUNDS_COMPONENTS, GRADE_BAD_DEBT_RATES, PROGRESS_SERIES


def funds_allocation(analyzed: DataFrame, total_funds: float) -> DataFrame:
    """Funds split over open notes: available, bad-debt reserve received, principal
    outstanding. 3 rows (sortOrder, component, amount, label); the label is the amount and
    the component's name on a second line, '' when the amount is <= 0."""
    is_open = ~F.col("completed")
    totals = analyzed.agg(
        F.round(money_sum(F.when(is_open, F.col("principalOutstanding"))), 2).alias("po"),
        money_sum(F.when(is_open, F.col("badDebtFundsReceived"))).alias("bdf"),
    )
    available = F.round(F.lit(float(total_funds)) - F.col("po") - F.col("bdf"), 2)
    amounts = dict(zip(FUNDS_COMPONENTS, [available, F.col("bdf"), F.col("po")]))
    rows = [
        F.struct(F.lit(i).alias("sortOrder"), F.lit(name).alias("component"),
                 amounts[name].alias("amount"))
        for i, name in enumerate(FUNDS_COMPONENTS)
    ]
    long = totals.select(F.inline(F.array(*rows)))
    label = F.when(F.col("amount") <= 0, F.lit("")).otherwise(
        F.concat(money_text("amount"), F.lit("\n"), F.col("component")))
    return long.withColumn("label", label)


OTHER_GRADES = "other"


def grade_distribution(notes: DataFrame, grades: DataFrame | None = None, remainder: bool = False) -> DataFrame:
    """Principal per grade over all 10 grades in display order, 0 where a grade has no
    note. A zero row per grade is unioned in, so no outer join of two large sides is needed;
    the aggregate combines map-side. Notes of other grades (or none) are left out, unless
    ``remainder`` asks for one more row, ``other``, after the grades. The built-in grade
    table is broadcast; for a caller's own the optimizer chooses."""
    own = grades is None
    grades = (grade_dim(notes.sparkSession) if own else grades).select("gradeOrder", "grade")
    contributions = notes.select("grade", F.col("principal").cast("double").alias("amount"))
    zeros = grades.select("grade", F.lit(0.0).alias("amount"))
    if remainder:
        zeros = zeros.unionByName(zeros.limit(1).select(F.lit(OTHER_GRADES).alias("grade"), "amount"))
    every = contributions.unionByName(zeros)
    joined = every.join(F.broadcast(grades) if own else grades, "grade", "left" if remainder else "inner")
    if remainder:
        last = F.lit(len(GRADE_BAD_DEBT_RATES)) if own else F.lit(2 ** 31 - 1)
        joined = joined.withColumns({
            "grade": F.when(F.col("gradeOrder").isNull(), F.lit(OTHER_GRADES)).otherwise(F.col("grade")),
            "gradeOrder": F.coalesce(F.col("gradeOrder"), last)})
    return joined.groupBy("gradeOrder", "grade").agg(F.sum("amount").alias("principal"))


def _series_rows() -> Column:
    return F.array(*[
        F.struct(
            F.lit(i).alias("seriesOrder"),
            F.lit(col).alias("series"),
            F.lit(name).alias("seriesName"),
            F.lit(group).alias("seriesGroup"),
            F.round(F.col(col), 2).alias("amount"),
        )
        for i, (col, name, group) in enumerate(PROGRESS_SERIES)
    ])


def progress_series(analyzed: DataFrame, grade: str | None = None) -> DataFrame:
    """Per note, the 12 waterfall amounts as rows (a generator in the same stage as the
    scan: no shuffle), with display name, legend group and a hover text ('' for 0)."""
    df = by_grade(analyzed, grade)
    long = df.select("loanID", "company", "grade", F.inline(_series_rows()))
    hover = F.when(F.col("amount") == 0, F.lit("")).otherwise(
        F.concat(F.lit("$"), short_amount_text("amount")))
    return long.withColumn("hoverText", hover)


def progress_annotations(analyzed: DataFrame, grade: str | None = None) -> DataFrame:
    """Per note, where to write the months to break-even (principal - 2) and the text
    ('' when 0)."""
    df = by_grade(analyzed, grade)
    months = F.col("monthsToBreakeven")
    return df.select(
        "loanID", "company",
        (F.col("principal") - 2).alias("position"),
        F.when(months > 0, months.cast("string")).otherwise(F.lit("")).alias("label"),
    )

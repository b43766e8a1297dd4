"""Portfolio KPIs over analyzed notes, as aggregate DataFrames.

Every KPI is a single ``agg`` (one action for any number of KPIs), optionally grouped by
any columns (``by=["grade"]``). Values stay numeric: money to cents, percentages to four
decimals; text formatting is ``functions.fmt``'s job. Money sums run on exact integer cents.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notewise.functions.fmt import money_text, percent_text
from notewise.functions.loanmath import annualized_growth, from_units, to_units


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _grouped(df: DataFrame, by: Sequence[str] | None, *aggs: Column) -> DataFrame:
    return df.groupBy(*(by or [])).agg(*aggs)


def weighted_avg_expr(value, weight) -> Column:
    """sum(value * weight) / sum(weight) over the rows that have both, as one aggregate
    (null when those weights sum to 0)."""
    v, w = _c(value), _c(weight)
    return F.try_divide(F.sum(v * w), F.sum(F.when(v.isNotNull(), w)))


def weighted_avg(df: DataFrame, value, weight, by: Sequence[str] | None = None,
                 name: str = "weightedAvg") -> DataFrame:
    return _grouped(df, by, weighted_avg_expr(value, weight).alias(name))


def money_sum(x) -> Column:
    """Exact sum of a money column (in cents), back as DOUBLE; 0 for no rows."""
    return from_units(F.coalesce(F.sum(to_units(x)), F.lit(0).cast("bigint")))


def earnings() -> Column:
    return F.col("badDebtFundsReceived") + F.col("profitsReceived")


def current_growth() -> Column:
    """Annualised growth of what a note has earned so far (bad-debt reserve + profits)."""
    return annualized_growth(earnings(), "principal", "cyclesTotal", "cyclesRemaining")


def projected_growth() -> Column:
    """Annualised growth of all profits a note will have earned at maturity."""
    projected = F.col("profitsReceived") + F.col("nextProfitsPayment") + F.col("profitsOutstanding")
    return annualized_growth(projected, "principal", "cyclesTotal")


def _roi(growth: Column) -> Column:
    return F.round((weighted_avg_expr(growth, "principal") - F.lit(1.0)) * 100, 4)


def is_excluded() -> Column:
    """A note without earnings or growth (say, of an unknown grade): no part of those KPIs."""
    return (earnings().isNull() | current_growth().isNull() | projected_growth().isNull()
            | F.col("principal").isNull())


def kpi_columns(total_funds: float | None = None) -> dict[str, Column]:
    """Aggregate expressions of all KPIs, by output name, with the number and principal of
    the notes that earnings and returns leave out for lack of a value."""
    cols = {
        "notes": F.count(F.lit(1)),
        "notesExcluded": F.count(F.when(is_excluded(), F.lit(1))),
        "principalExcluded": money_sum(F.when(is_excluded(), F.col("principal"))),
        "totalEarnings": from_units(F.coalesce(
            F.sum(to_units("badDebtFundsReceived") + to_units("profitsReceived")),
            F.lit(0).cast("bigint"))),
        "currentRoi": _roi(current_growth()),
        "netRoi": _roi(projected_growth()),
        "diversification": F.round(F.try_divide(F.max("principal"), F.sum("principal")) * 100, 4),
    }
    if total_funds is not None:
        funds = F.lit(float(total_funds))
        cols["fundsRemaining"] = F.round(funds - money_sum("principalOutstanding"), 2)
        cols["fundsUninvested"] = F.round(funds - money_sum("principal"), 2)
    return cols


def kpi_total_earnings(df: DataFrame, by=None) -> DataFrame:
    """Sum of bad-debt reserve and profits received."""
    return _grouped(df, by, kpi_columns()["totalEarnings"].alias("totalEarnings"))


def kpi_current_roi(df: DataFrame, by=None) -> DataFrame:
    """(principal-weighted mean of annualised growth so far - 1) * 100."""
    return _grouped(df, by, kpi_columns()["currentRoi"].alias("currentRoi"))


def kpi_net_roi(df: DataFrame, by=None) -> DataFrame:
    """(principal-weighted mean of annualised projected profit growth - 1) * 100."""
    return _grouped(df, by, kpi_columns()["netRoi"].alias("netRoi"))


def kpi_diversification(df: DataFrame, by=None) -> DataFrame:
    """Largest note's share of all principal, in percent."""
    return _grouped(df, by, kpi_columns()["diversification"].alias("diversification"))


def kpi_funds_remaining(df: DataFrame, total_funds: float, by=None) -> DataFrame:
    """Funds minus principal still outstanding."""
    return _grouped(df, by, kpi_columns(total_funds)["fundsRemaining"].alias("fundsRemaining"))


def kpi_funds_uninvested(df: DataFrame, total_funds: float, by=None) -> DataFrame:
    """Funds minus all principal invested."""
    return _grouped(df, by, kpi_columns(total_funds)["fundsUninvested"].alias("fundsUninvested"))


def portfolio_kpis(df: DataFrame, total_funds: float | None = None, by=None) -> DataFrame:
    """All KPIs in one aggregate: one row, or one row per ``by`` group."""
    return _grouped(df, by, *[c.alias(n) for n, c in kpi_columns(total_funds).items()])


def portfolio_kpis_rollup(df: DataFrame, by: Sequence[str], total_funds: float | None = None) -> DataFrame:
    """All KPIs for every group, every subtotal and the whole portfolio, from one scan.

    ``by`` runs from the coarsest to the finest column. ``totalLevel`` says what a row covers:
    0 for a group of all columns, 1 when the last one is summed over, 3 for the last two, and
    so on; it tells a subtotal from a group whose own value is null.
    """
    aggs = [c.alias(n) for n, c in kpi_columns(total_funds).items()]
    return df.rollup(*by).agg(F.grouping_id().cast("bigint").alias("totalLevel"), *aggs)


def kpi_text(kpis: DataFrame) -> DataFrame:
    """The KPI strip as display text: money as ``$1,234.56``, percentages as ``12.3%``.

    Halves are rounded away from zero, as everywhere here; other columns stay as they are.
    """
    money = ("totalEarnings", "principalExcluded", "fundsRemaining", "fundsUninvested")
    percent = ("currentRoi", "netRoi", "diversification")
    return kpis.withColumns({c: money_text(c) for c in money if c in kpis.columns}
                            | {c: percent_text(c) for c in percent if c in kpis.columns})


def note_annualized_return(df: DataFrame, decimals: int = 8) -> DataFrame:
    """Per note: annualised growth so far and projected (the inputs of the ROI KPIs)."""
    return df.select("loanID", "principal", "cyclesTotal", "cyclesRemaining",
                     F.round(current_growth(), decimals).alias("currentGrowth"),
                     F.round(projected_growth(), decimals).alias("projectedGrowth"))

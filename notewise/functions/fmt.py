"""Display text for numbers, as Column expressions (a last, separate step)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def money_text(x) -> Column:
    """``$1,234.56``; a half cent goes away from zero."""
    return F.concat(F.lit("$"), F.format_number(F.round(_c(x), 2), 2))


def percent_text(x, decimals: int = 1) -> Column:
    """``12.3%``; a half goes away from zero."""
    return F.concat(F.format_string(f"%.{decimals}f", F.round(_c(x), decimals)), F.lit("%"))


def short_amount_text(x) -> Column:
    """A cent amount as the shortest text with at least one decimal: 12.5, 12.34, 12.0."""
    return F.regexp_replace(F.format_string("%.2f", _c(x)), r"(\.[0-9])0$", "$1")

"""Payment waterfall: split each note's repaid cash over ordered categories.

Cash pays the categories in order (default: fees, principal, bad-debt reserve, profits).
For a category of size ``c`` whose earlier categories sum to ``prefix``, with
``rel = amountRepayed - prefix`` and instalment ``U``:

* received    = clamp(rel, 0, c)
* next        = clamp(U + rel, 0, U) if rel < 0 else min(clamp(c - rel, 0, c), U)
* outstanding = clamp(c - (rel + U), 0, c)

The default ``next`` keeps the reference semantics, where a small category can show a
next payment larger than itself; ``cap_spillover=True`` uses the overlap of the next
instalment's cash interval with the category's segment instead, so the ``next`` values add
up to at most ``U``.

Arithmetic runs on exact integer money units (cents), so results do not depend on
floating-point summation order; outputs are DOUBLE. All columns are produced by one
projection (no shuffle, whole-stage codegen).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notewise.functions.exprcache import cached
from notewise.functions.loanmath import (
    ceil_div, clamp, from_units, max2, min2, to_units,
)
from notewise.sources.schema import (
    WATERFALL_CATEGORIES, next_column, outstanding_column, received_column,
)


def waterfall(
    notes: DataFrame,
    categories=WATERFALL_CATEGORIES,
    paid: str | Column = "amountRepayed",
    unit: str | Column = "unitPayment",
    cap_spillover: bool = False,
    scale: int = 2,
    suffix: str = "",
) -> DataFrame:
    """Add received / next / outstanding columns for every category.

    Two projections: the first turns money into integer units and the running prefix,
    the second applies the clamps, so each input is converted once.
    """
    if isinstance(paid, str) and isinstance(unit, str):
        key = ("waterfall", tuple(categories), paid, unit, cap_spillover, scale, suffix)
        staged, out = cached(key, lambda: _waterfall_exprs(
            categories, paid, unit, cap_spillover, scale, suffix))
    else:
        staged, out = _waterfall_exprs(categories, paid, unit, cap_spillover, scale, suffix)
    return notes.withColumns(staged).withColumns(out).drop(*staged.keys())


def _waterfall_exprs(categories, paid, unit, cap_spillover, scale, suffix):
    tag = f"__wf{suffix}_"
    zero = F.lit(0).cast("bigint")
    staged = {f"{tag}a": to_units(paid, scale), f"{tag}u": to_units(unit, scale)}
    prefix: Column = zero
    for k, cat in enumerate(categories):
        staged[f"{tag}c{k}"] = to_units(cat, scale)
        staged[f"{tag}p{k}"] = prefix
        prefix = prefix + F.col(f"{tag}c{k}")
    a, u = F.col(f"{tag}a"), F.col(f"{tag}u")
    out: dict[str, Column] = {}
    for k, cat in enumerate(categories):
        c, p = F.col(f"{tag}c{k}"), F.col(f"{tag}p{k}")
        rel = a - p
        received = clamp(rel, zero, c)
        if cap_spillover:
            nxt = max2(zero, min2(a + u, p + c) - max2(a, p))
        else:
            nxt = F.when(rel < 0, clamp(u + rel, zero, u)).otherwise(min2(clamp(c - rel, zero, c), u))
        outstanding = clamp(c - (rel + u), zero, c)
        out[received_column(cat) + suffix] = from_units(received, scale)
        out[next_column(cat) + suffix] = from_units(nxt, scale)
        out[outstanding_column(cat) + suffix] = from_units(outstanding, scale)
    return staged, out


def note_progress(analyzed: DataFrame, unit: str = "unitPayment", scale: int = 2) -> DataFrame:
    """Add ``monthsToBreakeven`` (instalments until the principal is back; null when the
    instalment is 0) and ``completed`` (no cycle remaining)."""
    def build():
        owed = to_units("nextPrincipalPayment", scale) + to_units("principalOutstanding", scale)
        return {
            "monthsToBreakeven": ceil_div(owed, to_units(unit, scale)).cast("int"),
            "completed": F.col("cyclesRemaining") == 0,
        }
    return analyzed.withColumns(cached(("progress", unit, scale), build))


def analyze_notes(notes: DataFrame, cap_spillover: bool = False) -> DataFrame:
    """Waterfall plus progress columns for notes with payments applied."""
    return note_progress(waterfall(notes, cap_spillover=cap_spillover))

"""Closed-form loan formulas as native Column expressions (no UDFs).

Every function takes and returns ``Column`` objects, so the whole note pipeline stays
inside whole-stage codegen. Divisions that can meet a zero use ``try_divide`` (null
instead of an ANSI error); the null is reported by the data-quality operators.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONTHS_PER_YEAR = 12
PERCENT_PER_MONTH = 1200.0  # annual percent -> monthly fraction


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _both(a: Column, b: Column) -> Column:
    return a.isNotNull() & b.isNotNull()


def min2(a, b) -> Column:
    """least(a, b), but null when either side is null (``least`` skips nulls)."""
    a, b = _c(a), _c(b)
    return F.when(_both(a, b), F.least(a, b))


def max2(a, b) -> Column:
    """greatest(a, b), but null when either side is null."""
    a, b = _c(a), _c(b)
    return F.when(_both(a, b), F.greatest(a, b))


def clamp(x, lo, hi) -> Column:
    """max(lo, min(x, hi)): null in, null out; never fails when lo > hi (gives lo)."""
    x, lo, hi = _c(x), _c(lo), _c(hi)
    return F.when(x.isNotNull() & lo.isNotNull() & hi.isNotNull(),
                  F.greatest(lo, F.least(x, hi)))


def monthly_rate(annual_pct) -> Column:
    return _c(annual_pct) / F.lit(PERCENT_PER_MONTH)


def annuity_principal(unit_payment, annual_pct, cycles) -> Column:
    """Present value of ``cycles`` payments of ``unit_payment``, rounded to whole units.

    ``U / i * (1 - 1 / (1 + i)^n)`` with ``i`` the monthly rate; at ``i = 0`` the limit
    ``U * n``.
    """
    u, n = _c(unit_payment), _c(cycles)
    i = monthly_rate(annual_pct)
    pv = F.try_divide(u, i) * (F.lit(1.0) - F.try_divide(F.lit(1.0), F.pow(F.lit(1.0) + i, n)))
    return F.round(F.when(i == 0, u * n).otherwise(pv), 0)


def bad_debt_reserve(principal, bad_debt_pct, cycles) -> Column:
    """Interest a loan of ``principal`` would cost at the grade's default rate, to cents.

    ``P * (n * r / (1 - (1 + r)^-n) - 1)``; 0 at ``r = 0`` (the limit), null when the
    rate is unknown.
    """
    p, n = _c(principal), _c(cycles)
    r = monthly_rate(bad_debt_pct)
    factor = F.try_divide(n * r, F.lit(1.0) - F.pow(F.lit(1.0) + r, -n)) - F.lit(1.0)
    return F.round(F.when(r == 0, F.lit(0.0)).otherwise(p * factor), 2)


def annualized_growth(earnings, principal, cycles_total, cycles_remaining=None) -> Column:
    """Growth factor per year: 1 when no cycle has elapsed, else
    ``(E / P + 1) ^ (12 / (n - rem))``."""
    e, p, n = _c(earnings), _c(principal), _c(cycles_total)
    rem = F.lit(0) if cycles_remaining is None else _c(cycles_remaining)
    elapsed = n - rem
    grown = F.pow(F.try_divide(e, p) + F.lit(1.0),
                  F.try_divide(F.lit(float(MONTHS_PER_YEAR)), elapsed))
    return F.when(elapsed == 0, F.lit(1.0)).otherwise(grown)


def to_units(x, scale: int = 2) -> Column:
    """Money as an exact integer count of 10^-scale units (cents by default).

    Rounds half away from zero, like ``round``, by truncating ``x * 10^scale`` moved half a
    unit outwards: exact for amounts below 2^53 units, and plain floating-point work, unlike
    ``round`` on doubles, which goes through ``BigDecimal`` for every value.
    """
    v = _c(x).cast("double") * F.lit(float(10 ** scale))
    return (v + F.signum(v) * F.lit(0.5)).cast("bigint")


def round_units(u, digits: int) -> Column:
    """Integer units with ``digits`` fewer decimals, rounded half away from zero."""
    step = 10 ** digits
    u = _c(u)
    moved = u + F.when(u < 0, F.lit(-(step // 2))).otherwise(F.lit(step // 2))
    return ((moved - moved % step) / step).cast("bigint")


def from_units(u, scale: int = 2) -> Column:
    return _c(u) / F.lit(float(10 ** scale))


def ceil_div(a, b) -> Column:
    """Exact ceil(a / b) on integers (both signs); null when b is 0 or null."""
    a, b = _c(a), _c(b)
    rem = a % b
    truncated = ((a - rem) / b).cast("bigint")  # a - rem is a multiple of b: exact
    bump = F.when((rem != 0) & ((a > 0) == (b > 0)), 1).otherwise(0)
    return F.when(b != 0, truncated + bump)

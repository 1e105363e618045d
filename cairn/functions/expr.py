"""Small column expressions shared by the operators."""

from __future__ import annotations

from fractions import Fraction
from functools import reduce

from pyspark.sql import Column, functions as F

__all__ = [
    "band", "band_ge", "band_gt", "band_le", "rnd", "pct", "flag", "tally",
    "normal_cdf", "as_number", "standardised", "all_of", "col", "exact_share",
]


def col(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def _bands(tests, otherwise):
    out = None
    for cond, label in tests:
        out = F.when(cond, label) if out is None else out.when(cond, label)
    return out.otherwise(otherwise)


def band(value, limits, otherwise=None) -> Column:
    """First label whose limit is above ``value`` (strict <)."""
    v = col(value)
    return _bands([(v < lim, F.lit(lab)) for lim, lab in limits], F.lit(otherwise))


def band_le(value, limits, otherwise=None) -> Column:
    v = col(value)
    return _bands([(v <= lim, F.lit(lab)) for lim, lab in limits], F.lit(otherwise))


def band_ge(value, limits, otherwise=None) -> Column:
    """First label whose limit ``value`` reaches (>=)."""
    v = col(value)
    return _bands([(v >= lim, F.lit(lab)) for lim, lab in limits], F.lit(otherwise))


def band_gt(value, limits, otherwise=None) -> Column:
    v = col(value)
    return _bands([(v > lim, F.lit(lab)) for lim, lab in limits], F.lit(otherwise))


def rnd(value, places=6) -> Column:
    """Half-up rounding without negative zero."""
    return F.round(col(value).cast("double"), places) + F.lit(0.0)


def pct(part, whole) -> Column:
    return col(part) * F.lit(100.0) / F.nullif(col(whole), F.lit(0))


def flag(cond: Column) -> Column:
    """1 where the condition holds, else 0 (null counts as 0)."""
    return F.when(cond, 1).otherwise(0)


def tally(cond: Column) -> Column:
    """Number of rows for which the condition holds."""
    return F.count(F.when(cond, 1))


def all_of(conds) -> Column:
    return reduce(lambda a, b: a & b, conds)


def standardised(value, mean, sd) -> Column:
    return (col(value) - col(mean)) / F.nullif(col(sd), F.lit(0.0))


def as_number(column: str, dtype: str) -> Column:
    """Monotone double image of a numeric, date or timestamp column."""
    c = F.col(column)
    if dtype.startswith("timestamp"):
        return F.unix_micros(c.cast("timestamp")).cast("double")
    if dtype == "date":
        return F.unix_date(c).cast("double")
    return c.cast("double")


def exact_share(value) -> tuple[int, int]:
    """A share such as 0.7 as two whole numbers (7, 10), as it is written, so
    that positions are compared without binary fractions."""
    f = Fraction(str(value))
    return f.numerator, f.denominator


def normal_cdf(z) -> Column:
    """Standard normal CDF, error function by Abramowitz-Stegun 7.1.26."""
    z = col(z)
    # Published coefficients of formula 7.1.26.
    p, a = 0.3275911, (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1.0 / (1.0 + p * x)
    poly = reduce(lambda acc, c: (acc + F.lit(c)) * t, reversed(a), F.lit(0.0))
    half = 0.5 * poly * F.exp(-x * x)
    return F.when(z >= 0, 1.0 - half).otherwise(half)

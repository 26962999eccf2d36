"""Scalar Column helpers: clamps, null/NaN rules, rounding, logistic maths."""
from __future__ import annotations

from pyspark.sql import Column, functions as F


def col(x) -> Column:
    """Accept a column name, a Column or a Python number."""
    if isinstance(x, Column):
        return x
    if isinstance(x, str):
        return F.col(x)
    return F.lit(x)


def finite_or(x, default) -> Column:
    """``x`` when it is a finite double, else ``default`` (strings are cast)."""
    d = col(x).try_cast("double")
    ok = d.isNotNull() & ~F.isnan(d) & (F.abs(d) < F.lit(float("inf")))
    return F.when(ok, d).otherwise(col(default).cast("double"))


def is_finite(x) -> Column:
    d = col(x).try_cast("double")
    return F.coalesce(d.isNotNull() & ~F.isnan(d) & (F.abs(d) < F.lit(float("inf"))), F.lit(False))


def clamp(x, lo, hi) -> Column:
    return F.greatest(col(lo), F.least(col(hi), col(x)))


def clamp01(x) -> Column:
    """Clamp to [0, 1]; null and NaN read as 0.

    The argument appears once, so nested clamps do not multiply expressions.
    """
    c = F.nanvl(F.coalesce(col(x).cast("double"), F.lit(0.0)), F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


clamp01_zero = clamp01


def round_half_up(x) -> Column:
    """Integer rounding with halves going towards +infinity, as BIGINT."""
    return F.floor(col(x) + F.lit(0.5))


def round_to(x, digits: int) -> Column:
    """Fixed-digit rounding by floor(x * 10^d + 0.5) / 10^d."""
    scale = F.lit(float(10 ** digits))
    return F.floor(col(x) * scale + F.lit(0.5)) / scale


def parse_flag(x, default: bool) -> Column:
    """Boolean from 'true'/'false' text or a number; anything else is default."""
    s = F.lower(F.trim(col(x).cast("string")))
    n = s.try_cast("double")
    return (F.when(s == "true", F.lit(True)).when(s == "false", F.lit(False))
            .when(n.isNotNull(), n != 0).otherwise(F.lit(default)))


def sigmoid(x) -> Column:
    """1 / (1 + e^-x); far arguments saturate at 0 or 1, null and NaN read as 0."""
    return 1.0 / (1.0 + F.exp(-F.nanvl(F.coalesce(col(x), F.lit(0.0)), F.lit(0.0))))


def softplus(x) -> Column:
    """ln(1 + e^x) without overflow."""
    c = col(x)
    return F.greatest(c, F.lit(0.0)) + F.log1p(F.exp(-F.abs(c)))


def safe_probability(p) -> Column:
    return F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), clamp01_zero(p)))


def binary_entropy(p) -> Column:
    q = safe_probability(p)
    return -q * F.log(q) - (1.0 - q) * F.log(1.0 - q)


def beta_calibrate(p, alpha: float, beta: float, bias: float) -> Column:
    q = safe_probability(p)
    return sigmoid(F.lit(alpha) * F.log(q) + F.lit(beta) * F.log(1.0 - q) + F.lit(bias))


def positive_or(x, default) -> Column:
    """``Number(x) || default``: null, NaN and 0 all fall back."""
    d = F.nanvl(F.coalesce(col(x).try_cast("double"), F.lit(0.0)), F.lit(0.0))
    return F.when(d == 0, col(default).cast("double")).otherwise(d)

"""Numeric column helpers: missing values, order-independent means, rounding, erfc."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def nan_to_null(c: Column) -> Column:
    """NaN and the two infinities become null."""
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def normalise_missing(df: DataFrame) -> DataFrame:
    """`nan_to_null` over every floating column."""
    floats = [n for n, t in df.dtypes if t in ("double", "float")]
    return df.withColumns({n: nan_to_null(F.col(n)) for n in floats}) if floats else df


def safe_double(c: Column, default: float | None = None) -> Column:
    """Text or number to double; anything unreadable or NaN becomes the default."""
    return F.coalesce(nan_to_null(c.try_cast("double")), F.lit(default).cast("double"))


def fixed_point(c: Column, scale: int = 6) -> Column:
    """The value in whole units of 10^-scale, as a decimal whose sums are exact; null for NaN and infinities."""
    return F.rint(c * float(10**scale)).try_cast("decimal(38,0)")


def _units(c: Column, scale: int) -> Column:
    """Whole units of 10^-scale; null for NaN, infinities and what has more than 63 bits of units."""
    return F.rint(c * float(10**scale)).try_cast("long")


def _unit_sum(c: Column, scale: int, over=None) -> Column:
    """Sum of whole units, from two sums of long numbers: multiples of 2^20 and what is left of them.

    Neither overflows below 2^43 rows of 2^53 units each, and whole numbers add up to the same
    total in any order, so retries and other partitionings give the same bits.
    """
    units = _units(c, scale)
    parts = [F.sum(F.shiftright(units, 20)), F.sum(units.bitwiseAND(F.lit((1 << 20) - 1)))]
    high, low = parts if over is None else [p.over(over) for p in parts]
    return high * float(1 << 20) + low


def exact_sum(c: Column, scale: int = 6) -> Column:
    """Order-independent sum of the values that have whole units (see `_units`)."""
    return _unit_sum(c, scale) / float(10**scale)


def exact_avg(c: Column, scale: int = 6) -> Column:
    """Mean of exactly the values that `exact_sum` adds up; null when there are none."""
    return F.try_divide(exact_sum(c, scale), F.count(_units(c, scale)))


def window_avg(c: Column, window, scale: int = 6) -> Column:
    """`exact_avg` over a window."""
    total = _unit_sum(c, scale, window) / float(10**scale)
    return F.try_divide(total, F.count(_units(c, scale)).over(window))


def round_half_even(c: Column, digits: int = 0) -> Column:
    """Round half to even at a decimal position."""
    if digits == 0:
        return F.rint(c)
    factor = float(10**digits)
    return F.rint(c * factor) / factor


def greatest_or_null(*cols: Column) -> Column:
    """`greatest` that is null as soon as one argument is (plain `greatest` skips nulls)."""
    missing = cols[0].isNull()
    for c in cols[1:]:
        missing = missing | c.isNull()
    return F.when(missing, None).otherwise(F.greatest(*cols))


def _scaled_erfc(z: float) -> float:
    """erfc(z) * exp(z^2) for z >= 0."""
    if z < 8.0:
        return math.erfc(z) * math.exp(z * z)
    term, total = 1.0, 1.0
    for k in range(1, 20):
        term *= -(2 * k - 1) / (2.0 * z * z)
        total += term
        if abs(term) < 1e-18:
            break
    return total / (z * math.sqrt(math.pi))


def _erfc_polynomial(degree: int = 26) -> list[float]:
    """Power-basis coefficients of log(erfc(z) e^(z^2) / t) in x = 2t - 1, t = 2 / (2 + z)."""

    def target(x):
        t = (np.asarray(x) + 1.0) / 2.0
        z = 2.0 / np.maximum(t, 1e-12) - 2.0
        return np.array([math.log(_scaled_erfc(zz) / tt) for zz, tt in zip(z, np.maximum(t, 1e-12))])

    cheb = np.polynomial.chebyshev.chebinterpolate(target, degree)
    return [float(v) for v in np.polynomial.chebyshev.cheb2poly(cheb)]


ERFC_COEFFICIENTS = _erfc_polynomial()


def erfc_argument(x: Column) -> Column:
    """Argument of the polynomial behind `erfc`, in [-1, 1]."""
    return 2.0 * (2.0 / (2.0 + F.abs(x))) - 1.0


def erfc_text(x: str, u: str) -> str:
    """SQL text of `erfc` for a column x whose polynomial argument is column u."""
    poly = f"{ERFC_COEFFICIENTS[-1]!r}D"
    for c in reversed(ERFC_COEFFICIENTS[:-1]):
        poly = f"({poly} * {u} + {c!r}D)"
    tail = f"2.0D / (2.0D + abs({x})) * exp(-abs({x}) * abs({x}) + {poly})"
    return f"CASE WHEN {x} >= 0 THEN {tail} ELSE 2.0D - {tail} END"


def erfc(x: Column) -> Column:
    """Complementary error function as one Horner chain (no UDF)."""
    u, z = erfc_argument(x), F.abs(x)
    poly = F.lit(ERFC_COEFFICIENTS[-1])
    for c in reversed(ERFC_COEFFICIENTS[:-1]):
        poly = poly * u + c
    tail = 2.0 / (2.0 + z) * F.exp(-z * z + poly)
    return F.when(x >= 0, tail).otherwise(2.0 - tail)

"""Numeric column helpers that stay inside generated code."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(num, den, default: float = 0.0) -> Column:
    """num / den as double, ``default`` when the denominator is 0 or null."""
    return F.coalesce(F.try_divide(as_col(num).cast("double"), as_col(den).cast("double")), F.lit(default))


def clamp(c, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.lit(float(high)), F.greatest(F.lit(float(low)), as_col(c)))


def rnd(c, digits: int = 4) -> Column:
    """Rounded double; adding zero turns a rounded -0.0 into 0.0."""
    return F.round(as_col(c).cast("double"), digits) + F.lit(0.0)


def rnd_scaled(c, digits: int) -> Column:
    """Rounded as SQL engines with C doubles do: the scaled double decides, not its shortest decimal spelling."""
    scale = F.lit(10.0**digits)
    return F.round(as_col(c).cast("double") * scale, 0) / scale + F.lit(0.0)


def band(c, cuts: Sequence[tuple[float, str]], other: str) -> Column:
    """First name whose lower bound is reached; ``cuts`` run from high to low."""
    out = None
    for low, name in cuts:
        test = as_col(c) >= F.lit(low)
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise(other)


def count_if(test: Column) -> Column:
    return F.count(F.when(test, F.lit(1)))


def first_match(*pairs: tuple[Column, object], other=None) -> Column:
    """CASE WHEN chain from (test, value) pairs."""
    out = None
    for test, value in pairs:
        value = value if isinstance(value, Column) else F.lit(value)
        out = F.when(test, value) if out is None else out.when(test, value)
    other = other if isinstance(other, Column) else F.lit(other)
    return out.otherwise(other)


def flags(*pairs: tuple[Column, object]) -> Column:
    """Array of the values whose test holds."""
    return F.array_compact(
        F.array(*[F.when(test, value if isinstance(value, Column) else F.lit(value)) for test, value in pairs])
    )

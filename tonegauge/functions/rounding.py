"""Rounding that agrees with IEEE doubles rather than with their decimal text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_scaled(c: Column, digits: int) -> Column:
    """Scale, round half to even, scale back."""
    scale = float(10**digits)
    return F.rint(c * F.lit(scale)) / F.lit(scale)


def round_exact(c: Column, digits: int) -> Column:
    """Nearest decimal to the exact binary value; a true tie goes to the even digit.

    0.35 is stored slightly below 0.35, so one digit gives 0.3. Whether a value lies above or
    below the midpoint m/(2*10^d) is the sign of 2*10^d*x - m. Adding the powers of two of the
    factor from the largest down keeps every step exact near the midpoint.
    """
    factor = 2 * 10**digits
    size = F.abs(c)
    lower = F.floor(size * F.lit(float(10**digits))).cast("double")
    residual = -(lower * F.lit(2.0) + F.lit(1.0))
    for bit in reversed(range(factor.bit_length())):
        if factor >> bit & 1:
            residual = residual + size * F.lit(float(1 << bit))
    odd = lower - F.lit(2.0) * F.floor(lower / F.lit(2.0)) == F.lit(1.0)
    up = (residual > 0.0) | ((residual == 0.0) & odd)
    whole = F.when(up, lower + F.lit(1.0)).otherwise(lower)
    # Adding zero turns a negative zero into a plain one.
    return F.signum(c) * whole / F.lit(float(10**digits)) + F.lit(0.0)


def fixed_text(c: Column, digits: int) -> Column:
    """Fixed-point text of `round_exact`; the formatter alone would round decimal ties upward."""
    return F.format_string(f"%.{digits}f", round_exact(c, digits))

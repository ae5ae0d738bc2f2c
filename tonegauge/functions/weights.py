"""Age weights. `as_of` is explicit so that a rerun gives the same numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def day(value) -> Column:
    """A date column from a column, a date or ISO text; None means today."""
    if value is None:
        return F.current_date()
    return value if isinstance(value, Column) else F.to_date(F.lit(value))


def half_life_weight(date: Column, as_of=None, half_life_days: float = 3.0) -> Column:
    """0.5^(age/half life); dates after `as_of` weigh 1."""
    age = F.greatest(F.datediff(day(as_of), F.to_date(date)), F.lit(0))
    weight = F.pow(F.lit(0.5), age / F.lit(float(half_life_days)))
    return F.when(date.isNotNull(), weight)


def exponential_weight(date: Column, as_of=None, scale_days: float = 30.0) -> Column:
    """exp(-age/scale); dates after `as_of` weigh more than 1."""
    age = F.datediff(day(as_of), F.to_date(date))
    return F.exp(-age.cast("double") / F.lit(float(scale_days)))

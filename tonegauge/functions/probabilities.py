"""Class probabilities to labels and scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Class names in the order a classifier reports them by default.
CLASS_ORDER = ("positive", "negative", "neutral")


def argmax_label(probabilities: Column, labels: Sequence[str] = CLASS_ORDER) -> Column:
    """Name of the largest probability; equal ones give the first."""
    where = F.array_position(probabilities, F.array_max(probabilities)).cast("int")
    names = F.array(*[F.lit(name) for name in labels])
    return F.when(where > 0, F.try_element_at(names, where))


def class_probability(
    probabilities: Column, name: str, labels: Sequence[str] = CLASS_ORDER
) -> Column:
    return F.element_at(probabilities, list(labels).index(name) + 1).cast("double")

"""Time columns that need the whole table: even spreading, and age weights."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from tonegauge.functions.weights import half_life_weight
from tonegauge.session import materialise

# The span given to a corpus that has no dates.
SPREAD_START = date(2020, 1, 1)
SPREAD_END = date(2023, 12, 31)

_ROW_BITS = 33  # monotonically_increasing_id: partition number above, row number below


def with_row_index(df: DataFrame, order_by: Sequence[Column], into: str) -> DataFrame:
    """0-based position in a total order, plus the row total as `<into>_total`.

    One range shuffle sorts the rows; each partition numbers its own rows; the offsets come from
    one count per partition. The sorted rows are written once because the counts and the rows must
    see the same range bounds, also after an executor is lost. `order_by` must be unique.
    """
    local = "__local"
    ordered = df.orderBy(*order_by).withColumn(local, F.monotonically_increasing_id())
    stored = materialise(ordered, "row-index")
    part = F.shiftright(F.col(local), _ROW_BITS)
    sizes = stored.groupBy(part.alias("__part")).agg(F.count("*").alias("__size"))
    # One row per sort partition: bounded by the shuffle width, not by the data.
    before = Window.partitionBy(F.lit(0)).orderBy("__part").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = sizes.select(
        "__part",
        F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__offset"),
        F.sum("__size").over(Window.partitionBy(F.lit(0))).alias(f"{into}_total"),
    )
    row = F.col(local).bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return (
        stored.withColumn("__part", part)
        .join(F.broadcast(offsets), "__part")
        .withColumn(into, F.col("__offset") + row)
        .drop("__part", "__offset", local)
    )


def spread_dates(
    df: DataFrame,
    order_by: Sequence[Column],
    start: date = SPREAD_START,
    end: date = SPREAD_END,
    into: str = "date",
) -> DataFrame:
    """Give row i of n the day `start + floor(i*span/max(n-1,1))`."""
    indexed = with_row_index(df, order_by, "__i")
    span = (end - start).days
    # Exact integer division; the product stays below 2^63 for any row count that fits a table.
    days = F.expr(f"(__i * {span}) DIV greatest(__i_total - 1, 1)").cast("int")
    return indexed.withColumn(into, F.date_add(F.lit(start), days)).drop("__i", "__i_total")


def with_time_weight(
    df: DataFrame, as_of=None, half_life_days: float = 3.0, observation: Observation | None = None
) -> DataFrame:
    """Add the half-life weight; an `Observation` receives its mean and minimum on the next action."""
    weighted = df.withColumn(
        "time_weight", half_life_weight(F.col("date"), as_of, half_life_days)
    )
    if observation is None:
        return weighted
    return weighted.observe(
        observation,
        F.avg("time_weight").alias("mean_weight"),
        F.min("time_weight").alias("min_weight"),
    )

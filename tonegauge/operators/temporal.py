"""Daily series per entity, rolling statistics, z-scores and what is read off them.

Raw rows are reduced to one row per (entity, day) before any window, so a window partition holds
at most one row per day however many headlines an entity has.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonegauge.config import CURRENT, RiskProfile
from tonegauge.functions.buckets import trend_word

TEMPORAL_COLUMNS = (
    "date",
    "daily_avg_sentiment",
    "rolling_mean",
    "rolling_std",
    "z_score",
    "entity",
    "anomaly_flag",
)


def _value(scored: DataFrame, weighted: bool | None) -> Column:
    if weighted is None:
        weighted = "time_weight" in scored.columns
    score = F.col("sentiment_score")
    return score * F.col("time_weight") if weighted else score


def daily_rollup(scored: DataFrame, weighted: bool | None = None) -> DataFrame:
    """Mergeable per-(entity, day) sums: everything the series and the summary need, in one pass.

    Rows without an entity are left out; rows without a date keep their own row, so that they
    count in the summary but never in a series.
    """
    rows = scored.filter(F.col("entity").isNotNull()).select(
        "entity",
        F.to_date("date").alias("date"),
        _value(scored, weighted).alias("value"),
        F.col("predicted_label").eqNullSafe(F.lit("negative")).alias("is_negative"),
    )
    return rows.groupBy("entity", "date").agg(
        F.count("*").alias("headlines"),
        F.count_if("is_negative").alias("negatives"),
        F.sum("value").alias("value_sum"),
        F.count("value").alias("value_count"),
    )


def merge_rollups(rollups: DataFrame) -> DataFrame:
    """Add up partial rollups of the same (entity, day)."""
    return rollups.groupBy("entity", "date").agg(
        *[
            F.sum(name).alias(name)
            for name in ("headlines", "negatives", "value_sum", "value_count")
        ]
    )


def daily_mean() -> Column:
    """Mean of a rollup row; NULL for a day whose scores are all missing."""
    return F.try_divide("value_sum", "value_count")


def daily_from_rollup(rollup: DataFrame) -> DataFrame:
    return rollup.filter(F.col("date").isNotNull()).select(
        "entity", "date", daily_mean().alias("daily_avg_sentiment")
    )


def daily_sentiment(scored: DataFrame, weighted: bool | None = None) -> DataFrame:
    """Mean (time-weighted when `time_weight` is there) score per entity and day."""
    rows = scored.filter(F.col("entity").isNotNull() & F.col("date").isNotNull())
    return (
        rows.groupBy("entity", F.to_date("date").alias("date"))
        .agg(F.avg(_value(rows, weighted)).alias("daily_avg_sentiment"))
        .select("entity", "date", "daily_avg_sentiment")
    )


def min_history(daily: DataFrame, days: int = CURRENT.min_history_days) -> DataFrame:
    """Keep the series of entities with at least `days` days; input has one row per day."""
    if days <= 1:
        return daily
    count = F.count("*").over(Window.partitionBy("entity"))
    return daily.withColumn("__days", count).filter(F.col("__days") >= days).drop("__days")


def _frame(profile: RiskProfile):
    order = Window.partitionBy("entity").orderBy("date")
    if profile.frame_includes_today:
        return order.rowsBetween(1 - profile.window_rows, 0)
    return order.rowsBetween(-profile.window_rows, -1)


def rolling_columns(
    value: Column, profile: RiskProfile, frame=None
) -> tuple[Column, Column]:
    """Mean and sample deviation over the profile's row frame, NULL below `min_periods` values."""
    frame = _frame(profile) if frame is None else frame
    enough = F.count(value).over(frame) >= profile.min_periods
    return (
        F.when(enough, F.avg(value).over(frame)),
        F.when(enough, F.stddev_samp(value).over(frame)),
    )


def rolling_stats(daily: DataFrame, profile: RiskProfile = CURRENT) -> DataFrame:
    mean, std = rolling_columns(F.col("daily_avg_sentiment"), profile)
    return daily.withColumns({"rolling_mean": mean, "rolling_std": std})


def z_column(profile: RiskProfile) -> Column:
    """Distance from the rolling mean in deviations; a flat window has no z."""
    z = (F.col("daily_avg_sentiment") - F.col("rolling_mean")) / F.nullif(
        F.col("rolling_std"), F.lit(0.0)
    )
    return F.coalesce(z, F.lit(0.0)) if profile.null_z_as_zero else z


def flag_column(profile: RiskProfile) -> Column:
    return F.coalesce(F.abs("z_score") > F.lit(profile.z_threshold), F.lit(False))


def rolling_zscore(daily: DataFrame, profile: RiskProfile = CURRENT) -> DataFrame:
    """Rolling statistics, z-score and anomaly flag of a daily series."""
    stats = rolling_stats(daily, profile).withColumn("z_score", z_column(profile))
    return stats.withColumn("anomaly_flag", flag_column(profile)).select(*TEMPORAL_COLUMNS)


def temporal_risk(
    scored: DataFrame, profile: RiskProfile = CURRENT, weighted: bool | None = None
) -> DataFrame:
    """The full temporal table from scored headlines."""
    if weighted is None and profile.normalised_recency:
        weighted = False
    daily = min_history(daily_sentiment(scored, weighted), profile.min_history_days)
    return rolling_zscore(daily, profile)


def temporal_from_rollup(rollup: DataFrame, profile: RiskProfile = CURRENT) -> DataFrame:
    """The full temporal table from stored sums, without touching the headlines again."""
    return rolling_zscore(
        min_history(daily_from_rollup(rollup), profile.min_history_days), profile
    )


# Band width, smoothing length and trend length of the report charts.
BAND_WIDTH = 1.5
SMOOTHING_POINTS = 5
TREND_POINTS = 5


def sigma_bands(temporal: DataFrame, width: float = BAND_WIDTH) -> DataFrame:
    """Mean plus and minus `width` deviations."""
    reach = F.lit(width) * F.coalesce(F.col("rolling_std"), F.lit(0.0))
    return temporal.withColumns(
        {
            "upper_band": F.col("rolling_mean") + reach,
            "lower_band": F.col("rolling_mean") - reach,
        }
    )


def smoothed(temporal: DataFrame, points: int = SMOOTHING_POINTS) -> DataFrame:
    """Trailing mean over the last `points` days."""
    frame = Window.partitionBy("entity").orderBy("date").rowsBetween(1 - points, 0)
    return temporal.withColumn("smooth", F.avg("daily_avg_sentiment").over(frame))


def entity_trend(temporal: DataFrame, points: int = TREND_POINTS) -> DataFrame:
    """Last minus first of an entity's last `points` days, as Rising, Falling or Stable."""
    latest = Window.partitionBy("entity").orderBy(F.desc("date"))
    last = temporal.withColumn("__n", F.row_number().over(latest)).filter(F.col("__n") <= points)
    ends = last.groupBy("entity").agg(
        F.count("*").alias("points"),
        (
            F.max_by("daily_avg_sentiment", "date") - F.min_by("daily_avg_sentiment", "date")
        ).alias("change"),
    )
    change = F.when(F.col("points") >= 2, F.col("change"))
    return ends.select("entity", "points", change.alias("change")).withColumn(
        "trend", trend_word(F.col("change"))
    )


def anomaly_events(temporal: DataFrame, entities: Sequence[str] | None = None) -> DataFrame:
    """Flagged days, for all or some entities."""
    flagged = temporal.filter(F.col("anomaly_flag"))
    return flagged.filter(F.col("entity").isin(*entities)) if entities else flagged

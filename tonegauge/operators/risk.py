"""Composite risk per entity, and alerts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonegauge.config import CURRENT, LEGACY, EngineConfig, RiskProfile
from tonegauge.functions.buckets import risk_tier
from tonegauge.functions.rounding import fixed_text, round_exact, round_scaled
from tonegauge.functions.weights import exponential_weight
from tonegauge.operators.filters import require_columns
from tonegauge.operators.temporal import (
    daily_mean,
    daily_rollup,
    flag_column,
    rolling_columns,
    z_column,
)

# Sample-size damping of the current score and recency damping of the legacy score.
FULL_CONFIDENCE_ROWS = 25
CONFIDENCE_FLOOR = 0.2
SMALL_SAMPLE_ROWS = 5
SMALL_SAMPLE_FACTOR = 0.5
SCORE_CAP = 100.0
RECENCY_FLOOR = 0.7

ALERT_COLUMNS = ("risk_tier", "composite_risk_score", "total_headlines")


def weighted_mean(
    scored: DataFrame, as_of=None, scale_days: float = LEGACY.recency_scale_days
) -> DataFrame:
    """Per entity: recency-weighted mean score and mean recency weight."""
    weight = exponential_weight(F.col("date"), as_of, scale_days)
    rows = scored.filter(F.col("entity").isNotNull()).withColumn("__w", weight)
    return rows.groupBy("entity").agg(*_weighted_mean_aggregates())


def _weighted_mean_aggregates() -> list[Column]:
    total = F.nullif(F.sum("__w"), F.lit(0.0))
    return [
        (F.sum(F.col("sentiment_score") * F.col("__w")) / total).alias("avg_sentiment"),
        F.avg("__w").alias("mean_recency"),
    ]


def entity_stats(
    scored: DataFrame, profile: RiskProfile = CURRENT, as_of=None, weighted: bool | None = None
) -> DataFrame:
    """Per entity: row count, share of negative labels over all rows, and mean score."""
    rows = scored.filter(F.col("entity").isNotNull())
    negative = F.count_if(F.col("predicted_label").eqNullSafe(F.lit("negative")))
    common = [
        F.count("*").alias("total_headlines"),
        (negative.cast("double") / F.count("*")).alias("negative_share"),
    ]
    if profile.normalised_recency:
        weight = exponential_weight(F.col("date"), as_of, profile.recency_scale_days)
        rows = rows.withColumn("__w", weight)
        return rows.groupBy("entity").agg(*common, *_weighted_mean_aggregates())
    if weighted is None:
        weighted = "time_weight" in scored.columns
    score = F.col("sentiment_score")
    value = score * F.col("time_weight") if weighted else score
    return rows.groupBy("entity").agg(*common, F.avg(value).alias("avg_sentiment"))


def anomaly_counts(temporal: DataFrame) -> DataFrame:
    """Per entity: flagged days and all days."""
    return temporal.groupBy("entity").agg(
        F.count_if("anomaly_flag").alias("anomaly_days"), F.count("*").alias("total_days")
    )


def risk_join(stats: DataFrame, anomalies: DataFrame) -> DataFrame:
    """Entity statistics with their anomaly counts; an entity without a series has 0 of 1 days."""
    joined = stats.join(anomalies, "entity", "left")
    return joined.withColumns(
        {
            "anomaly_days": F.coalesce("anomaly_days", F.lit(0).cast("long")),
            "total_days": F.coalesce("total_days", F.lit(1).cast("long")),
        }
    )


def score_column(profile: RiskProfile) -> Column:
    """Composite score from the columns of `risk_join`."""
    count = F.col("total_headlines")
    average = F.col("avg_sentiment")
    anomaly_share = F.col("anomaly_days") / F.col("total_days")
    if profile.normalised_recency:
        base = (
            F.col("negative_share") * profile.weight_negative
            + ((F.lit(1.0) - average) / 2.0) * profile.weight_sentiment
            + anomaly_share * profile.weight_anomaly
        )
        return base * (RECENCY_FLOOR + (1.0 - RECENCY_FLOOR) * F.col("mean_recency"))
    base = (
        F.col("negative_share") * profile.weight_negative
        + F.greatest(F.lit(0.0), -average) * profile.weight_sentiment
        + anomaly_share * profile.weight_anomaly
    )
    confidence = CONFIDENCE_FLOOR + (1.0 - CONFIDENCE_FLOOR) * F.least(
        count / FULL_CONFIDENCE_ROWS, F.lit(1.0)
    )
    small = F.when(count < SMALL_SAMPLE_ROWS, F.lit(SMALL_SAMPLE_FACTOR)).otherwise(F.lit(1.0))
    return F.least(base * confidence * small, F.lit(SCORE_CAP))


def finish_summary(
    joined: DataFrame, profile: RiskProfile = CURRENT, carried: Sequence[str] = ()
) -> DataFrame:
    """Score, tier (from the unrounded score) and the rounded report columns; `carried` ones stay."""
    scored = joined.withColumn("__score", score_column(profile))
    return scored.select(
        "entity",
        "total_headlines",
        round_scaled(F.col("negative_share"), 3).alias("negative_ratio"),
        round_exact(F.col("avg_sentiment"), 3).alias("avg_sentiment_score"),
        "anomaly_days",
        round_scaled(F.col("__score"), 2).alias("composite_risk_score"),
        risk_tier(F.col("__score"), profile).alias("risk_tier"),
        *carried,
    )


def risk_summary(
    scored: DataFrame,
    temporal: DataFrame,
    profile: RiskProfile = CURRENT,
    as_of=None,
    weighted: bool | None = None,
) -> DataFrame:
    """Composite risk from scored rows and a temporal table that is already there."""
    stats = entity_stats(scored, profile, as_of, weighted)
    return finish_summary(risk_join(stats, anomaly_counts(temporal)), profile)


def summary_from_rollup(
    rollup: DataFrame,
    profile: RiskProfile = CURRENT,
    as_of=None,
    carried: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Composite risk straight from the daily sums; `carried` names more aggregates of an entity's days.

    One shuffle brings an entity's days together; window, flags and totals all use it, so there is
    no second pass over the headlines and no join. Recency weights depend on the day alone, hence
    they are applied to the sums; `as_of` matters only for them.
    """
    series = Window.partitionBy("entity")
    dated = rollup.withColumn(
        "daily_avg_sentiment", F.when(F.col("date").isNotNull(), daily_mean())
    )
    mean, std = rolling_columns(F.col("daily_avg_sentiment"), profile)
    days = F.count("date").over(series)
    flagged = (
        dated.withColumns({"rolling_mean": mean, "rolling_std": std, "__days": days})
        .withColumn("z_score", z_column(profile))
        .withColumn("anomaly_flag", flag_column(profile) & F.col("date").isNotNull())
    )
    kept = F.col("__days") >= profile.min_history_days
    common = [
        F.sum("headlines").alias("total_headlines"),
        (F.sum("negatives").cast("double") / F.sum("headlines")).alias("negative_share"),
        F.count_if(F.col("anomaly_flag") & kept).alias("anomaly_days"),
        F.greatest(
            F.count_if(kept & F.col("date").isNotNull()), F.lit(1).cast("long")
        ).alias("total_days"),
    ]
    if profile.normalised_recency:
        weight = exponential_weight(F.col("date"), as_of, profile.recency_scale_days)
        flagged = flagged.withColumn("__w", weight)
        mass = F.sum(F.col("__w") * F.col("headlines"))
        weighed = F.sum(F.when(F.col("__w").isNotNull(), F.col("headlines")))
        scores = [
            F.try_divide(F.sum(F.col("__w") * F.col("value_sum")), mass).alias("avg_sentiment"),
            F.try_divide(mass, weighed).alias("mean_recency"),
        ]
    else:
        total = F.try_divide(F.sum("value_sum"), F.sum("value_count"))
        scores = [total.alias("avg_sentiment")]
    more = [c.alias(name) for name, c in (carried or {}).items()]
    return finish_summary(flagged.groupBy("entity").agg(*common, *scores, *more), profile, list(carried or {}))


def risk_summary_direct(
    scored: DataFrame, profile: RiskProfile = CURRENT, as_of=None, weighted: bool | None = None
) -> DataFrame:
    """Composite risk from scored rows alone: one scan, one raw shuffle."""
    if profile.normalised_recency:
        weighted = False
    return summary_from_rollup(daily_rollup(scored, weighted), profile, as_of)


def by_risk(summary: DataFrame) -> DataFrame:
    """Highest score first; equal scores by name."""
    return summary.orderBy(F.desc("composite_risk_score"), "entity")


def alerts(summary: DataFrame, config: EngineConfig | None = None) -> DataFrame:
    """High-risk entities above the threshold and with enough headlines, with their alert line."""
    config = config or EngineConfig()
    require_columns(summary, ALERT_COLUMNS)
    chosen = summary.filter(
        (F.col("risk_tier") == "HIGH")
        & (F.col("composite_risk_score") >= config.alert_threshold)
        & (F.col("total_headlines") >= config.alert_min_headlines)
    )
    line = F.concat(
        F.lit("- "),
        "entity",
        F.lit(": score="),
        fixed_text(F.col("composite_risk_score"), 1),
        F.lit("/100 | negative="),
        fixed_text(F.col("negative_ratio") * 100.0, 1),
        F.lit("% | anomaly_days="),
        F.col("anomaly_days").cast("string"),
        F.lit(" | headlines="),
        F.col("total_headlines").cast("string"),
    )
    return chosen.select("entity", "composite_risk_score", line.alias("alert_line"))

"""Report aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonegauge.config import CURRENT, RiskProfile
from tonegauge.functions.buckets import (
    anomaly_amount,
    sentiment_direction,
    sentiment_word,
    tier_colour,
)
from tonegauge.functions.probabilities import CLASS_ORDER
from tonegauge.functions.rounding import fixed_text
from tonegauge.functions.weights import half_life_weight
from tonegauge.operators.risk import summary_from_rollup
from tonegauge.operators.temporal import daily_rollup

DEFAULT_SECTOR = "Financial"


def source_summary(scored: DataFrame, with_score: bool = False) -> DataFrame:
    """Headlines per source, most first; `with_score` counts non-null headlines and adds the mean."""
    rows = scored.filter(F.col("source").isNotNull())
    if with_score:
        return rows.groupBy("source").agg(
            F.count("headline").alias("headlines"),
            F.avg("sentiment_score").alias("avg_sentiment"),
        )
    return (
        rows.groupBy("source")
        .agg(F.count("*").alias("headlines"))
        .orderBy(F.desc("headlines"), "source")
    )


def entity_label_counts(scored: DataFrame) -> DataFrame:
    rows = scored.filter(F.col("entity").isNotNull() & F.col("predicted_label").isNotNull())
    return rows.groupBy("entity", "predicted_label").agg(F.count("*").alias("headlines"))


def entity_label_pivot(scored: DataFrame, labels: Sequence[str] = CLASS_ORDER) -> DataFrame:
    """One column per class, 0 where an entity has none; the class list is given, so no extra job."""
    rows = scored.filter(F.col("entity").isNotNull())
    return rows.groupBy("entity").agg(
        *[
            F.count_if(F.col("predicted_label").eqNullSafe(F.lit(name))).alias(name)
            for name in labels
        ]
    )


def label_counts(df: DataFrame, column: str = "true_label") -> DataFrame:
    """Rows per label, most first."""
    rows = df.filter(F.col(column).isNotNull())
    return (
        rows.groupBy(column).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), column)
    )


def tier_counts(summary: DataFrame) -> DataFrame:
    """Entities per tier with the tier's colour."""
    counts = summary.groupBy("risk_tier").agg(F.count("*").alias("entities"))
    return counts.withColumn("colour", tier_colour(F.col("risk_tier")))


def overview_kpis(scored: DataFrame, temporal: DataFrame, summary: DataFrame) -> DataFrame:
    """One row of headline figures. Each input is reduced to one row, then the rows are merged."""
    parts = [
        scored.agg(
            F.count("*").alias("headlines"),
            F.countDistinct("entity").alias("entities"),
            F.avg("sentiment_score").alias("avg_sentiment"),
        ),
        summary.agg(F.count_if(F.col("risk_tier") == "HIGH").alias("high_risk_entities")),
        temporal.agg(F.count_if("anomaly_flag").alias("anomalies")),
    ]
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part, allowMissingColumns=True)
    names = ("headlines", "entities", "high_risk_entities", "anomalies", "avg_sentiment")
    row = merged.agg(*[F.max(name).alias(name) for name in names])
    return row.withColumn("direction", sentiment_direction(F.col("avg_sentiment")))


def overview_direct(scored: DataFrame, as_of=None, profile: RiskProfile = CURRENT) -> DataFrame:
    """The figures of `overview_kpis` from one scan, over the headlines that have an entity.

    Daily sums serve all grains: days give the series and its flags, an entity's days its risk and tier,
    all entities the one row. Age weights depend on the day, so they are applied to the sums.
    """
    rollup = daily_rollup(scored, weighted=False)
    weight = half_life_weight(F.col("date"), as_of, profile.half_life_days)
    weighed = rollup.withColumns(
        {
            "__sum": F.col("value_sum"),
            "__count": F.col("value_count"),
            "value_sum": F.col("value_sum") * weight,
            "value_count": F.when(weight.isNotNull(), F.col("value_count")).otherwise(F.lit(0).cast("long")),
        }
    )
    entities = summary_from_rollup(weighed, profile, as_of, {"__sums": F.sum("__sum"), "__counts": F.sum("__count")})
    row = entities.agg(
        F.coalesce(F.sum("total_headlines"), F.lit(0).cast("long")).alias("headlines"),
        F.count("*").alias("entities"),
        F.count_if(F.col("risk_tier") == "HIGH").alias("high_risk_entities"),
        F.coalesce(F.sum("anomaly_days"), F.lit(0).cast("long")).alias("anomalies"),
        F.try_divide(F.sum("__sums"), F.sum("__counts")).alias("avg_sentiment"),
    )
    return row.withColumn("direction", sentiment_direction(F.col("avg_sentiment")))


def dataset_profile(articles: DataFrame) -> DataFrame:
    """One row: total, labelled and unlabelled rows, distinct entities and the date range."""
    return articles.agg(
        F.count("*").alias("total_rows"),
        F.count_if(F.col("true_label").isin(*CLASS_ORDER)).alias("labelled_rows"),
        F.count_if(F.col("true_label") == "").alias("unlabelled_rows"),
        F.countDistinct("entity").alias("entities"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
    )


def dataset_profile_groups(articles: DataFrame) -> DataFrame:
    """Row counts by source and by label.

    The rows are counted once per (source, label); the two groupings then work on those counts.
    """
    pairs = articles.groupBy("source", "true_label").agg(F.count("*").alias("n"))
    source, label = F.col("source"), F.col("true_label")
    sets = pairs.groupingSets([[source], [label]], source, label).agg(
        F.sum("n").alias("rows"),
        F.when(F.grouping(source) == 0, F.lit("source")).otherwise(F.lit("label")).alias("kind"),
    )
    value = F.when(F.col("kind") == "source", source).otherwise(label)
    return sets.select("kind", value.alias("value"), "rows").filter(F.col("value").isNotNull())


def distinct_values(df: DataFrame, column: str = "entity") -> DataFrame:
    return df.select(column).filter(F.col(column).isNotNull()).distinct().orderBy(column)


def top_sources(source_table: DataFrame, limit: int = 10) -> DataFrame:
    return source_table.orderBy(F.desc("headlines"), "source").limit(limit)


def top_risk_entities(summary: DataFrame, limit: int = 3) -> DataFrame:
    return summary.orderBy(F.desc("composite_risk_score"), "entity").limit(limit)


def leaderboard(summary: DataFrame, order: str = "highest") -> DataFrame:
    """Summary ordered by `highest` or `lowest` score, or by `name`."""
    keys = {
        "highest": [F.desc("composite_risk_score"), F.asc("entity")],
        "lowest": [F.asc("composite_risk_score"), F.asc("entity")],
        "name": [F.asc("entity")],
    }
    if order not in keys:
        raise ValueError(f"order must be one of {', '.join(keys)}")
    return summary.orderBy(*keys[order])


def entity_profile(
    scored: DataFrame, temporal: DataFrame, summary: DataFrame, entity: str, first_by: str
) -> DataFrame:
    """An entity's summary row with its sector on each of its temporal rows.

    The entity filter reaches all three scans. The sector is the first one in `first_by` order.
    """
    here = F.col("entity") == F.lit(entity)
    row = summary.filter(here)
    if "sector" in scored.columns:
        sector = scored.filter(here).groupBy("entity").agg(
            F.min_by("sector", first_by).alias("sector")
        )
        row = row.join(sector, "entity", "left")
        row = row.withColumn("sector", F.coalesce("sector", F.lit(DEFAULT_SECTOR)))
    else:
        row = row.withColumn("sector", F.lit(DEFAULT_SECTOR))
    return row.join(temporal.filter(here), "entity", "left")


def entity_insight(summary: DataFrame) -> DataFrame:
    """One sentence group per entity, filled from its summary row."""
    tier, share, days = F.col("risk_tier"), F.col("negative_ratio"), F.col("anomaly_days")
    outlook = (
        F.when(
            (tier == "HIGH") & (share > 0.4), "experiencing significant negative pressure"
        )
        .when(tier == "MEDIUM", "showing signs of sentiment recovery")
        .otherwise("maintaining a relatively stable outlook")
    )
    volatility = F.when(
        days > 10, "statistically unusual volatility in news tone"
    ).otherwise("broadly stable news trajectory")
    # The wording of the report sentence.
    text = F.concat(
        "entity",
        F.lit(" is currently classified as "),
        tier,
        F.lit(" RISK with a composite score of "),
        fixed_text(F.col("composite_risk_score"), 1),
        F.lit("/100. Analysis of "),
        F.format_string("%,d", "total_headlines"),
        F.lit(" headlines reveals "),
        fixed_text(share * 100.0, 1),
        F.lit("% negative sentiment — the entity is "),
        outlook,
        F.lit(". The rolling z-score detector flagged "),
        anomaly_amount(days),
        F.lit(" "),
        days.cast("string"),
        F.lit(" anomaly day"),
        F.when(days != 1, "s").otherwise(""),
        F.lit(" over the observation period, indicating "),
        volatility,
        F.lit("."),
    )
    return summary.select(
        "entity", sentiment_word(F.col("avg_sentiment_score")).alias("tone"), text.alias("insight")
    )

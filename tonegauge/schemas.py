"""Declared table and payload schemas; every reader uses one of these instead of inference."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, DataType, StructType


def columns(**types: str | DataType) -> StructType:
    """A schema of nullable columns."""
    schema = StructType()
    for name, kind in types.items():
        schema.add(name, kind)
    return schema


ARTICLES = columns(
    date="date",
    entity="string",
    headline="string",
    true_label="string",
    source="string",
    url="string",
    time_weight="double",
    headline_hash="string",
)
SCORED = columns(
    **{field.name: field.dataType for field in ARTICLES},
    prob_positive="double",
    prob_negative="double",
    prob_neutral="double",
    predicted_label="string",
    confidence="double",
    sentiment_score="double",
)
TEMPORAL = columns(
    date="date",
    daily_avg_sentiment="double",
    rolling_mean="double",
    rolling_std="double",
    z_score="double",
    entity="string",
    anomaly_flag="boolean",
)
RISK_SUMMARY = columns(
    entity="string",
    total_headlines="long",
    negative_ratio="double",
    avg_sentiment_score="double",
    anomaly_days="long",
    composite_risk_score="double",
    risk_tier="string",
)
SOURCE_SUMMARY = columns(source="string", headlines="long")
SEEN_HASHES = columns(hash="string")

TABLES = {
    "news_articles": ARTICLES,
    "scored_headlines": SCORED,
    "temporal_risk": TEMPORAL,
    "risk_summary": RISK_SUMMARY,
    "source_summary": SOURCE_SUMMARY,
    "dedup_cache": SEEN_HASHES,
}

# What the streaming jobs keep between batches.
DAILY_ROLLUP = columns(
    entity="string",
    date="date",
    headlines="long",
    negatives="long",
    value_sum="double",
    value_count="long",
)
ALERTS = columns(entity="string", composite_risk_score="double", alert_line="string")

REQUIRED_HEADLINE_COLUMNS = ("date", "entity", "headline", "true_label", "source")

FEED_ITEM = columns(title="string", pubDate="string", link="string")
# Items stand in a channel, of which there may be several, or beside it.
RSS_PAYLOAD = columns(
    channel=ArrayType(columns(item=ArrayType(FEED_ITEM))), item=ArrayType(FEED_ITEM)
)
NEWS_PAYLOAD = columns(
    status="string",
    message="string",
    articles=ArrayType(
        columns(
            title="string",
            description="string",
            publishedAt="string",
            source=columns(name="string"),
        )
    ),
)

"""Filtered, limited views for readers of the stored tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Largest page per view, and the columns of the drill-down.
MAX_SUMMARY_ROWS = 500
MAX_TEMPORAL_ROWS = 2000
MAX_HEADLINE_ROWS = 1000
DRILLDOWN_COLUMNS = (
    "date",
    "entity",
    "headline",
    "predicted_label",
    "sentiment_score",
    "prob_positive",
    "prob_negative",
    "prob_neutral",
)


def _checked(limit: int, largest: int) -> int:
    if not 1 <= limit <= largest:
        raise ValueError(f"limit must be within 1..{largest}, got {limit}")
    return limit


def _matching(df: DataFrame, column: str, wanted: str | None) -> DataFrame:
    if not wanted:
        return df
    return df.filter(F.lower(F.col(column)) == F.lower(F.lit(wanted)))


def serve_risk_summary(summary: DataFrame, tier: str | None = None, limit: int = 50) -> DataFrame:
    limit = _checked(limit, MAX_SUMMARY_ROWS)
    rows = _matching(summary, "risk_tier", tier)
    return rows.orderBy(F.desc("composite_risk_score"), "entity").limit(limit)


def serve_temporal(temporal: DataFrame, entity: str | None = None, limit: int = 200) -> DataFrame:
    limit = _checked(limit, MAX_TEMPORAL_ROWS)
    return _matching(temporal, "entity", entity).orderBy("entity", "date").limit(limit)


def serve_headlines(
    scored: DataFrame,
    source: str | None = None,
    label: str | None = None,
    limit: int = 100,
    order_by: Sequence[str] = ("date", "headline", "entity"),
) -> DataFrame:
    limit = _checked(limit, MAX_HEADLINE_ROWS)
    rows = _matching(_matching(scored, "source", source), "predicted_label", label)
    return rows.orderBy(*order_by).limit(limit)


def headline_drilldown(
    scored: DataFrame, entities: Sequence[str] = (), labels: Sequence[str] = ("negative",)
) -> DataFrame:
    """Rows of the chosen entities and labels (an empty choice means all), lowest score first."""
    rows = scored
    if entities:
        rows = rows.filter(F.col("entity").isin(*entities))
    if labels:
        rows = rows.filter(F.col("predicted_label").isin(*labels))
    shown = [name for name in DRILLDOWN_COLUMNS if name in scored.columns]
    ties = [name for name in ("entity", "date", "headline") if name in shown]
    return rows.select(*shown).orderBy("sentiment_score", *ties)

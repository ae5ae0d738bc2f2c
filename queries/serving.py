"""Report aggregates and filtered views."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries.base import (
    AS_OF,
    EV,
    DOC,
    ISO,
    R6,
    RISK,
    doc,
    ev,
    ev_weighted,
    iso,
    plain_doc,
    query,
    r6,
    rounded,
    temporal_out,
    TEMPORAL_OUT,
)
from queries.series import (
    BY_MODEL_SQL,
    BY_TYPE_SQL,
    CURRENT_SERIES,
    risk_summary,
    summary_by_model,
    summary_by_type,
    temporal,
)
from tonegauge.functions import buckets as B
from tonegauge.operators import serving as V
from tonegauge.operators import summaries as S

RISK_CTES = f"{CURRENT_SERIES}, {RISK()}"


@query(
    "source_summary",
    f"WITH {EV} SELECT source, count(*) AS headlines FROM ev GROUP BY 1",
)
def _source_summary(spark, sf):
    return S.source_summary(ev(spark, sf))


@query(
    "source_summary_legacy",
    f"""WITH {EV} SELECT source, count(headline) AS headlines,
    {R6('avg(sentiment_score)', 'avg_sentiment')} FROM ev GROUP BY 1""",
)
def _source_summary_legacy(spark, sf):
    return rounded(S.source_summary(ev(spark, sf), with_score=True), "avg_sentiment")


@query(
    "entity_label_counts",
    f"WITH {EV} SELECT entity, predicted_label, count(*) AS headlines FROM ev GROUP BY 1, 2",
)
def _entity_label_counts(spark, sf):
    return S.entity_label_counts(ev(spark, sf))


@query(
    "entity_label_pivot",
    f"""WITH {EV} SELECT entity,
    count(*) FILTER (WHERE predicted_label = 'positive') AS positive,
    count(*) FILTER (WHERE predicted_label = 'negative') AS negative,
    count(*) FILTER (WHERE predicted_label = 'neutral') AS neutral FROM ev GROUP BY 1""",
)
def _entity_label_pivot(spark, sf):
    return S.entity_label_pivot(ev(spark, sf))


@query(
    "tier_counts",
    f"""{BY_MODEL_SQL} SELECT risk_tier, count(*) AS entities,
    CASE risk_tier WHEN 'HIGH' THEN '#ef4444' WHEN 'MEDIUM' THEN '#f59e0b' WHEN 'LOW' THEN '#22c55e'
                   ELSE '#475569' END AS colour
    FROM risk GROUP BY 1""",
)
def _tier_counts(spark, sf):
    return S.tier_counts(summary_by_model(spark, sf))


OVERVIEW_SQL = f"""{RISK_CTES}, k AS (
      SELECT (SELECT count(*) FROM ev) AS headlines, (SELECT count(DISTINCT entity) FROM ev) AS entities,
             (SELECT count(*) FROM risk WHERE risk_tier = 'HIGH') AS high_risk_entities,
             (SELECT count(*) FROM temporal WHERE flag) AS anomalies,
             (SELECT avg(sentiment_score) FROM ev) AS s)
    SELECT headlines, entities, high_risk_entities, anomalies, {R6('s', 'avg_sentiment')},
           CASE WHEN s > 0.05 THEN 'Positive' WHEN s < -0.05 THEN 'Negative' ELSE 'Neutral' END
             AS direction FROM k"""


@query("overview_kpis", OVERVIEW_SQL)
def _overview_kpis(spark, sf):
    return rounded(S.overview_direct(ev(spark, sf), AS_OF), "avg_sentiment")


@query(
    "overview_kpis_three_tables",
    OVERVIEW_SQL,
)
def _overview_kpis_three_tables(spark, sf):
    """The same figures from tables that are there already."""
    kpis = S.overview_kpis(ev(spark, sf), temporal(spark, sf), risk_summary(spark, sf))
    return rounded(kpis, "avg_sentiment")


@query(
    "dataset_profile",
    f"""WITH {DOC} SELECT count(*) AS total_rows,
    count(*) FILTER (WHERE true_label IN ('positive', 'negative', 'neutral')) AS labelled_rows,
    count(*) FILTER (WHERE true_label = '') AS unlabelled_rows,
    count(DISTINCT entity) AS entities, {ISO('min(date)', 'first_date')}, {ISO('max(date)', 'last_date')}
    FROM doc""",
)
def _dataset_profile(spark, sf):
    return rounded(S.dataset_profile(doc(spark, sf)))


@query(
    "dataset_profile_groups",
    f"""WITH {DOC} SELECT 'source' AS kind, source AS value, count(*) AS rows FROM doc GROUP BY 2
    UNION ALL SELECT 'label', true_label, count(*) FROM doc GROUP BY 2""",
)
def _dataset_profile_groups(spark, sf):
    profile = S.dataset_profile_groups(doc(spark, sf))
    return profile


@query("distinct_entities", f"WITH {EV} SELECT DISTINCT entity FROM ev")
def _distinct_entities(spark, sf):
    return S.distinct_values(ev(spark, sf))


@query(
    "label_counts",
    f"WITH {DOC} SELECT true_label, count(*) AS rows FROM doc GROUP BY 1",
)
def _label_counts(spark, sf):
    return S.label_counts(doc(spark, sf))


@query(
    "top_sources",
    f"""WITH {DOC} SELECT source, count(*) AS headlines FROM doc GROUP BY 1
    ORDER BY headlines DESC, source LIMIT 10""",
)
def _top_sources(spark, sf):
    return S.top_sources(S.source_summary(plain_doc(spark, sf)))


@query(
    "top_risk_entities",
    f"{RISK_CTES} SELECT * FROM risk ORDER BY composite_risk_score DESC, entity LIMIT 3",
)
def _top_risk_entities(spark, sf):
    return S.top_risk_entities(risk_summary(spark, sf))


@query(
    "leaderboard",
    f"""{RISK_CTES} SELECT entity, composite_risk_score, risk_tier FROM risk""",
)
def _leaderboard(spark, sf):
    board = S.leaderboard(risk_summary(spark, sf), "lowest")
    return board.select("entity", "composite_risk_score", "risk_tier")


@query(
    "entity_profile",
    f"""{RISK_CTES} SELECT r.*, CAST(s.sector AS VARCHAR) AS sector, {ISO('t.date')},
    {R6('t.d', 'daily_avg_sentiment')}, {R6('t.m', 'rolling_mean')}, {R6('t.sd', 'rolling_std')},
    {R6('t.z', 'z_score')}, t.flag AS anomaly_flag
    FROM risk r LEFT JOIN temporal t ON r.entity = t.entity,
         (SELECT arg_min(sector, event_id) AS sector FROM ev WHERE entity = '7') s
    WHERE r.entity = '7'""",
)
def _entity_profile(spark, sf):
    scored = ev(spark, sf).withColumn("sector", F.col("sector").cast("string"))
    profile = S.entity_profile(
        scored, temporal(spark, sf), risk_summary(spark, sf), "7", "event_id"
    )
    return temporal_out(profile)


INSIGHT = """entity || ' is currently classified as ' || risk_tier || ' RISK with a composite score of '
  || printf('%.1f', composite_risk_score) || '/100. Analysis of ' || format('{:,}', total_headlines)
  || ' headlines reveals ' || printf('%.1f', negative_ratio * 100.0)
  || '% negative sentiment — the entity is '
  || CASE WHEN risk_tier = 'HIGH' AND negative_ratio > 0.4 THEN 'experiencing significant negative pressure'
          WHEN risk_tier = 'MEDIUM' THEN 'showing signs of sentiment recovery'
          ELSE 'maintaining a relatively stable outlook' END
  || '. The rolling z-score detector flagged '
  || CASE WHEN anomaly_days > 20 THEN 'a critical number of' WHEN anomaly_days > 10 THEN 'several'
          ELSE 'a few' END
  || ' ' || anomaly_days || ' anomaly day' || CASE WHEN anomaly_days <> 1 THEN 's' ELSE '' END
  || ' over the observation period, indicating '
  || CASE WHEN anomaly_days > 10 THEN 'statistically unusual volatility in news tone'
          ELSE 'broadly stable news trajectory' END || '.'"""
TONE = """CASE WHEN avg_sentiment_score > 0.05 THEN 'positive'
  WHEN avg_sentiment_score < -0.05 THEN 'negative' ELSE 'neutral' END"""


@query(
    "entity_insight",
    f"{RISK_CTES} SELECT entity, {TONE} AS tone, {INSIGHT} AS insight FROM risk",
)
def _entity_insight(spark, sf):
    return S.entity_insight(risk_summary(spark, sf))


@query(
    "entity_insight_by_type",
    f"{BY_TYPE_SQL} SELECT entity, {TONE} AS tone, {INSIGHT} AS insight FROM risk",
)
def _entity_insight_by_type(spark, sf):
    return S.entity_insight(summary_by_type(spark, sf))


@query(
    "bucketise",
    f"""WITH {EV}, b AS (SELECT event_id, sentiment_score AS s, abs(sentiment_score) AS a, value AS v,
                                CAST(floor(value) AS BIGINT) AS days FROM ev)
    SELECT event_id,
      CASE WHEN s > 0.05 THEN 'positive' WHEN s < -0.05 THEN 'negative' ELSE 'neutral' END AS word,
      CASE WHEN s > 0.02 THEN 'Rising' WHEN s < -0.02 THEN 'Falling' ELSE 'Stable' END AS trend,
      CASE WHEN a > 0.4 THEN 'red' WHEN a > 0.25 THEN 'amber' ELSE 'green' END AS share_colour,
      CASE WHEN v > 40 THEN 'red' WHEN v > 20 THEN 'amber' ELSE 'green' END AS score_colour,
      CASE WHEN days > 20 THEN 'red' WHEN days > 10 THEN 'amber' ELSE 'cyan' END AS days_colour,
      CASE WHEN days > 20 THEN 'a critical number of' WHEN days > 10 THEN 'several' ELSE 'a few' END
        AS days_amount
    FROM b""",
)
def _bucketise(spark, sf):
    score, value = F.col("sentiment_score"), F.col("value")
    days = F.floor(value)
    return ev(spark, sf).select(
        "event_id",
        B.sentiment_word(score).alias("word"),
        B.trend_word(score).alias("trend"),
        B.negative_share_colour(F.abs(score)).alias("share_colour"),
        B.score_colour(value).alias("score_colour"),
        B.anomaly_colour(days).alias("days_colour"),
        B.anomaly_amount(days).alias("days_amount"),
    )


@query(
    "serve_risk_summary",
    f"""{RISK_CTES} SELECT * FROM risk WHERE lower(risk_tier) = 'low'
    ORDER BY composite_risk_score DESC, entity LIMIT 50""",
)
def _serve_risk_summary(spark, sf):
    return V.serve_risk_summary(risk_summary(spark, sf), tier="low")


@query(
    "serve_temporal",
    f"""{CURRENT_SERIES} SELECT {TEMPORAL_OUT} FROM
    (SELECT * FROM temporal ORDER BY entity, date LIMIT 2000)""",
)
def _serve_temporal(spark, sf):
    return temporal_out(V.serve_temporal(temporal(spark, sf), limit=2000))


HEADLINE_OUT = f"event_id, entity, {ISO()}, source, headline, predicted_label"


@query(
    "serve_headlines",
    f"""WITH {EV} SELECT {HEADLINE_OUT}, {R6('sentiment_score', 'sentiment_score')} FROM
    (SELECT * FROM ev WHERE lower(source) = 'purchase' AND lower(predicted_label) = 'positive'
     ORDER BY date, event_id LIMIT 1000)""",
)
def _serve_headlines(spark, sf):
    rows = V.serve_headlines(
        ev(spark, sf), source="PURCHASE", label="Positive", limit=1000, order_by=("date", "event_id")
    )
    return rows.select(
        "event_id",
        "entity",
        iso("date"),
        "source",
        "headline",
        "predicted_label",
        r6("sentiment_score", "sentiment_score"),
    )


@query(
    "headline_drilldown",
    f"""WITH {EV} SELECT {ISO()}, entity, headline, predicted_label,
    {R6('sentiment_score', 'sentiment_score')}, {R6('prob_positive', 'prob_positive')},
    {R6('prob_negative', 'prob_negative')}, {R6('prob_neutral', 'prob_neutral')}
    FROM ev WHERE predicted_label = 'negative'""",
)
def _headline_drilldown(spark, sf):
    view = V.headline_drilldown(ev_weighted(spark, sf))
    return rounded(view, "sentiment_score", "prob_positive", "prob_negative", "prob_neutral")

"""Daily series, windows, entity statistics and composite risk over EV."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries.base import (
    AS_OF,
    DAILY,
    EV,
    ISO,
    LEGACY_RISK,
    LEGACY_ZSCORE,
    R6,
    RISK,
    TEMPORAL_OUT,
    ZSCORE,
    ev,
    ev_by_type,
    ev_weighted,
    iso,
    query,
    r6,
    rounded,
    temporal_out,
)
from tonegauge.config import CURRENT, LEGACY
from tonegauge.functions.weights import exponential_weight, half_life_weight
from tonegauge.operators import risk as R
from tonegauge.operators import temporal as T

LIVE = "live AS (SELECT * FROM ev)"
CURRENT_SERIES = f"WITH {EV}, {DAILY()}, {ZSCORE()}"
LEGACY_SERIES = f"WITH {EV}, {DAILY('sentiment_score')}, {LEGACY_ZSCORE}"


def temporal(spark, sf):
    return T.temporal_risk(ev_weighted(spark, sf))


@query("daily_sentiment", f"WITH {EV}, {DAILY()} SELECT entity, {ISO()}, {R6('d', 'daily_avg_sentiment')} FROM daily")
def _daily(spark, sf):
    return rounded(T.daily_sentiment(ev_weighted(spark, sf)), "daily_avg_sentiment")


@query(
    "daily_sentiment_unweighted",
    f"WITH {EV}, {DAILY('sentiment_score')} SELECT entity, {ISO()}, {R6('d', 'daily_avg_sentiment')} FROM daily",
)
def _daily_unweighted(spark, sf):
    return rounded(T.daily_sentiment(ev(spark, sf)), "daily_avg_sentiment")


@query(
    "min_history",
    f"""WITH {EV}, {DAILY('sentiment_score')},
    kept AS (SELECT entity FROM daily GROUP BY 1 HAVING count(*) >= 25)
    SELECT entity, {ISO()}, {R6('d', 'daily_avg_sentiment')}
    FROM daily WHERE entity IN (SELECT entity FROM kept)""",
)
def _min_history(spark, sf):
    daily = T.daily_sentiment(ev(spark, sf))
    return rounded(T.min_history(daily, 25), "daily_avg_sentiment")


@query(
    "rolling_stats",
    f"""{CURRENT_SERIES} SELECT entity, {ISO()}, {R6('d', 'daily_avg_sentiment')},
    {R6('m', 'rolling_mean')}, {R6('sd', 'rolling_std')} FROM roll""",
)
def _rolling_stats(spark, sf):
    daily = T.min_history(T.daily_sentiment(ev_weighted(spark, sf)))
    return temporal_out(T.rolling_stats(daily))


@query("rolling_zscore", f"{CURRENT_SERIES} SELECT {TEMPORAL_OUT} FROM temporal")
def _rolling_zscore(spark, sf):
    daily = T.min_history(T.daily_sentiment(ev_weighted(spark, sf)))
    return temporal_out(T.rolling_zscore(daily))


@query("rolling_zscore_legacy", f"{LEGACY_SERIES} SELECT {TEMPORAL_OUT} FROM temporal")
def _rolling_zscore_legacy(spark, sf):
    daily = T.daily_sentiment(ev(spark, sf), weighted=False)
    return temporal_out(T.rolling_zscore(daily, LEGACY))


@query("temporal_risk", f"{CURRENT_SERIES} SELECT {TEMPORAL_OUT} FROM temporal")
def _temporal_risk(spark, sf):
    return temporal_out(T.temporal_from_rollup(T.daily_rollup(ev_weighted(spark, sf))))


@query(
    "sigma_bands",
    f"""{CURRENT_SERIES} SELECT entity, {ISO()}, {R6('m + 1.5 * coalesce(sd, 0)', 'upper_band')},
    {R6('m - 1.5 * coalesce(sd, 0)', 'lower_band')} FROM temporal""",
)
def _sigma_bands(spark, sf):
    bands = T.sigma_bands(temporal(spark, sf))
    return bands.select(
        "entity", iso("date"), r6("upper_band", "upper_band"), r6("lower_band", "lower_band")
    )


@query(
    "smooth5",
    f"""{CURRENT_SERIES} SELECT entity, {ISO()}, {R6('avg(d) OVER w', 'smooth')} FROM temporal
    WINDOW w AS (PARTITION BY entity ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""",
)
def _smooth5(spark, sf):
    return T.smoothed(temporal(spark, sf)).select("entity", iso("date"), r6("smooth", "smooth"))


@query(
    "entity_trend",
    f"""{CURRENT_SERIES},
    last5 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY date DESC) AS i
                             FROM temporal) WHERE i <= 5),
    ends AS (SELECT entity, count(*) AS points, arg_max(d, date) - arg_min(d, date) AS change
             FROM last5 GROUP BY 1)
    SELECT entity, points, {R6('change', 'change')},
           CASE WHEN points < 2 THEN 'Stable' WHEN change > 0.02 THEN 'Rising'
                WHEN change < -0.02 THEN 'Falling' ELSE 'Stable' END AS trend FROM ends""",
)
def _entity_trend(spark, sf):
    return rounded(T.entity_trend(temporal(spark, sf)), "change")


@query(
    "anomaly_events",
    f"""{CURRENT_SERIES} SELECT {TEMPORAL_OUT} FROM temporal
    WHERE flag AND entity IN ('1', '2', '3', '5', '8', '13')""",
)
def _anomaly_events(spark, sf):
    chosen = ["1", "2", "3", "5", "8", "13"]
    return temporal_out(T.anomaly_events(temporal(spark, sf), chosen))


@query(
    "time_decay",
    f"WITH {EV} SELECT event_id, {R6('time_weight', 'time_weight')} FROM ev",
)
def _time_decay(spark, sf):
    weight = half_life_weight(F.col("date"), AS_OF)
    return ev(spark, sf).select("event_id", r6(weight, "time_weight"))


@query(
    "recency_weight",
    f"""WITH {EV} SELECT event_id,
    {R6("exp(-date_diff('day', date, DATE '2024-01-31') / CAST(30 AS DOUBLE))", 'recency_weight')} FROM ev""",
)
def _recency_weight(spark, sf):
    weight = exponential_weight(F.col("date"), AS_OF)
    return ev(spark, sf).select("event_id", r6(weight, "recency_weight"))


@query(
    "entity_stats",
    f"""WITH {EV} SELECT entity, count(*) AS total_headlines,
    {R6("CAST(count(*) FILTER (WHERE predicted_label = 'negative') AS DOUBLE) / count(*)", 'negative_share')},
    {R6('avg(sentiment_score * time_weight)', 'avg_sentiment')} FROM ev GROUP BY 1""",
)
def _entity_stats(spark, sf):
    return rounded(R.entity_stats(ev_weighted(spark, sf)), "negative_share", "avg_sentiment")


@query(
    "weighted_mean",
    f"""WITH {EV}, w AS (
      SELECT *, exp(-date_diff('day', date, DATE '2024-01-31') / CAST(30 AS DOUBLE)) AS w FROM ev)
    SELECT entity, {R6('sum(sentiment_score * w) / sum(w)', 'avg_sentiment')},
           {R6('avg(w)', 'mean_recency')} FROM w GROUP BY 1""",
)
def _weighted_mean(spark, sf):
    return rounded(R.weighted_mean(ev(spark, sf), AS_OF), "avg_sentiment", "mean_recency")


@query(
    "anomaly_counts",
    f"""{CURRENT_SERIES} SELECT entity, count(*) FILTER (WHERE flag) AS anomaly_days,
    count(*) AS total_days FROM temporal GROUP BY 1""",
)
def _anomaly_counts(spark, sf):
    return R.anomaly_counts(temporal(spark, sf))


@query(
    "risk_join",
    f"""{CURRENT_SERIES}, {RISK()}
    SELECT r.entity, r.n AS total_headlines, {R6('r.neg', 'negative_share')}, {R6('r.a', 'avg_sentiment')},
           r.hits AS anomaly_days, coalesce(m.total, 1) AS total_days
    FROM raw r LEFT JOIN marks m ON r.entity = m.entity""",
)
def _risk_join(spark, sf):
    scored = ev_weighted(spark, sf)
    joined = R.risk_join(R.entity_stats(scored), R.anomaly_counts(T.temporal_risk(scored)))
    return rounded(joined, "negative_share", "avg_sentiment")


RISK_OUT = "SELECT * FROM risk"


@query("risk_summary", f"{CURRENT_SERIES}, {RISK()} {RISK_OUT}")
def risk_summary(spark, sf):
    return R.by_risk(R.risk_summary_direct(ev_weighted(spark, sf)))


@query("risk_summary_two_tables", f"{CURRENT_SERIES}, {RISK()} {RISK_OUT}")
def _risk_summary_two_tables(spark, sf):
    scored = ev_weighted(spark, sf)
    return R.by_risk(R.risk_summary(scored, T.temporal_risk(scored), CURRENT))


BY_TYPE = DAILY("sentiment_score", "ev", "source")
BY_TYPE_SQL = f"WITH {EV}, {BY_TYPE}, {ZSCORE()}, {RISK('sentiment_score', entity='source')}"
BY_MODEL_SQL = (
    f"WITH {EV}, {BY_TYPE}, {ZSCORE()}, {RISK('sentiment_score', 'model_label', entity='source')}"
)


def summary_by_type(spark, sf):
    return R.risk_summary_direct(ev_by_type(spark, sf))


def summary_by_model(spark, sf):
    scored = ev_by_type(spark, sf).withColumn("predicted_label", F.col("model_label"))
    return R.risk_summary_direct(scored)


@query("risk_summary_by_type", f"{BY_TYPE_SQL} {RISK_OUT}")
def _risk_summary_by_type(spark, sf):
    return R.by_risk(summary_by_type(spark, sf))


@query("risk_summary_by_type_model", f"{BY_MODEL_SQL} {RISK_OUT}")
def _risk_summary_by_type_model(spark, sf):
    return R.by_risk(summary_by_model(spark, sf))


@query("risk_summary_legacy", f"{LEGACY_SERIES}, {LIVE}, {LEGACY_RISK} {RISK_OUT}")
def _risk_summary_legacy(spark, sf):
    return R.by_risk(R.risk_summary_direct(ev(spark, sf), LEGACY, AS_OF))


@query(
    "risk_summary_legacy_two_tables",
    f"{LEGACY_SERIES}, {LIVE}, {LEGACY_RISK} {RISK_OUT}",
)
def _risk_summary_legacy_two_tables(spark, sf):
    scored = ev(spark, sf)
    series = T.temporal_risk(scored, LEGACY)
    return R.by_risk(R.risk_summary(scored, series, LEGACY, AS_OF))


ALERT_LINE = """'- ' || entity || ': score=' || printf('%.1f', composite_risk_score) || '/100 | negative='
  || printf('%.1f', negative_ratio * 100.0) || '% | anomaly_days=' || anomaly_days
  || ' | headlines=' || total_headlines"""


@query(
    "alerts",
    f"""{BY_TYPE_SQL} SELECT entity, composite_risk_score, {ALERT_LINE} AS alert_line FROM risk
    WHERE risk_tier = 'HIGH' AND composite_risk_score >= 35 AND total_headlines >= 5""",
)
def _alerts(spark, sf):
    return R.alerts(summary_by_type(spark, sf))

from __future__ import annotations

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tonegauge.config import CURRENT, LEGACY, EngineConfig
from tonegauge.operators import risk as R
from tonegauge.operators import temporal as T

START = date(2024, 1, 1)


def series(spark, values, entity="e"):
    data = [(entity, START + timedelta(days=i), v) for i, v in enumerate(values)]
    return spark.createDataFrame(data, "entity string, date date, daily_avg_sentiment double")


def zrows(df):
    return [tuple(r) for r in df.orderBy("date").select("rolling_mean", "rolling_std", "z_score", "anomaly_flag").collect()]


def scored(spark, data):
    return spark.createDataFrame(
        data, "entity string, date date, sentiment_score double, predicted_label string"
    )


def test_current_frame_excludes_today(spark):
    out = zrows(T.rolling_zscore(series(spark, [0.0, 0.2, 0.1])))
    assert out[0] == out[1] == (None, None, None, False)
    assert out[2] == (pytest.approx(0.1), pytest.approx(0.141421, abs=1e-6), pytest.approx(0.0), False)


def test_flat_window_has_no_z(spark):
    assert zrows(T.rolling_zscore(series(spark, [0.1, 0.1, 0.9])))[2][1:] == (0.0, None, False)


def test_frame_is_seven_rows(spark):
    out = zrows(T.rolling_zscore(series(spark, [100.0] + [0.0] * 8)))
    assert out[7][0] == pytest.approx(100 / 7) and out[8][0] == 0.0


def test_legacy_frame_includes_today(spark):
    out = zrows(T.rolling_zscore(series(spark, [0.0, 0.2]), LEGACY))
    assert out[0] == (None, None, 0.0, False)
    assert out[1] == (
        pytest.approx(0.1),
        pytest.approx(0.141421, abs=1e-6),
        pytest.approx(0.707107, abs=1e-6),
        False,
    )


# Two published series with their expected z-scores.
GOLDEN = {
    "a": [
        (0.0007564560667118643, None, False),
        (8.606212970615e-05, None, False),
        (0.018226306984877157, 37.56021468883583, True),
        (-0.06774849609596607, -7.2049818773046015, True),
        (0.0009198597781346117, 0.34453905745431745, False),
        (0.00021632634646572045, 0.2922986106158956, False),
    ],
    "b": [
        (4.6494622263755727e-05, None, False),
        (-0.06990408249943617, None, False),
        (0.00034787198427963027, 0.7131998253084502, False),
        (-0.39302726063247856, -9.13831274761935, True),
        (0.2886404471637709, 2.1520214026209996, True),
        (0.1940540059662616, 0.9408519269783305, False),
        (0.2536707341001103, 1.0572675382431327, False),
        (0.0006782140117138, -0.16293334611154853, False),
    ],
}


@pytest.mark.parametrize("name", GOLDEN)
def test_golden_series(spark, name):
    out = zrows(T.rolling_zscore(series(spark, [g[0] for g in GOLDEN[name]])))
    for (_, _, z, flag), (_, expected, expected_flag) in zip(out, GOLDEN[name]):
        assert flag == expected_flag
        assert z is None if expected is None else z == pytest.approx(expected, rel=1e-9)


def test_short_history_is_in_the_summary_but_has_no_series(spark):
    data = [("s", START, -1.0, "negative"), ("s", START + timedelta(1), -1.0, "negative")]
    assert T.temporal_risk(scored(spark, data)).count() == 0
    row = R.risk_summary_direct(scored(spark, data)).first()
    assert (row.total_headlines, row.anomaly_days) == (2, 0)


def test_current_score(spark):
    days = [START + timedelta(days=i) for i in range(4)]
    stats = spark.createDataFrame(
        [("x", 25, 1.0, -1.0), ("y", 4, 1.0, -1.0), ("z", 25, 1.0, -1.0)],
        "entity string, total_headlines bigint, negative_share double, avg_sentiment double",
    )
    marks = spark.createDataFrame([("x", 1, len(days))], "entity string, anomaly_days bigint, total_days bigint")
    out = {r.entity: r for r in R.finish_summary(R.risk_join(stats, marks)).collect()}
    assert (out["x"].composite_risk_score, out["x"].risk_tier) == (81.25, "HIGH")
    assert (out["y"].composite_risk_score, out["y"].risk_tier) == (12.3, "LOW")
    assert (out["z"].composite_risk_score, out["z"].anomaly_days) == (75.0, 0)


def test_legacy_score_of_a_neutral_entity(spark):
    row = R.risk_summary_direct(scored(spark, [("n", START, 0.0, "neutral")]), LEGACY, START).first()
    assert (row.composite_risk_score, row.risk_tier) == (12.5, "LOW")


def varied(spark, n=4000):
    """Many rows, one entity with a third of them, missing scores, labels, dates and entities."""
    base = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 97 == 1, F.lit(None)).otherwise(
            F.concat(F.lit("e"), (F.col("id") % 40).cast("string"))
        ).alias("entity"),
        F.when(F.col("id") % 53 != 0, F.date_add(F.lit(START), (F.col("id") * 7 % 19).cast("int"))).alias("date"),
        F.when(F.col("id") % 31 != 0, F.sin(F.col("id").cast("double"))).alias("sentiment_score"),
        F.element_at(
            F.array(F.lit("negative"), F.lit("positive"), F.lit(None), F.lit("neutral")),
            (F.col("id") % 4 + 1).cast("int"),
        ).alias("predicted_label"),
    )
    return base


@pytest.mark.parametrize("profile", [CURRENT, LEGACY], ids=lambda p: p.name)
def test_one_pass_summary_equals_the_join_of_two_tables(spark, profile):
    data = varied(spark)
    temporal = T.temporal_risk(data, profile)
    joined = R.risk_summary(data, temporal, profile, "2024-01-31")
    direct = R.risk_summary_direct(data, profile, "2024-01-31")
    assert rows(direct) == rows(joined) and direct.count() == 41


@pytest.mark.parametrize("profile", [CURRENT, LEGACY], ids=lambda p: p.name)
def test_series_from_sums_equals_series_from_rows(spark, profile):
    data = varied(spark)
    a = T.temporal_risk(data, profile, weighted=False).orderBy("entity", "date").collect()
    b = T.temporal_from_rollup(T.daily_rollup(data, False), profile).orderBy("entity", "date").collect()
    assert len(a) == len(b) > 100
    for x, y in zip(a, b):
        assert (x.entity, x.date, x.anomaly_flag) == (y.entity, y.date, y.anomaly_flag)
        assert (x.z_score is None) == (y.z_score is None)
        assert x.z_score is None or x.z_score == pytest.approx(y.z_score, rel=1e-6, abs=1e-9)


def test_merged_parts_equal_the_whole(spark):
    data = varied(spark)
    parts = T.daily_rollup(data.filter("date < '2024-01-10' or date is null")).unionByName(
        T.daily_rollup(data.filter("date >= '2024-01-10'"))
    )
    assert rows(T.merge_rollups(parts), "entity", "date", "headlines") == rows(
        T.daily_rollup(data), "entity", "date", "headlines"
    )


def test_tiers_follow_the_score(spark):
    order = {"LOW": 0, "MEDIUM": 1, "HIGH": 2}
    out = R.by_risk(R.risk_summary_direct(varied(spark))).collect()
    assert [order[r.risk_tier] for r in out] == sorted((order[r.risk_tier] for r in out), reverse=True)
    assert all(0 <= r.composite_risk_score <= 100 for r in out)


def summary_rows(spark, data):
    return spark.createDataFrame(
        data,
        "entity string, total_headlines bigint, negative_ratio double, avg_sentiment_score double,"
        " anomaly_days bigint, composite_risk_score double, risk_tier string",
    )


def test_alerts(spark):
    summary = summary_rows(
        spark,
        [
            ("few", 4, 1.0, -1.0, 1, 60.0, "HIGH"),
            ("enough", 5, 0.5, -0.3, 2, 60.55, "HIGH"),
            ("medium", 50, 0.5, -0.3, 2, 59.0, "MEDIUM"),
        ],
    )
    out = R.alerts(summary).collect()
    assert [r.alert_line for r in out] == [
        "- enough: score=60.5/100 | negative=50.0% | anomaly_days=2 | headlines=5"
    ]
    assert R.alerts(summary, EngineConfig(alert_threshold=61.0)).count() == 0
    with pytest.raises(ValueError, match="risk_tier"):
        R.alerts(summary.drop("risk_tier"))


def test_trend_bands_and_smoothing(spark):
    z = T.rolling_zscore(series(spark, [0.0, 0.1, 0.2, 0.1, 0.1, 0.3]))
    trend = T.entity_trend(z).first()
    assert (trend.points, trend.trend) == (5, "Rising") and trend.change == pytest.approx(0.2)
    assert T.entity_trend(T.rolling_zscore(series(spark, [0.5]))).first().trend == "Stable"
    smooth = [r.smooth for r in T.smoothed(z).orderBy("date").collect()]
    assert smooth[0] == 0.0 and smooth[-1] == pytest.approx(0.16)
    bands = T.sigma_bands(z).orderBy("date").collect()
    assert bands[0].upper_band is None
    assert bands[2].upper_band - bands[2].lower_band == pytest.approx(3 * bands[2].rolling_std)

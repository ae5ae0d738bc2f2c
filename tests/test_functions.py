from __future__ import annotations

import hashlib
import random
import re
from datetime import date

import pytest
from pyspark.sql import functions as F

from tonegauge.config import CURRENT, LEGACY, EngineConfig
from tonegauge.functions import buckets, dates, hashing, probabilities, rounding, text, weights


def one(spark, value, expr, kind="string"):
    df = spark.createDataFrame([(value,)], f"c {kind}")
    return df.select(expr(F.col("c"))).first()[0]


def many(spark, values, expr, kind="string"):
    df = spark.createDataFrame(list(enumerate(values)), f"i int, c {kind}")
    found = {r[0]: r[1] for r in df.select("i", expr(F.col("c"))).collect()}
    return [found[i] for i in range(len(values))]


@pytest.mark.parametrize(
    "raw, expected",
    [("\t a \n", "a"), (" x ", "x"), ("\x1cb\x1f", "b"), ("", ""), (" a b ", "a b"), (None, None)],
)
def test_strip_removes_every_kind_of_white_space(spark, raw, expected):
    assert one(spark, raw, text.strip) == expected


@pytest.mark.parametrize(
    "raw, current, loader",
    [
        ("<b>Profit</b>  rises\n fast - Mint", "Profit rises fast", "Profit rises fast"),
        ("Profit rises – The Times 24", "Profit rises", "Profit rises – The Times 24"),
        ("Profit rises - a", "Profit rises - a", "Profit rises - a"),
        ("Q1 - Q2 - Daily News", "Q1", "Q1 - Q2"),
        ("a < b and c", "a < b and c", "a < b and c"),
    ],
)
def test_clean_headline(spark, raw, current, loader):
    assert one(spark, raw, text.clean_headline) == current
    assert one(spark, raw, lambda c: text.clean_headline(c, text.PUBLISHER_SUFFIX_LOADER)) == loader


def test_title_is_split_at_the_last_dash(spark):
    titles = ["a - b - Mint", "no publisher here", "x - "]
    assert many(spark, titles, text.headline_of) == ["a - b", "no publisher here", "x"]
    assert many(spark, titles, text.publisher_of) == ["Mint", "Google News", ""]


def test_fingerprint_text(spark):
    raw = "Q3 profit up 18.5%, café  ₹500 crore"
    assert one(spark, raw, text.fingerprint_text) == "qNUM profit up NUM café NUM crore"
    again = "q4 Profit up 3%; CAFÉ ₹7.25 crore!"
    assert one(spark, raw, hashing.fuzzy_hash) == one(spark, again, hashing.fuzzy_hash)


def test_fuzzy_hash_against_plain_python(spark):
    draw = random.Random(7)
    alphabet = "aÀß9²५ _-–.,!\t ́ि中'’%₹Ⅷ"
    samples = ["".join(draw.choices(alphabet, k=draw.randint(0, 40))) for _ in range(300)]

    def expected(s):
        s = re.sub(r"\d+(\.\d+)?", "NUM", s.strip().lower())
        return hashlib.md5(re.sub(r"\s+", " ", re.sub(r"[^\w\s]", "", s)).encode()).hexdigest()

    assert many(spark, samples, hashing.fuzzy_hash) == [expected(s) for s in samples]


def test_article_hash_ignores_case_space_and_missing_parts(spark):
    df = spark.createDataFrame(
        [(" Big News ", "ACME", date(2024, 1, 2), None), ("big news", "acme ", date(2024, 1, 2), "")],
        "headline string, entity string, date date, source string",
    )
    parts = [F.col(c) for c in ("headline", "entity", "date", "source")]
    hashes = {r[0] for r in df.select(hashing.article_hash(*parts)).collect()}
    assert hashes == {hashlib.md5(b"big news|acme|2024-01-02|").hexdigest()}


def test_headline_hash(spark):
    assert one(spark, " Big News ", hashing.headline_hash) == hashlib.md5(b"big news").hexdigest()


DATES = [
    ("Wed, 17 Jun 2026 07:00:00 GMT", "2026-06-17 07:00:00", date(2026, 6, 17)),
    ("wed, 7 jun 2026 7:00:05", "2026-06-07 07:00:05", date(2026, 6, 7)),
    ("Wed, 17 Jun 2026 07:00:00 +0530", "2026-06-17 01:30:00", date(2026, 6, 17)),
    ("Wed, 17 Jun 2026 23:30:00 -05:00", "2026-06-18 04:30:00", date(2026, 6, 17)),
    ("2026-06-17T07:00:00Z", "2026-06-17 07:00:00", date(2026, 6, 17)),
    ("2026-06-17T07:00:00+02:00", "2026-06-17 05:00:00", date(2026, 6, 17)),
    (" 2026-06-17 ", "2026-06-17 00:00:00", date(2026, 6, 17)),
    ("2026-06-17T07:00:00", None, None),
    ("2026-06-17T07:00:00 +0530", None, None),
    ("Xyz, 17 Jun 2026 07:00:00 GMT", None, None),
    ("Wed, 31 Jun 2026 07:00:00 GMT", None, None),
    ("junk", None, None),
    ("", None, None),
    (None, None, None),
]


def test_feed_dates(spark):
    df = spark.createDataFrame([(i, d[0]) for i, d in enumerate(DATES)], "i int, raw string")
    out = dates.with_feed_dates(df, "raw", instant="instant", day="day")
    assert sorted(out.columns) == ["day", "i", "instant", "raw"]
    stamped = out.withColumn("instant", F.date_format("instant", "yyyy-MM-dd HH:mm:ss"))
    found = {r.i: (r.instant, r.day) for r in stamped.collect()}
    assert [found[i] for i in range(len(DATES))] == [(d[1], d[2]) for d in DATES]
    only_day = dates.with_feed_dates(df, "raw", day="day").orderBy("i").collect()
    assert [r.day for r in only_day] == [d[2] for d in DATES]


def test_age_weights(spark):
    days = [date(2024, 1, 31), date(2024, 1, 28), date(2024, 1, 25), date(2024, 2, 2), None]
    half = many(spark, days, lambda c: weights.half_life_weight(c, "2024-01-31"), "date")
    assert half == [1.0, 0.5, 0.25, 1.0, None]
    decay = many(spark, days, lambda c: weights.exponential_weight(c, "2024-01-31"), "date")
    assert decay[0] == 1.0 and decay[1] == pytest.approx(0.9048374180359595) and decay[3] > 1.0


def test_round_exact_equals_python_round(spark):
    draw = random.Random(3)
    ties = [k / 20 for k in range(-200, 200)] + [k / 2000 for k in range(-300, 300)]
    values = ties + [0.0625, 0.5, 1.5, 2.5, 60.45, 60.55, 0.35] + [draw.uniform(-99, 99) for _ in range(500)]
    for digits in (1, 2, 3, 4):
        found = many(spark, values, lambda c: rounding.round_exact(c, digits), "double")
        assert found == [round(v, digits) + 0.0 for v in values]


def test_fixed_text_equals_python_formatting(spark):
    values = [60.45, 60.55, 0.35, 12.65, 13.05, 100.0, 9.8000000000000007, 0.0]
    found = many(spark, values, lambda c: rounding.fixed_text(c, 1), "double")
    assert found == [f"{v:.1f}" for v in values]


def test_scaled_rounding_is_half_even(spark):
    found = many(spark, [0.0625, 0.0145, 0.5], lambda c: rounding.round_scaled(c, 3), "double")
    assert found == [0.062, 0.014, 0.5]


def test_buckets(spark):
    scores = [0.051, 0.05, -0.05, -0.051, None]
    assert many(spark, scores, buckets.sentiment_word, "double") == [
        "positive",
        "neutral",
        "neutral",
        "negative",
        "neutral",
    ]
    edges = [60.0, 59.99, 30.0, 29.99, 15.0, 15.01, 30.01]
    assert many(spark, edges, lambda c: buckets.risk_tier(c, CURRENT), "double") == [
        "HIGH", "MEDIUM", "MEDIUM", "LOW", "LOW", "LOW", "MEDIUM",
    ]
    assert many(spark, edges, lambda c: buckets.risk_tier(c, LEGACY), "double") == [
        "HIGH", "HIGH", "MEDIUM", "MEDIUM", "LOW", "MEDIUM", "HIGH",
    ]
    assert many(spark, ["HIGH", "odd"], buckets.tier_colour) == ["#ef4444", "#475569"]
    assert many(spark, [21, 20, 11, 10], buckets.anomaly_amount, "int") == [
        "a critical number of", "several", "several", "a few",
    ]


def test_argmax_takes_the_first_of_equal_classes(spark):
    df = spark.createDataFrame([([0.4, 0.4, 0.2],), ([0.1, 0.2, 0.7],), (None,)], "p array<double>")
    found = [r[0] for r in df.select(probabilities.argmax_label(F.col("p"))).collect()]
    assert found == ["positive", "neutral", None]


def test_config_from_environment():
    config = EngineConfig.from_env({"RISK_ALERT_THRESHOLD": "41.5", "REFRESH_INTERVAL_MINUTES": "x"})
    assert config.alert_threshold == 41.5 and config.refresh_interval_minutes == 60

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from tests.conftest import rows
from tonegauge.operators import cleaning as C
from tonegauge.operators import dating as D
from tonegauge.operators import dedup as U
from tonegauge.operators import entities as N
from tonegauge.operators import evaluation as E
from tonegauge.operators import filters as X
from tonegauge.operators import serving as V
from tonegauge.operators import summaries as S
from tonegauge.operators.keyword_join import infer_entity_joined

ARTICLE = "id int, date string, entity string, headline string, true_label string"


def test_clean_articles(spark):
    long = "Quarterly profit rises"
    df = spark.createDataFrame(
        [
            (1, "2024-01-02 08:00:00", " Acme ", f" {long}\n", " Positive"),
            (2, "2024-01-02 08:00:00", "Acme", long, "negative"),
            (3, "2024-01-02 09:00:00", "Acme", long, "bogus"),
            (4, "yesterday", "Acme", long, ""),
            (5, "2024-01-02", "nan", long, ""),
            (6, "2024-01-02", None, long, ""),
            (7, "2024-01-02", "Acme", "too short", ""),
            (8, "2024-01-02", "Acme", None, ""),
            (9, "2024-01-02", "  ", long, None),
            (10, None, "Acme", long, ""),
        ],
        ARTICLE,
    )
    order = [F.col("id")]
    assert rows(C.clean_articles(df, order), "id", "entity", "headline", "true_label", "date") == [
        (1, "Acme", long, "positive", datetime(2024, 1, 2, 8)),
        (3, "Acme", long, "", datetime(2024, 1, 2, 9)),
    ]
    daily = C.clean_articles(df, order, daily=True)
    assert rows(daily, "id", "date") == [(1, date(2024, 1, 2))]
    again = C.clean_articles(daily, order, daily=True)
    assert rows(again) == rows(daily)


def test_clean_whole_rows(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2), (None, 1)], "headline string, n int")
    assert rows(C.clean_whole_rows(df)) == [("a", 1), ("a", 2)]


def test_labels_are_mapped_or_dropped(spark):
    df = spark.createDataFrame([(" 2",), ("1",), ("0",), ("NEUTRAL ",), ("mixed",), (None,)], "raw string")
    assert Counter(r.true_label for r in C.normalise_labels(df, "raw").collect()) == {
        "positive": 1,
        "neutral": 2,
        "negative": 1,
    }


def test_first_per_key_with_a_hot_key(spark):
    df = spark.range(3000).select(
        "id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 500).alias("k")
    )
    first = {}
    for i in range(3000):
        first.setdefault(0 if i % 3 == 0 else i % 500, i)
    found = {r.k: r.id for r in U.first_per_key(df, ["k"], [F.col("id")]).collect()}
    assert found == first
    top = U.top_per_key(df, ["k"], [F.desc("id")], 20).groupBy("k").count().collect()
    counts = Counter(0 if i % 3 == 0 else i % 500 for i in range(3000))
    assert {r.k: r["count"] for r in top} == {k: min(20, n) for k, n in counts.items()}


@pytest.mark.parametrize("anti", [U.only_new, U.only_new_to_history])
def test_only_new_keeps_repeats_of_the_batch(spark, anti):
    new = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3), (None, 4)], "k string, n int")
    old = spark.createDataFrame([("a",), ("a",), ("c",)], "k string")
    assert rows(anti(new, old, ["k"]), "n") == [(2,), (3,), (4,)]
    assert anti(new, new, ["k"]).filter("k is not null").count() == 0


def test_entities_by_keyword(spark):
    texts = ["HDFC and ICICI", "showers in april", "Apple iPhone", "nothing", "Paytm, then Infosys"]
    df = spark.createDataFrame([(t,) for t in texts], "headline string")
    out = {r.headline: r.entity for r in N.infer_entity(df).collect()}
    assert [out[t] for t in texts] == [
        "HDFC Bank", "Reliance Industries", "Apple", "General Market", "Infosys",
    ]
    words = {r.headline: r.entity for r in N.infer_entity(df, word_boundary=True).collect()}
    assert words["showers in april"] == "General Market" and words["HDFC and ICICI"] == "HDFC Bank"


@pytest.mark.parametrize("size", [10, 64, 65, 1_000, 10_000])
def test_dictionaries_of_any_size_give_the_first_rule(spark, size):
    draw = random.Random(size)
    letters = lambda most: "".join(draw.choices("abcd .é*", k=draw.randint(1, most)))
    keywords = {f"E{i}": [letters(3 if size < 100 else 9).strip() or "a"] for i in range(size)}
    texts = sorted({letters(40) for _ in range(60)} | {"", "zzz"})
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "headline string")
    pairs = N.keyword_rules(keywords)
    for bounded in (False, True):
        def holds(word, text):
            return bool(re.search(rf"(?<!\w){re.escape(word)}(?!\w)", text)) if bounded else word in text

        out = N.infer_entity(df, keywords=keywords, default="none", word_boundary=bounded).collect()
        assert len(out) == len(texts) + 1
        for r in out:
            expected = next((e for w, e in pairs if r.headline is not None and holds(w, r.headline)), "none")
            assert r.entity == expected, (r.headline, bounded)


def test_shorter_keywords_inside_longer_ones(spark):
    df = spark.createDataFrame([("tata motors up",), ("tata motorsport",), ("atata",)], "headline string")
    keywords = {"Group": ["tata"], "Cars": ["tata motors", "motors"]}
    got = lambda **more: {r.headline: r.entity for r in N.infer_entity(df, keywords=keywords, default="none", **more).collect()}
    assert set(got().values()) == {"Group"}
    assert got(word_boundary=True) == {"tata motors up": "Group", "tata motorsport": "Group", "atata": "none"}


def test_enrich_only_without_an_entity_column(spark):
    df = spark.createDataFrame([("Zomato grows",), ("nobody",)], "headline string")
    assert rows(N.enrich_entities(df), "entity") == [("Unknown",), ("Zomato",)]
    named = df.withColumn("entity", F.lit("x"))
    assert N.enrich_entities(named) is named
    with pytest.raises(ValueError, match="headline"):
        N.enrich_entities(df.drop("headline"))


def test_spread_dates(spark):
    df = spark.createDataFrame([(30,), (10,), (20,)], "id int")
    assert rows(D.spread_dates(df, [F.col("id")])) == [
        (10, date(2020, 1, 1)),
        (20, date(2021, 12, 31)),
        (30, date(2023, 12, 31)),
    ]
    assert rows(D.spread_dates(df.limit(0), [F.col("id")])) == []
    assert rows(D.spread_dates(df.filter("id = 10"), [F.col("id")])) == [(10, date(2020, 1, 1))]


def test_row_index_over_many_partitions(spark):
    df = spark.range(0, 5000, 1, 16).select((F.col("id") * 7919 % 5003).alias("k"))
    out = D.with_row_index(df, [F.col("k")], "i").orderBy("i").collect()
    assert [r.i for r in out] == list(range(5000))
    assert [r.k for r in out] == sorted(i * 7919 % 5003 for i in range(5000))
    assert {r.i_total for r in out} == {5000}


def test_spread_equals_the_plain_formula(spark):
    n, start = 1777, date(2020, 1, 1)
    out = D.spread_dates(spark.range(n), [F.col("id")]).collect()
    assert {r.id: r.date for r in out} == {
        i: start + timedelta(days=int(i * 1460 / (n - 1))) for i in range(n)
    }


def test_time_weight_is_observed(spark):
    df = spark.createDataFrame([(date(2024, 1, 31),), (date(2024, 1, 28),)], "date date")
    seen = Observation()
    D.with_time_weight(df, "2024-01-31", observation=seen).collect()
    assert seen.get == {"mean_weight": 0.75, "min_weight": 0.5}
    assert D.with_time_weight(df.limit(0)).columns == ["date", "time_weight"]


def test_filters(spark):
    now = datetime(2024, 1, 20, 12)
    ages = [0, 7, 8, -1]
    moments = [now - timedelta(days=a) for a in ages] + [now - timedelta(days=7, hours=23)]
    df = spark.createDataFrame([(m,) for m in moments], "ts timestamp")
    assert X.recent(df, "ts", "2024-01-20 12:00:00").count() == 3
    sources = spark.createDataFrame([("phrasebank",), (None,), ("x",)], "source string")
    assert rows(X.exclude_evaluation_corpus(sources)) == [("x",), (None,)]
    texts = spark.createDataFrame([("é" * 20,), ("é" * 19,), ("[Removed]",)], "headline string")
    assert X.min_text_length(texts).count() == 1
    assert X.min_text_length(texts, at_least=5).count() == 2
    labels = spark.createDataFrame([("positive",), ("",), (None,)], "true_label string")
    assert X.labelled_rows(labels).count() == 1
    with pytest.raises(ValueError, match="only 1 labelled"):
        X.labelled_rows(labels, at_least=50)


def test_split_is_exact_disjoint_and_complete(spark):
    labels = ["positive"] * 667 + ["negative"] * 100 + ["neutral"] * 33
    df = spark.createDataFrame(list(enumerate(labels)), "id int, label string")
    out = E.stratified_split(df, "label", "id").collect()
    assert sorted(r.id for r in out) == list(range(len(labels)))
    held = Counter(r.label for r in out if r.is_holdout)
    assert held == {k: math.ceil(n * 0.15) for k, n in Counter(labels).items()}

    def draw(i):
        return (hashlib.md5(f"42|{i}".encode()).hexdigest(), i)

    for name in held:
        ids = sorted((i for i, x in enumerate(labels) if x == name), key=draw)
        assert {r.id for r in out if r.is_holdout and r.label == name} == set(ids[: held[name]])
    assert E.stratified_split(df, "label", "id", share=1.0).filter("is_holdout").count() == 800


def test_metrics_by_hand(spark):
    pairs = [("positive", "positive")] * 3 + [("positive", "negative")] + [("negative", "negative")] * 2
    pairs += [("neutral", "positive")]
    df = spark.createDataFrame(pairs, "true_label string, predicted_label string")
    report = {r.label: r for r in E.classification_report(df).collect()}
    assert (report["positive"].precision, report["positive"].recall) == (0.75, 0.75)
    assert report["neutral"].f1 == 0.0 and report["neutral"].support == 1
    assert report["negative"].f1 == pytest.approx(0.8)
    assert report["macro avg"].f1 == pytest.approx((0.75 + 0.8 + 0) / 3)
    assert report["weighted avg"].f1 == pytest.approx((0.75 * 4 + 0.8 * 2) / 7)
    assert report["weighted avg"].support == 7
    metrics = E.classification_metrics(df).first()
    assert (metrics.accuracy, metrics.macro_f1) == (0.7143, 0.5167)


def test_profile_and_overview(spark):
    articles = spark.createDataFrame(
        [("a", "s1", "positive", date(2024, 1, 1)), ("b", "s1", "", date(2024, 1, 3)), ("b", None, "", None)],
        "entity string, source string, true_label string, date date",
    )
    row = S.dataset_profile(articles).first()
    assert tuple(row) == (3, 1, 2, 2, date(2024, 1, 1), date(2024, 1, 3))
    groups = rows(S.dataset_profile_groups(articles), "kind", "value", "rows")
    assert groups == [("label", "", 2), ("label", "positive", 1), ("source", "s1", 2)]
    scored = spark.createDataFrame([("a", 0.5), ("b", -0.1)], "entity string, sentiment_score double")
    temporal = spark.createDataFrame([(True,), (False,)], "anomaly_flag boolean")
    summary = spark.createDataFrame([("HIGH",), ("LOW",)], "risk_tier string")
    kpis = S.overview_kpis(scored, temporal, summary).first()
    assert tuple(kpis) == (2, 2, 1, 1, 0.2, "Positive")


def summary_of(spark, data):
    names = "entity string, total_headlines bigint, negative_ratio double, avg_sentiment_score double,"
    names += " anomaly_days bigint, composite_risk_score double, risk_tier string"
    return spark.createDataFrame(data, names)


def test_insight_text(spark):
    summary = summary_of(
        spark,
        [("A", 1234, 0.5, -0.3, 1, 70.25, "HIGH"), ("B", 9, 0.1, 0.2, 21, 35.0, "MEDIUM")],
    )
    out = {r.entity: r for r in S.entity_insight(summary).collect()}
    assert out["A"].tone == "negative" and out["B"].tone == "positive"
    assert out["A"].insight == (
        "A is currently classified as HIGH RISK with a composite score of 70.2/100. Analysis of "
        "1,234 headlines reveals 50.0% negative sentiment — the entity is experiencing significant "
        "negative pressure. The rolling z-score detector flagged a few 1 anomaly day over the "
        "observation period, indicating broadly stable news trajectory."
    )
    assert "a critical number of 21 anomaly days" in out["B"].insight


def test_serving_limits_and_filters(spark):
    summary = summary_of(
        spark, [("A", 1, 0.0, 0.0, 0, 10.0, "LOW"), ("B", 1, 0.0, 0.0, 0, 70.0, "HIGH")]
    )
    assert [r.entity for r in V.serve_risk_summary(summary).collect()] == ["B", "A"]
    assert [r.entity for r in V.serve_risk_summary(summary, tier="low").collect()] == ["A"]
    for bad in (0, 501):
        with pytest.raises(ValueError, match="limit"):
            V.serve_risk_summary(summary, limit=bad)
    assert [r.entity for r in S.leaderboard(summary, "name").collect()] == ["A", "B"]
    with pytest.raises(ValueError, match="order"):
        S.leaderboard(summary, "random")
    scored = spark.createDataFrame(
        [("A", "negative", -0.5), ("B", "negative", -0.9), ("A", "positive", 0.3)],
        "entity string, predicted_label string, sentiment_score double",
    )
    view = V.headline_drilldown(scored)
    assert view.columns == ["entity", "predicted_label", "sentiment_score"]
    assert [r.entity for r in view.collect()] == ["B", "A"]
    assert V.headline_drilldown(scored, ["A"], []).count() == 2


def test_entity_profile_defaults(spark):
    summary = summary_of(spark, [("A", 1, 0.0, 0.0, 0, 10.0, "LOW")])
    temporal = spark.createDataFrame([("A", date(2024, 1, 1))], "entity string, date date")
    scored = spark.createDataFrame([("A", 2, "x"), ("A", 1, "y")], "entity string, id int, sector string")
    assert S.entity_profile(scored, temporal, summary, "A", "id").first().sector == "y"
    plain = S.entity_profile(scored.drop("sector"), temporal, summary, "A", "id").first()
    assert (plain.sector, plain.date) == ("Financial", date(2024, 1, 1))


@pytest.mark.parametrize("word_boundary", [False, True])
def test_keyword_table_equals_looking_for_every_keyword(spark, word_boundary):
    draw = random.Random(4)
    letters = "abcé. "
    texts = [(i, "".join(draw.choices(letters, k=draw.randint(0, 60))).upper()) for i in range(200)] + [(900, None), (901, ""), (902, "x\\E y")]
    words = ["".join(draw.choices(letters, k=draw.randint(1, 9))) for _ in range(150)] + ["", None, "abc", "ABC", "\\e"]
    rules = [(w, f"entity-{at}", at) for at, w in enumerate(words)]
    frame = spark.createDataFrame(texts, "id long, headline string")
    table = spark.createDataFrame(rules, "keyword string, entity string, priority long")
    found = infer_entity_joined(frame, table, "id", default=None, word_boundary=word_boundary)
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
    for r in found.collect():
        text = (r["headline"] or "").lower()

        def holds(word):
            return re.search(rf"(?<!\w){re.escape(word)}(?!\w)", text) if word_boundary else word in text

        expected = next((e for w, e, _ in rules if w and holds(w.lower())), None)
        assert r["entity"] == expected, (text, expected)
    assert infer_entity_joined(frame, table.limit(0), "id", default="d").select("entity").distinct().collect()[0][0] == "d"


def test_keyword_tables_as_one_pattern_and_by_grams_agree(spark, monkeypatch):
    from tonegauge.operators import keyword_join

    words = ["bank", "banker", "ban", "x+y", "a", "interest rate", "österreich", "rate"]
    rules = spark.createDataFrame([(w, f"e{k % 5}", f"p{(k * 5) % 8}") for k, w in enumerate(words)], "keyword string, entity string, priority string")
    texts = [None, "", "BANKER", "banish", "X+Y", "interest  rate", "Österreich", "zzz", "the interest rate of a bank"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, headline string")
    for boundary in (False, True):
        whole = keyword_join.infer_entity_joined(df, rules, "id", word_boundary=boundary)
        # One pass over the rows: no row is dealt by gram.
        assert "Exchange" not in whole._jdf.queryExecution().executedPlan().toString()
        with monkeypatch.context() as m:
            m.setattr(keyword_join, "PATTERN", 3)
            by_grams = keyword_join.infer_entity_joined(df, rules, "id", word_boundary=boundary)
            assert sorted(map(tuple, whole.collect()), key=repr) == sorted(map(tuple, by_grams.collect()), key=repr)


def test_bayes_counts_words_inside_their_row(spark):
    from tonegauge.operators import bayes

    rows = [(0, "good good day", "positive"), (1, "bad day", "negative"), (2, "", "neutral"), (3, None, "neutral")]
    df = spark.createDataFrame(rows, "doc_id int, headline string, true_label string")
    got = df.withColumn("w", F.sort_array(bayes.words_of(F.col("headline")))).select("doc_id", F.inline(bayes.runs("w")))
    assert sorted(map(tuple, got.collect())) == [(0, "day", 1), (0, "good", 2), (1, "bad", 1), (1, "day", 1)]
    model = bayes.train_bayes(df)
    plan = bayes.log_likelihoods(df, model, "doc_id")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [") == 1

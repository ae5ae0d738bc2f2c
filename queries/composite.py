"""Whole runs."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from queries.base import (
    AS_OF,
    DAILY,
    DOC,
    EV,
    ISO,
    LEGACY_RISK,
    LEGACY_ZSCORE,
    PAGE,
    R6,
    RISK,
    STRIP,
    TEMPORAL_OUT,
    ZSCORE,
    doc,
    ev,
    iso,
    page,
    query,
    rounded,
    temporal_out,
)
from queries.feeds import FEED_ARTICLES, ITEMS, NEWS, news_payloads, rss_payloads
from queries.text import CASE_CONTAINS
from tonegauge.operators.entities import ENTITY_KEYWORDS, GENERAL_MARKET, keyword_rules
from tonegauge.operators.maintenance import with_headline_hash
from tonegauge.operators.scoring import score_columns
from tonegauge.plans.dataset import build_dataset, corpus_articles
from tonegauge.plans.journal import RunJournal
from tonegauge.plans.runs import StoredRun, refresh, run_current, run_legacy, run_legacy_stored
from tonegauge.session import run_dir
from tonegauge.sources import feeds as G
from tonegauge.sources.tables import TableStore

# Each event is one headline of its own here; history ends on the 15th and the whole table arrives.
RUN_EVENTS = f"""{EV},
texts AS (SELECT *, source || ' ' || event_id || substr(headline, length(source) + 1) || ' ' AS text
          FROM ev),
run AS (SELECT * EXCLUDE (headline), {STRIP('text')} AS headline FROM texts
        WHERE length({STRIP('text')}) >= 15 OR date <= DATE '2024-01-15')"""
RUN_SERIES = f"WITH {RUN_EVENTS}, {DAILY(source='run')}, {ZSCORE()}"


def run_events(spark, sf):
    rows = ev(spark, sf)
    props = F.substring_index("headline", " ", -2)
    text = F.concat_ws(" ", "source", F.col("event_id").cast("string"), props, F.lit(""))
    return rows.withColumns({"headline": text, "true_label": F.lit("")}).drop(
        "predicted_label",
        "sentiment_score",
        "model_label",
        "sector",
        "prob_positive",
        "prob_negative",
        "prob_neutral",
    )


def score_events(df):
    """Scores an event from its own columns, standing in for a classifier."""
    s = F.when(F.col("source") == "purchase", F.col("value") / (F.col("value") + 25.0)).when(
        F.col("source") == "error", -F.col("value") / (F.col("value") + 25.0)
    ).otherwise(F.lit(0.0))
    probabilities = F.array(
        F.greatest(s, F.lit(0.0)), F.greatest(-s, F.lit(0.0)), F.lit(1.0) - F.abs(s)
    )
    label = (
        F.when(F.col("source") == "purchase", "positive")
        .when(F.col("source") == "error", "negative")
        .otherwise("neutral")
    )
    return score_columns(df, probabilities).withColumn("predicted_label", label)


def _stored_and_incoming(spark, sf):
    rows = run_events(spark, sf)
    return score_events(rows.filter(F.col("date") <= "2024-01-15")), rows




@query("full_run_current", f"{RUN_SERIES}, {RISK(source='run')} SELECT * FROM risk")
def _full_run_current(spark, sf):
    stored, incoming = _stored_and_incoming(spark, sf)
    result = run_current(incoming, stored, score_events, [F.col("event_id")], AS_OF)
    return result.summary


@query("full_run_current_series", f"{RUN_SERIES} SELECT {TEMPORAL_OUT} FROM temporal")
def _full_run_current_series(spark, sf):
    stored, incoming = _stored_and_incoming(spark, sf)
    result = run_current(incoming, stored, score_events, [F.col("event_id")], AS_OF)
    return temporal_out(result.temporal)


@query("full_run_stored", f"{RUN_SERIES}, {RISK(source='run')} SELECT * FROM risk")
def _full_run_stored(spark, sf):
    """The same run against stored tables, written and read back."""
    store = TableStore(spark, run_dir(spark, "store"))
    stored, incoming = _stored_and_incoming(spark, sf)
    store.replace("scored_headlines", with_headline_hash(stored))
    return refresh(store, incoming, score_events, [F.col("event_id")], AS_OF).summary


class Died(RuntimeError):
    """A run that ended in the middle."""


class DyingJournal(RunJournal):
    """Ends the run once, after a step has written its output and before that is noted."""

    def __init__(self, journal: RunJournal):
        super().__init__(journal.spark, journal.path, journal.steps)
        self.fatal: str | None = None

    def enter(self, run, step, mark=""):
        if step == self.fatal:
            raise Died(step)
        return super().enter(run, step, mark)


def repeated(run: StoredRun, incoming) -> None:
    """The run dies at every step in turn and is started again each time; the last start ends it and, as any
    start does, makes a run of its own."""
    journal = DyingJournal(run.journal)
    run = replace(run, journal=journal)
    for journal.fatal in (*run.journal.steps, None):
        try:
            run(incoming)
        except Died:
            pass


@query("full_run_repeated", f"{RUN_SERIES}, {RISK(source='run')} SELECT * FROM risk")
def _full_run_repeated(spark, sf):
    """History up to the 15th is scored; the run over the whole table dies at every step in turn."""
    store = TableStore(spark, run_dir(spark, "store"))
    stored, incoming = _stored_and_incoming(spark, sf)
    store.replace("scored_headlines", with_headline_hash(stored))
    run = StoredRun.of_articles(store, score_events, [F.col("event_id")], as_of=AS_OF)
    repeated(run, incoming)
    return run.result().summary


@query(
    "full_run_feeds",
    f"""WITH {PAGE}, {ITEMS}, {FEED_ARTICLES},
    h AS (SELECT *, md5(lower({STRIP('headline')})) AS score_key, (length(headline) % 10) / 10.0::DOUBLE AS p,
                 pow(CAST(0.5 AS DOUBLE), greatest(date_diff('day', date, DATE '2024-01-31'), 0) / 3.0) AS time_weight
          FROM t),
    run AS (SELECT *, p - (1.0 - p) AS sentiment_score,
                   CASE WHEN p >= 1.0 - p THEN 'positive' ELSE 'negative' END AS predicted_label
            FROM h WHERE j <= 20 OR j <= 40 AND score_key NOT IN (SELECT score_key FROM h WHERE j <= 20)),
    {DAILY(source='run')}, {ZSCORE()}, {RISK(source='run')} SELECT * FROM risk""",
)
def _full_run_feeds(spark, sf):
    """From landed feed payloads to risk. The first run dies at every step in turn; the start that brings it to
    its end goes on with a second run, which finds the first twenty items of each entity seen."""
    store = TableStore(spark, run_dir(spark, "store"))

    def score(df):
        p = (F.char_length("headline") % 10) / F.lit(10.0)
        return score_columns(df, F.array(p, F.lit(1.0) - p, F.lit(0.0)))

    order = [F.col("page_id"), F.col("position")]
    run = StoredRun.of_feeds(store, score, order, "2024-01-31 12:00:00", as_of=AS_OF)
    repeated(run, rss_payloads(spark, sf))
    return run.result().summary


LEGACY_SOURCES = """
live AS (SELECT * EXCLUDE (source), CASE WHEN source = 'view' THEN NULL ELSE source END AS source
         FROM ev WHERE source <> 'signup')"""
LEGACY_RUN = f"WITH {EV}, {LEGACY_SOURCES}, {DAILY('sentiment_score', 'live')}, {LEGACY_ZSCORE}"


def _legacy(spark, sf, store=None):
    """Sign-ups play the evaluation corpus, views have no source."""
    raw = ev(spark, sf).drop("predicted_label", "sentiment_score", "model_label")

    def score(df):
        source = (
            F.when(F.col("source") == "signup", "phrasebank")
            .when(F.col("source") == "view", F.lit(None))
            .otherwise(F.col("source"))
        )
        return score_events(df).withColumn("source", source)

    return run_legacy_stored(store, raw, score, AS_OF) if store else run_legacy(raw, score, AS_OF)


@query("full_run_legacy", f"{LEGACY_RUN}, {LEGACY_RISK} SELECT * FROM risk")
def _full_run_legacy(spark, sf):
    return _legacy(spark, sf).summary


@query(
    "full_run_legacy_sources",
    f"""{LEGACY_RUN} SELECT source, count(headline) AS headlines,
    {R6('avg(sentiment_score)', 'avg_sentiment')} FROM live WHERE source IS NOT NULL GROUP BY 1""",
)
def _full_run_legacy_sources(spark, sf):
    return rounded(_legacy(spark, sf).sources, "avg_sentiment")


@query(
    "build_dataset",
    f"""WITH {DOC}, {PAGE}, {NEWS},
    ranked AS (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM stored),
    corpus AS (
      SELECT DATE '2020-01-01' + CAST((i * 1460) // greatest(n - 1, 1) AS INTEGER) AS date,
             {CASE_CONTAINS('lower(headline)', keyword_rules(ENTITY_KEYWORDS), GENERAL_MARKET)} AS entity,
             headline, true_label, 'phrasebank' AS source, doc_id AS row_id, 0 AS part
      FROM ranked),
    everything AS (
      SELECT date, entity, headline, true_label, source FROM corpus
      UNION ALL SELECT CAST(published AS DATE), entity, title, '', 'google_news' FROM page
      UNION ALL SELECT date, 'News', headline, true_label, source FROM kept_news),
    clean AS (SELECT *, {STRIP('headline')} AS h FROM everything),
    firsts AS (
      SELECT *, row_number() OVER (PARTITION BY h, entity, date ORDER BY source, true_label) AS i
      FROM clean WHERE length(h) >= 15)
    SELECT {ISO()}, entity, md5(h) AS headline_md5, true_label, source FROM firsts WHERE i = 1""",
)
def _build_dataset(spark, sf):
    sentences = doc(spark, sf).select(
        "doc_id", F.col("headline").alias("sentence"), F.col("true_label").alias("label")
    )
    corpus = corpus_articles(sentences, [F.col("doc_id")])
    live = page(spark, sf).select(
        F.to_date("published").alias("date"),
        "entity",
        F.col("title").alias("headline"),
        F.lit("").alias("true_label"),
        F.lit("google_news").alias("source"),
    )
    news = G.parse_news_json(news_payloads(spark, sf), as_of=AS_OF).select(
        "date", F.lit("News").alias("entity"), "headline", "true_label", "source"
    )
    built = build_dataset([corpus, live, news], [F.col("source"), F.col("true_label")])
    return built.select(
        iso("date"), "entity", F.md5("headline").alias("headline_md5"), "true_label", "source"
    )


@query("full_run_legacy_stored", f"{LEGACY_RUN}, {LEGACY_RISK} SELECT * FROM risk")
def _full_run_legacy_stored(spark, sf):
    return _legacy(spark, sf, TableStore(spark, run_dir(spark, "store"))).summary

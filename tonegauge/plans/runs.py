"""The two end-to-end runs: headlines in, series, risk, sources and alerts out."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonegauge.config import LEGACY, EngineConfig
from tonegauge.operators.cleaning import clean_articles
from tonegauge.operators.dedup import only_new
from tonegauge.operators.dating import with_time_weight
from tonegauge.operators.entities import enrich_entities
from tonegauge.operators.filters import exclude_evaluation_corpus
from tonegauge.functions.hashing import headline_hash
from tonegauge.operators.maintenance import HASH, union_sources, with_headline_hash
from tonegauge.operators.risk import alerts, by_risk, summary_from_rollup
from tonegauge.operators.scoring import score_incremental
from tonegauge.operators.summaries import source_summary
from tonegauge.operators.temporal import daily_rollup, temporal_from_rollup
from tonegauge.plans.journal import Run, RunJournal
from tonegauge.session import materialise
from tonegauge.sources.feeds import ingest_feed, parse_rss_payloads
from tonegauge.sources.seen import SeenKeys
from tonegauge.sources.tables import TableStore

Scorer = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class RunResult:
    scored: DataFrame
    temporal: DataFrame
    summary: DataFrame
    sources: DataFrame
    alerts: DataFrame


def analyse(scored: DataFrame, as_of, config: EngineConfig, keep_rollup: bool = False) -> RunResult:
    """Series, risk, sources and alerts of the whole scored history.

    Series and summary both come from the daily sums. With `keep_rollup` those sums, one row per
    entity and day, are written once; otherwise each output recomputes them lazily.
    """
    profile = config.profile
    weighted = with_time_weight(scored, as_of, profile.half_life_days)
    rollup = daily_rollup(weighted, weighted=True)
    if keep_rollup:
        rollup = materialise(rollup, "daily-rollup")
    summary = summary_from_rollup(rollup, profile)
    return RunResult(
        scored=scored,
        temporal=temporal_from_rollup(rollup, profile),
        summary=by_risk(summary),
        sources=source_summary(scored),
        alerts=alerts(summary, config),
    )


def score_new(
    incoming: DataFrame, stored: DataFrame, score: Scorer, order_by: Sequence[Column]
) -> DataFrame:
    """Clean incoming articles and score those whose headline is not stored yet."""
    articles = with_headline_hash(clean_articles(incoming, order_by, daily=True))
    return score_incremental(articles, with_headline_hash(stored), score)


def run_current(
    incoming: DataFrame,
    stored: DataFrame,
    score: Scorer,
    order_by: Sequence[Column],
    as_of=None,
    config: EngineConfig | None = None,
) -> RunResult:
    """One lazy run over incoming articles and the stored scored history."""
    config = config or EngineConfig()
    fresh = score_new(incoming, stored, score, order_by)
    # Fresh keys are new by construction: nothing stored has to be looked up or replaced.
    return analyse(union_sources(stored, fresh), as_of, config)


# Steps of a stored run, in order.
ARRIVED, STORED, SCORED, SERIES, SUMMARY, SOURCES, SEEN = "arrived", "stored", "scored", "series", "summary", "sources", "seen"
SCORE_KEY = "score_key"  # hash of the headline alone, stored with each article
STEPS = (ARRIVED, STORED, SCORED, SERIES, SUMMARY, SOURCES, SEEN)


@dataclass(frozen=True)
class StoredRun:
    """A run against stored tables that may die anywhere and be repeated.

    Each step writes its output whole, under the run's number, before the journal notes it; a later run
    first finishes the one that died, from its own arrivals, then takes what comes in now. `prepare` turns
    incoming rows into articles, given a filter for unseen keys; `seen` remembers what it kept.

    Scores are found to be missing by an anti join of the *stored* articles with the stored scores, so an
    article is scored even if it never comes in again.
    """

    store: TableStore
    journal: RunJournal
    score: Scorer
    prepare: Callable[[DataFrame, Callable[[DataFrame], DataFrame] | None], DataFrame]
    seen: SeenKeys | None = None
    as_of: str | None = None
    config: EngineConfig = EngineConfig()

    @classmethod
    def of_articles(cls, store: TableStore, score: Scorer, order_by: Sequence[Column], **settings) -> StoredRun:
        """A run whose input already has the shape of articles."""
        return cls(store, cls.journal_of(store), score, lambda rows, unseen: clean_articles(rows, order_by, daily=True), **settings)

    @classmethod
    def of_feeds(cls, store: TableStore, score: Scorer, order_by: Sequence[Column], now=None, config: EngineConfig | None = None, **settings) -> StoredRun:
        """A run over landed feed payloads (`entity`, `payload`): parse, keep unseen items, clean."""
        config = config or EngineConfig()

        def prepare(payloads: DataFrame, unseen) -> DataFrame:
            items = ingest_feed(
                parse_rss_payloads(payloads), order_by, now, unseen, config.max_articles_per_entity, config.max_age_days
            )
            return clean_articles(items, [F.col("headline")], daily=True)

        keys = SeenKeys(store.spark, f"{store.root}/seen_keys")
        return cls(store, cls.journal_of(store), score, prepare, keys, config=config, **settings)

    @staticmethod
    def journal_of(store: TableStore) -> RunJournal:
        return RunJournal(store.spark, f"{store.root}/runs", STEPS)

    def __call__(self, incoming: DataFrame) -> RunResult:
        run = self.journal.current()
        if ARRIVED in run.done:
            self.finish(run)
            run = self.journal.current()
        arrived = self._arrived(run)
        run = self.journal.step(run, ARRIVED, lambda: self._arrive(run.number, incoming, arrived))
        self.finish(run)
        return self.result()

    def _arrived(self, run: Run) -> str:
        return f"{self.store.root}/arrived/run={run.number}"

    def _arrive(self, number: int, incoming: DataFrame, path: str) -> str:
        unseen = None
        if self.seen is not None:
            unseen = lambda rows: self.seen.only_new(materialise(rows, "items"), before=number)
        articles = self.prepare(incoming, unseen)
        materialise(articles.withColumn(SCORE_KEY, headline_hash(F.col("headline"))), "arrived", path)
        return path

    def finish(self, run: Run) -> Run:
        """All steps that the run has not done."""
        store, part = self.store, f"run-{run.number}"
        arrived = store.spark.read.parquet(run.done[ARRIVED])
        profile = self.config.profile

        def scored() -> None:
            # Both sides bring the key that was stored with them; no text is hashed again. Each is read and shuffled once.
            articles = store.read("news_articles").drop(HASH).withColumnRenamed(SCORE_KEY, HASH)
            missing = only_new(articles.filter(F.col(HASH).isNotNull()), self._scores_before(part), [HASH])
            store.append("scored_headlines", self.score(missing), part)

        def rollup() -> DataFrame:
            weighted = with_time_weight(store.read("scored_headlines"), self.as_of, profile.half_life_days)
            return daily_rollup(weighted, weighted=True)

        def series() -> str:
            sums = materialise(rollup(), "daily-rollup", f"{store.root}/rollups/run={run.number}")
            store.replace("temporal_risk", temporal_from_rollup(sums, profile))
            return f"{store.root}/rollups/run={run.number}"

        def seen() -> None:
            if self.seen is not None:
                self.seen.add(arrived.select("hash").distinct(), run.number)

        step = self.journal.step
        run = step(run, STORED, lambda: str(store.insert_articles(arrived.drop("hash"), part=part)))
        run = step(run, SCORED, scored)
        run = step(run, SERIES, series)
        sums = store.spark.read.parquet(run.done[SERIES])
        run = step(run, SUMMARY, lambda: str(store.replace("risk_summary", summary_from_rollup(sums, profile))))
        run = step(run, SOURCES, lambda: str(store.replace("source_summary", source_summary(store.read("scored_headlines")))))
        run = step(run, SEEN, seen)
        for name in ("temporal_risk", "risk_summary", "source_summary"):
            store.retire(name)
        return run

    def _scores_before(self, part: str) -> DataFrame:
        """Stored scores but for those of an attempt at the same run."""
        scores = self.store.read("scored_headlines", without=part)
        return scores if HASH in scores.columns else with_headline_hash(scores)

    def result(self) -> RunResult:
        """The stored tables."""
        store, summary = self.store, self.store.read("risk_summary")
        return RunResult(
            scored=store.read("scored_headlines"),
            temporal=store.read("temporal_risk"),
            summary=by_risk(summary),
            sources=store.read("source_summary").orderBy(F.desc("headlines"), "source"),
            alerts=alerts(summary, self.config),
        )


def refresh(
    store: TableStore,
    incoming: DataFrame,
    score: Scorer,
    order_by: Sequence[Column],
    as_of=None,
    config: EngineConfig | None = None,
) -> RunResult:
    """One run of articles against stored tables. Every table is written once and later steps read it
    back, so the model runs once per new headline and a lost executor costs one stage only.

    For history too long to be summed up again on every run use `tonegauge.streaming.jobs.RefreshStream`.
    """
    return StoredRun.of_articles(store, score, order_by, as_of=as_of, config=config or EngineConfig())(incoming)


def run_legacy(raw: DataFrame, score: Scorer, as_of=None) -> RunResult:
    """The older run, lazy: no incremental state, nothing saved."""
    return analyse_legacy(score(enrich_entities(raw)), as_of)


def analyse_legacy(scored: DataFrame, as_of=None) -> RunResult:
    """Series, risk, sources and alerts by the legacy profile, the evaluation corpus left out."""
    live = exclude_evaluation_corpus(scored)
    rollup = daily_rollup(live, weighted=False)
    summary = summary_from_rollup(rollup, LEGACY, as_of)
    return RunResult(
        scored=scored,
        temporal=temporal_from_rollup(rollup, LEGACY),
        summary=by_risk(summary),
        sources=source_summary(live, with_score=True),
        alerts=alerts(summary),
    )


def run_legacy_stored(store: TableStore, raw: DataFrame, score: Scorer, as_of=None) -> RunResult:
    """The older run with its four tables saved; the model runs once and the outputs read its rows."""
    store.replace("scored_headlines", score(enrich_entities(raw)))
    scored = store.read("scored_headlines")
    result = analyse_legacy(scored, as_of)
    store.replace("temporal_risk", result.temporal)
    store.replace("risk_summary", result.summary)
    store.replace("source_summary", result.sources)
    summary = store.read("risk_summary")
    return RunResult(
        scored=scored,
        temporal=store.read("temporal_risk"),
        summary=by_risk(summary),
        sources=store.read("source_summary"),
        alerts=alerts(summary),
    )

"""Table merges and stored tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries.base import (
    DOC,
    EV,
    ISO,
    PAGE,
    R6,
    STRIP,
    conv,
    doc,
    ev,
    iso,
    labelled_doc,
    page,
    plain_doc,
    query,
    r6,
)
from queries.text import HASHED
from tonegauge.functions.hashing import headline_hash
from tonegauge.operators import maintenance as M
from tonegauge.schemas import columns
from tonegauge.session import materialise, run_dir
from tonegauge.sources.keyed import KeyedTable
from tonegauge.sources.seen import SeenKeys
from tonegauge.sources.tables import TableStore

ARTICLE_KEY = HASHED(
    STRIP("headline"), STRIP("entity"), "strftime(date, '%Y-%m-%d')", STRIP("source")
)


@query(
    "insert_if_absent",
    f"""WITH {DOC}, k AS (SELECT *, {ARTICLE_KEY} AS headline_hash FROM doc),
    s AS (SELECT *, {ARTICLE_KEY} AS headline_hash FROM stored)
    SELECT doc_id, headline_hash, entity, source, 'stored' AS origin FROM s
    UNION ALL SELECT doc_id, headline_hash, entity, source, 'incoming' FROM k
    WHERE headline_hash NOT IN (SELECT headline_hash FROM s)""",
)
def _insert_if_absent(spark, sf):
    stored = labelled_doc(spark, sf).withColumn("origin", F.lit("stored"))
    incoming = doc(spark, sf).withColumn("origin", F.lit("incoming"))
    merged = M.insert_if_absent(stored, incoming)
    return merged.select("doc_id", "headline_hash", "entity", "source", "origin")


@query(
    "upsert_by_key",
    f"""WITH {EV}, s AS (SELECT *, md5(lower(headline)) AS h FROM ev),
    i AS (SELECT *, md5(lower(headline)) AS h FROM ev WHERE source IN ('error', 'purchase'))
    SELECT event_id, h AS headline_hash, {R6('sentiment_score', 'sentiment_score')}, 'stored' AS origin FROM s
    WHERE h NOT IN (SELECT h FROM i)
    UNION ALL SELECT event_id, h, {R6('sentiment_score * 2', 'sentiment_score')}, 'incoming' FROM i""",
)
def _upsert_by_key(spark, sf):
    """The whole table as history; re-scored errors and purchases replace theirs."""
    rows = M.with_headline_hash(ev(spark, sf)).select(
        "event_id", "headline_hash", "sentiment_score", "date", "source"
    )
    stored = rows.withColumn("origin", F.lit("stored"))
    incoming = rows.filter(F.col("source").isin("error", "purchase")).withColumns(
        {"sentiment_score": F.col("sentiment_score") * 2, "origin": F.lit("incoming")}
    )
    merged = M.upsert_by_key(stored, incoming)
    return merged.select(
        "event_id", "headline_hash", r6("sentiment_score", "sentiment_score"), "origin"
    )


@query(
    "seen_hashes_merge",
    f"WITH {DOC} SELECT DISTINCT {HASHED(STRIP('headline'))} AS hash FROM doc",
)
def _seen_hashes_merge(spark, sf):
    key = headline_hash(F.col("headline")).alias("hash")
    seen = labelled_doc(spark, sf).select(key).distinct()
    return M.merge_seen(seen, plain_doc(spark, sf).select(key))


@query(
    "append_refresh",
    f"""WITH {DOC}, u AS (
      SELECT *, 0 AS batch FROM stored UNION ALL SELECT *, 1 FROM doc),
    c AS (SELECT *, {STRIP('headline')} AS h FROM u),
    r AS (SELECT *, row_number() OVER (PARTITION BY h, entity, date ORDER BY batch, doc_id) AS i FROM c
          WHERE length(h) >= 15)
    SELECT doc_id, batch, {ISO()}, entity, true_label FROM r WHERE i = 1""",
)
def _append_refresh(spark, sf):
    stored = labelled_doc(spark, sf).withColumn("batch", F.lit(0))
    incoming = doc(spark, sf).withColumn("batch", F.lit(1))
    merged = M.append_refresh(stored, incoming, [F.col("batch"), F.col("doc_id")])
    return merged.select("doc_id", "batch", iso("date"), "entity", "true_label")


@query(
    "union_sources",
    f"""WITH {DOC}, {PAGE} SELECT entity, source, CAST(NULL AS VARCHAR) AS url FROM doc
    UNION ALL SELECT entity, 'google_news', url FROM page
    UNION ALL SELECT NULL, role, NULL FROM conversations""",
)
def _union_sources(spark, sf):
    live = page(spark, sf).select("entity", F.lit("google_news").alias("source"), "url")
    turns = conv(spark, sf).select(F.col("role").alias("source"))
    return M.union_sources(plain_doc(spark, sf).select("entity", "source"), live, turns)


def _scored(spark, sf):
    return ev(spark, sf).select(
        "date",
        F.col("source").alias("entity"),
        "headline",
        "predicted_label",
        "sentiment_score",
    )


@query(
    "read_by_entity",
    f"""WITH {EV} SELECT {ISO()}, headline, predicted_label, {R6('sentiment_score', 'sentiment_score')}
    FROM ev WHERE source = 'error'""",
)
def _read_by_entity(spark, sf):
    store = TableStore(spark, run_dir(spark, "store"))
    store.replace("scored_headlines", _scored(spark, sf), sort_by="entity")
    rows = store.read("scored_headlines", entity="error")
    return rows.select(
        iso("date"), "headline", "predicted_label", r6("sentiment_score", "sentiment_score")
    )


@query(
    "replace_table",
    f"""WITH {EV} SELECT {ISO()}, source AS entity, headline, predicted_label,
    {R6('sentiment_score', 'sentiment_score')} FROM ev""",
)
def _replace_table(spark, sf):
    """A history table is replaced by the whole table; a later empty input changes nothing."""
    store = TableStore(spark, run_dir(spark, "store"))
    scored = _scored(spark, sf)
    store.replace("scored_headlines", scored.filter(F.col("date") <= "2024-01-15"))
    store.replace("scored_headlines", scored)
    store.replace("scored_headlines", scored.limit(0))
    rows = store.read("scored_headlines")
    return rows.select(
        iso("date"),
        "entity",
        "headline",
        "predicted_label",
        r6("sentiment_score", "sentiment_score"),
    )


@query(
    "storage_health",
    f"""WITH {DOC}, {EV}, a AS (SELECT count(*) AS rows FROM stored),
    k AS (SELECT DISTINCT {ARTICLE_KEY} AS h FROM stored),
    b AS (SELECT count(*) AS rows FROM doc WHERE {ARTICLE_KEY} NOT IN (SELECT h FROM k))
    SELECT 'news_articles' AS "table", a.rows + b.rows AS rows FROM a, b
    UNION ALL SELECT 'scored_headlines', count(*) FROM ev
    UNION ALL SELECT 'temporal_risk', 0 UNION ALL SELECT 'risk_summary', 0
    UNION ALL SELECT 'source_summary', 0
    UNION ALL SELECT 'dedup_cache', count(DISTINCT {HASHED(STRIP('headline'))}) FROM doc""",
)
def _storage_health(spark, sf):
    store = TableStore(spark, run_dir(spark, "store"))
    store.insert_articles(labelled_doc(spark, sf))
    store.insert_articles(doc(spark, sf))
    store.replace("scored_headlines", _scored(spark, sf))
    keys = plain_doc(spark, sf).select(headline_hash(F.col("headline")).alias("hash")).distinct()
    store.replace("dedup_cache", keys)
    return store.health()


@query(
    "upsert_keyed_folders",
    f"""WITH {EV}, s AS (SELECT *, md5(lower(headline)) AS h FROM ev),
    i AS (SELECT *, md5(lower(headline)) AS h FROM ev WHERE source IN ('error', 'purchase'))
    SELECT event_id, h AS headline_hash, {R6('sentiment_score', 'sentiment_score')}, 'stored' AS origin FROM s
    WHERE h NOT IN (SELECT h FROM i)
    UNION ALL SELECT event_id, h, {R6('sentiment_score * 2', 'sentiment_score')}, 'incoming' FROM i""",
)
def _upsert_keyed_folders(spark, sf):
    """The upsert of `upsert_by_key` against a stored table whose folders are chosen by key hash."""
    rows = M.with_headline_hash(ev(spark, sf)).select("event_id", "headline_hash", "sentiment_score", "source")
    kept = columns(event_id="long", headline_hash="string", sentiment_score="double", origin="string")
    table = KeyedTable(spark, run_dir(spark, "keyed"), kept, ["headline_hash"], 16)
    table.upsert(rows.withColumn("origin", F.lit("stored")))
    again = rows.filter(F.col("source").isin("error", "purchase")).withColumn("sentiment_score", F.col("sentiment_score") * 2)
    table.upsert(again.withColumn("origin", F.lit("incoming")))
    return table.read().withColumn("sentiment_score", r6("sentiment_score", "sentiment_score"))


@query(
    "seen_keys_new",
    f"""WITH {DOC} SELECT DISTINCT {HASHED('headline')} AS hash FROM doc
    WHERE {HASHED('headline')} NOT IN (SELECT {HASHED('headline')} FROM stored)""",
)
def _seen_keys_new(spark, sf):
    """Document keys that are new to a stored table of the labelled documents' keys."""
    key = F.md5(F.lower("headline")).alias("hash")
    seen = SeenKeys(spark, run_dir(spark, "seen"))
    seen.add(labelled_doc(spark, sf).select(key).distinct(), 0)
    return seen.only_new(materialise(plain_doc(spark, sf).select(key).distinct(), "keys"))

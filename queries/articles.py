"""Cleaning and filtering of articles."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries.base import DOC, EV, ISO, STRIP, doc, ev, iso, query, table
from tonegauge.operators import cleaning as C
from tonegauge.operators import filters as X

# Articles as they arrive: padded text, loose labels, dates as text and some of them unreadable.
RAW = f"""
raw AS (
  SELECT doc_id, chr(9) || ' ' || headline || ' ' || chr(10) AS headline, entity || ' ' AS entity,
         CASE true_label WHEN 'positive' THEN ' Positive' WHEN '' THEN 'n/a' ELSE true_label END
           AS true_label,
         CASE WHEN source = 'src3' THEN NULL
              ELSE CAST(date AS TIMESTAMP) + to_hours(CAST(doc_id % 24 AS INTEGER)) END AS date,
         source
  FROM doc
),
usable AS (
  SELECT doc_id, {STRIP('headline')} AS headline, {STRIP('entity')} AS entity,
         CASE WHEN lower({STRIP('true_label')}) IN ('positive', 'negative', 'neutral')
              THEN lower({STRIP('true_label')}) ELSE '' END AS true_label, date, source
  FROM raw
  WHERE date IS NOT NULL AND length({STRIP('headline')}) >= 15
)"""


def raw_articles(spark, sf):
    label = F.col("true_label")
    moment = F.col("date").cast("timestamp") + F.make_dt_interval(
        F.lit(0), (F.col("doc_id") % 24).cast("int")
    )
    return doc(spark, sf).select(
        "doc_id",
        F.concat(F.lit("\t "), "headline", F.lit(" \n")).alias("headline"),
        F.concat("entity", F.lit(" ")).alias("entity"),
        F.when(label == "positive", " Positive")
        .when(label == "", "n/a")
        .otherwise(label)
        .alias("true_label"),
        F.when(F.col("source") == "src3", "no date")
        .otherwise(F.date_format(moment, "yyyy-MM-dd HH:mm:ss"))
        .alias("date"),
        "source",
    )


OUT = "doc_id, md5(headline) AS headline_md5, entity, true_label, source"


def out(df, pattern="yyyy-MM-dd"):
    return df.select(
        "doc_id",
        F.md5("headline").alias("headline_md5"),
        "entity",
        "true_label",
        "source",
        F.date_format("date", pattern).alias("date"),
    )


@query(
    "clean_articles",
    f"""WITH {DOC}, {RAW}
    SELECT {OUT}, strftime(date, '%Y-%m-%d %H:%M:%S') AS date FROM
    (SELECT *, row_number() OVER (PARTITION BY headline, entity, date ORDER BY doc_id) AS i FROM usable)
    WHERE i = 1""",
)
def _clean_articles(spark, sf):
    cleaned = C.clean_articles(raw_articles(spark, sf), [F.col("doc_id")])
    return out(cleaned, "yyyy-MM-dd HH:mm:ss")


@query(
    "clean_articles_daily",
    f"""WITH {DOC}, {RAW}
    SELECT {OUT}, strftime(date, '%Y-%m-%d') AS date FROM
    (SELECT *, row_number() OVER (PARTITION BY headline, entity, CAST(date AS DATE) ORDER BY doc_id) AS i
     FROM usable) WHERE i = 1""",
)
def _clean_articles_daily(spark, sf):
    return out(C.clean_articles(raw_articles(spark, sf), [F.col("doc_id")], daily=True))


@query(
    "clean_legacy",
    f"""WITH {DOC} SELECT DISTINCT md5(headline) AS headline_md5, {ISO()}, entity, true_label, source
    FROM doc WHERE headline IS NOT NULL""",
)
def _clean_legacy(spark, sf):
    cleaned = C.clean_whole_rows(doc(spark, sf).drop("doc_id"))
    return cleaned.select(
        F.md5("headline").alias("headline_md5"), iso("date"), "entity", "true_label", "source"
    )


@query(
    "normalise_labels",
    """SELECT doc_id, CASE WHEN toxic = 1 THEN 'negative' WHEN quality = 1 THEN 'positive' ELSE 'neutral' END
    AS true_label FROM labels WHERE NOT (toxic = 1 AND quality = 1)""",
)
def _normalise_labels(spark, sf):
    both = (F.col("toxic") == 1) & (F.col("quality") == 1)
    raw = (
        F.when(both, "mixed")
        .when(F.col("toxic") == 1, "0 ")
        .when(F.col("quality") == 1, " POSITIVE")
        .otherwise("1")
    )
    rows = table(spark, sf, "labels").select("doc_id", raw.alias("raw"))
    return C.normalise_labels(rows, "raw").select("doc_id", "true_label")


@query(
    "filter_min_length",
    "SELECT doc_id FROM documents WHERE length(text) >= 20 AND lower(text) <> '[removed]'",
)
def _filter_min_length(spark, sf):
    return X.min_text_length(table(spark, sf, "documents"), "text").select("doc_id")


@query(
    "filter_recent",
    """SELECT event_id FROM events
    WHERE floor((epoch(TIMESTAMP '2024-01-20 12:00:00') - epoch(ts)) / 86400) BETWEEN 0 AND 7""",
)
def _filter_recent(spark, sf):
    return X.recent(ev(spark, sf), "ts", "2024-01-20 12:00:00").select("event_id")


@query(
    "filter_live",
    f"""WITH {EV} SELECT event_id, CASE WHEN source = 'view' THEN NULL ELSE source END AS source
    FROM ev WHERE source <> 'signup'""",
)
def _filter_live(spark, sf):
    source = (
        F.when(F.col("source") == "signup", "phrasebank")
        .when(F.col("source") == "view", F.lit(None))
        .otherwise(F.col("source"))
    )
    rows = ev(spark, sf).select("event_id", source.alias("source"))
    return X.exclude_evaluation_corpus(rows)


@query("labelled_rows", f"WITH {DOC} SELECT doc_id, true_label FROM stored")
def _labelled_rows(spark, sf):
    return X.labelled_rows(doc(spark, sf), at_least=X.MIN_LABELLED_ROWS).select(
        "doc_id", "true_label"
    )

"""Text, date, hash and entity functions over DOC, PAGE, CONV and EV."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries.base import (
    CLEAN,
    DOC,
    EV,
    ISO,
    PAGE,
    STRIP,
    WS_CLASS,
    COLLAPSE,
    ev,
    iso,
    labelled_doc,
    page,
    plain_doc,
    query,
    table,
)
from tonegauge.functions import hashing as H
from tonegauge.functions.dates import with_feed_dates
from tonegauge.functions.text import (
    PUBLISHER_SUFFIX_LOADER,
    clean_headline,
    headline_of,
    publisher_of,
)
from tonegauge.operators.dating import spread_dates
from tonegauge.operators.dedup import first_per_key, only_new, top_per_key
from tonegauge.operators.entities import (
    ENTITY_KEYWORDS,
    GENERAL_MARKET,
    enrich_entities,
    infer_entity,
    keyword_rules,
)
from tonegauge.operators.keyword_join import infer_entity_joined
from tonegauge.session import balanced


@query(
    "clean_headline",
    f"""SELECT page_id, md5({CLEAN('html')}) AS page_md5, length({CLEAN('html')}) AS page_length,
    md5({CLEAN("html || ' - Example Times'", loader=True)}) AS loader_md5 FROM pages""",
)
def _clean_headline(spark, sf):
    html = F.col("html")
    cleaned = clean_headline(html)
    suffixed = clean_headline(F.concat(html, F.lit(" - Example Times")), PUBLISHER_SUFFIX_LOADER)
    return balanced(table(spark, sf, "pages")).select(
        "page_id",
        F.md5(cleaned).alias("page_md5"),
        F.char_length(cleaned).cast("long").alias("page_length"),
        F.md5(suffixed).alias("loader_md5"),
    )


@query(
    "split_publisher",
    rf"""WITH {PAGE}, t AS (
      SELECT page_id, CASE WHEN entity = 'en' THEN title ELSE title || ' - ' || host END AS t FROM page),
    s AS (SELECT page_id, t, regexp_matches(t, '(?s)^.* - .*$') AS split FROM t)
    SELECT page_id,
      {CLEAN("CASE WHEN split THEN regexp_extract(t, '(?s)^(.*) - (.*)$', 1) ELSE t END", loader=True)} AS headline,
      CASE WHEN split THEN {STRIP("regexp_extract(t, '(?s)^(.*) - (.*)$', 2)")} ELSE 'Google News' END AS publisher
    FROM s""",
)
def _split_publisher(spark, sf):
    pages = page(spark, sf)
    title = F.when(F.col("entity") == "en", F.col("title")).otherwise(
        F.concat_ws(" - ", "title", "host")
    )
    return pages.select(
        "page_id", headline_of(title).alias("headline"), publisher_of(title).alias("publisher")
    )


@query(
    "parse_dates",
    f"""WITH {EV}, raw AS (
      SELECT event_id, source, date_trunc('second', ts) AS t,
        CASE WHEN sector = 0 AND source = 'view' THEN 'soon, ' || strftime(ts, '%Y')
             WHEN source = 'purchase' THEN '  ' || strftime(ts, '%a, %d %b %Y %H:%M:%S') || ' GMT'
             WHEN source = 'error' THEN strftime(ts, '%a, %d %b %Y %H:%M:%S') || ' +0530'
             WHEN source = 'click' THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ')
             WHEN source = 'signup' THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || '-03:00'
             ELSE strftime(ts, '%Y-%m-%d') END AS raw, sector
      FROM ev)
    SELECT event_id, raw,
      strftime(CASE WHEN sector = 0 AND source = 'view' THEN NULL
           WHEN source = 'error' THEN t - INTERVAL 330 MINUTE
           WHEN source = 'signup' THEN t + INTERVAL 3 HOUR
           WHEN source = 'view' THEN date_trunc('day', t) ELSE t END, '%Y-%m-%d %H:%M:%S') AS instant,
      CASE WHEN sector = 0 AND source = 'view' THEN NULL ELSE strftime(t, '%Y-%m-%d') END AS day,
      CASE WHEN sector = 0 AND source = 'view' THEN '2024-01-31' ELSE strftime(t, '%Y-%m-%d') END AS loader_day
    FROM raw""",
)
def _parse_dates(spark, sf):
    ts, source = F.col("ts"), F.col("source")
    mail = F.date_format(ts, "EEE, dd MMM yyyy HH:mm:ss")
    raw = (
        F.when(
            (F.col("sector") == 0) & (source == "view"),
            F.concat(F.lit("soon, "), F.date_format(ts, "yyyy")),
        )
        .when(source == "purchase", F.concat(F.lit("  "), mail, F.lit(" GMT")))
        .when(source == "error", F.concat(mail, F.lit(" +0530")))
        .when(source == "click", F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(
            source == "signup",
            F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("-03:00")),
        )
        .otherwise(F.date_format(ts, "yyyy-MM-dd"))
    )
    rows = ev(spark, sf).select("event_id", raw.alias("raw"))
    dated = with_feed_dates(rows, "raw", instant="instant", day="day")
    fallback = F.lit("2024-01-31").cast("date")
    return dated.select(
        "event_id",
        "raw",
        F.date_format("instant", "yyyy-MM-dd HH:mm:ss").alias("instant"),
        iso("day", "day"),
        iso(F.coalesce("day", fallback), "loader_day"),
    )


@query(
    "spread_dates",
    f"""SELECT doc_id, {ISO("DATE '2020-01-01' + CAST((i * 1460) // greatest(n - 1, 1) AS INTEGER)")}
    FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n
          FROM documents)""",
)
def _spread_dates(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id")
    return spread_dates(rows, [F.col("doc_id")]).select("doc_id", iso("date"))


def HASHED(*parts: str) -> str:
    return "md5(lower(" + " || '|' || ".join(parts) + "))"


@query(
    "hash_article",
    f"""WITH {DOC} SELECT doc_id,
    {HASHED(STRIP('headline'), STRIP('entity'), "strftime(date, '%Y-%m-%d')", STRIP('source'))} AS headline_hash
    FROM doc""",
)
def _hash_article(spark, sf):
    parts = [F.col(name) for name in ("headline", "entity", "date", "source")]
    return plain_doc(spark, sf).select("doc_id", H.article_hash(*parts).alias("headline_hash"))


@query(
    "hash_headline",
    f"WITH {DOC} SELECT doc_id, {HASHED(STRIP('headline'))} AS headline_hash FROM doc",
)
def _hash_headline(spark, sf):
    return plain_doc(spark, sf).select("doc_id", H.headline_hash(F.col("headline")).alias("headline_hash"))


@query(
    "dedup_ingest_key",
    f"""WITH {DOC}, h AS (
      SELECT doc_id, entity, {HASHED('headline', 'entity', "strftime(date, '%Y-%m-%d')")} AS hash FROM doc),
    first AS (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY doc_id) AS i FROM h)
    SELECT doc_id, entity, hash FROM first
    WHERE i = 1 AND hash NOT IN (
      SELECT {HASHED('headline', 'entity', "strftime(date, '%Y-%m-%d')")} FROM stored)""",
)
def _dedup_ingest_key(spark, sf):
    key = H.ingest_hash(F.col("headline"), F.col("entity"), F.col("date")).alias("hash")
    seen = labelled_doc(spark, sf).select(key)
    rows = plain_doc(spark, sf).select("doc_id", "entity", key)
    return only_new(first_per_key(rows, ["hash"], [F.col("doc_id")]), seen, ["hash"])


FUZZY = (
    "md5("
    + COLLAPSE(
        rf"regexp_replace(regexp_replace(lower({STRIP('headline')}), '\p{{Nd}}+(\.\p{{Nd}}+)?', 'NUM', 'g'), "
        rf"'[^\p{{L}}\p{{N}}_{WS_CLASS}]', '', 'g')"
    )
    + ")"
)


@query(
    "dedup_fuzzy_fingerprint",
    f"""WITH {DOC}, h AS (SELECT doc_id, {FUZZY} AS fingerprint FROM doc)
    SELECT min(doc_id) AS doc_id, fingerprint FROM h GROUP BY fingerprint""",
)
def _dedup_fuzzy(spark, sf):
    rows = balanced(plain_doc(spark, sf)).select("doc_id", H.fuzzy_hash(F.col("headline")).alias("fingerprint"))
    return first_per_key(rows, ["fingerprint"], [F.col("doc_id")])


@query(
    "anti_join_new",
    f"""WITH {DOC} SELECT doc_id, {HASHED(STRIP('headline'))} AS headline_hash FROM doc
    WHERE {HASHED(STRIP('headline'))} NOT IN (SELECT {HASHED(STRIP('headline'))} FROM stored)""",
)
def _anti_join_new(spark, sf):
    key = H.headline_hash(F.col("headline")).alias("headline_hash")
    incoming = plain_doc(spark, sf).select("doc_id", key)
    return only_new(incoming, labelled_doc(spark, sf).select(key), ["headline_hash"])


# The standard names hardly occur in the given texts, so frequent word pieces stand behind them.
KEYWORDS = {
    **ENTITY_KEYWORDS,
    "Northern": ["ündung", "schaft", "heit"],
    "Western": ["éeaux", "queé"],
    "Southern": ["ción", "ñan"],
    "Islands": ["theble", "ionwh", "thand"],
}


def CASE_CONTAINS(text: str, rules, default: str) -> str:
    whens = " ".join(f"WHEN contains({text}, '{word}') THEN '{entity}'" for word, entity in rules)
    return f"CASE {whens} ELSE '{default}' END"


@query(
    "infer_entity_keywords",
    f"""SELECT doc_id, {CASE_CONTAINS('lower(text)', keyword_rules(KEYWORDS), GENERAL_MARKET)} AS entity
    FROM documents""",
)
def _infer_entity(spark, sf):
    rows = balanced(table(spark, sf, "documents").select("doc_id", "text"))
    return infer_entity(rows, "text", KEYWORDS).select("doc_id", "entity")


# A dictionary that is a table: the words of the benchmark items, the one with the least md5 first.
DICTIONARY = """
keywords AS (
  SELECT DISTINCT word AS keyword, md5(word) AS priority
  FROM (SELECT unnest(string_split_regex(lower(text), '[^\\p{L}]+')) AS word FROM benchmark) WHERE length(word) >= 4)"""


@query(
    "infer_entity_table",
    f"""WITH {DICTIONARY},
    hits AS (SELECT doc_id, arg_min(keyword, priority) AS entity
             FROM documents JOIN keywords ON contains(lower(text), keyword) GROUP BY doc_id)
    SELECT doc_id, coalesce(entity, 'none') AS entity FROM documents LEFT JOIN hits USING (doc_id)""",
)
def _infer_entity_table(spark, sf):
    words = table(spark, sf, "benchmark").select(F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("keyword"))
    rules = words.filter(F.char_length("keyword") >= 4).distinct().select("keyword", F.col("keyword").alias("entity"), F.md5("keyword").alias("priority"))
    rows = balanced(table(spark, sf, "documents").select("doc_id", "text"))
    return infer_entity_joined(rows, rules, "doc_id", "text", default="none").select("doc_id", "entity")


KNOWN = ("Thand", "Queé", "Ción", "Schaft", "Tion")


@query(
    "enrich_entities",
    f"""SELECT doc_id, {CASE_CONTAINS('lower(text)', [(n.lower(), n) for n in KNOWN], 'Unknown')} AS entity
    FROM documents""",
)
def _enrich_entities(spark, sf):
    rows = balanced(table(spark, sf, "documents").select("doc_id", "text"))
    return enrich_entities(rows, "text", KNOWN).select("doc_id", "entity")


@query(
    "cap_per_entity",
    f"""WITH {DOC} SELECT doc_id, source FROM
    (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM doc) WHERE i <= 20""",
)
def _cap_per_entity(spark, sf):
    rows = plain_doc(spark, sf).select("doc_id", "source")
    return top_per_key(rows, ["source"], [F.col("doc_id")], 20)

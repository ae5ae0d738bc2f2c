"""Landed payloads and headline files, all rendered by Spark from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from queries.base import (
    AS_OF,
    CLEAN,
    DOC,
    ISO,
    PAGE,
    STRIP,
    conv,
    doc,
    iso,
    page,
    query,
    table,
)
from queries.text import FUZZY
from tonegauge.session import run_dir
from tonegauge.sources import feeds as G
from tonegauge.sources import headlines as L

CDATA_END = "]]>"


def _element(name: str, c) -> F.Column:
    body = F.replace(c, F.lit(CDATA_END), F.lit("]] >"))
    return F.concat(F.lit(f"<{name}><![CDATA["), body, F.lit(f"]]></{name}>"))


def _item(title) -> F.Column:
    mail = F.concat(F.date_format("published", "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))
    return F.concat(
        F.lit("<item>"),
        _element("title", title),
        _element("pubDate", mail),
        _element("link", F.col("url")),
        F.lit("</item>"),
    )


def with_publisher():
    return F.concat("title", F.lit(" - Daily "), F.initcap("entity"))


def rss_payloads(spark, sf) -> DataFrame:
    """One RSS document per page with the page title twice, once with a publisher suffix."""
    body = F.concat(_item(F.col("title")), _item(with_publisher()))
    payload = F.concat(
        F.lit('<?xml version="1.0"?><rss><channel><title>feed</title>'),
        body,
        F.lit("</channel></rss>"),
    )
    return page(spark, sf).select("page_id", "entity", payload.alias("payload"))


# Two feed items per page, in feed order.
ITEMS = f"""
items AS (
  SELECT page_id, entity, 0 AS position, {STRIP('title')} AS title, url, published FROM page
  UNION ALL
  SELECT page_id, entity, 1, {STRIP("title || ' - Daily ' || upper(entity[1]) || entity[2:]")}, url, published
  FROM page
)"""
MAIL = "strftime(published, '%a, %d %b %Y %H:%M:%S') || ' GMT'"


@query(
    "parse_rss_items",
    f"""WITH {PAGE}, {ITEMS} SELECT title, {MAIL} AS "pubDate", url AS link FROM items WHERE title <> ''""",
)
def _parse_rss_items(spark, sf):
    """Written as XML files of feed items, read back by the XML reader."""
    items = G.parse_rss_payloads(rss_payloads(spark, sf)).select("title", "pubDate", "link")
    folder = run_dir(spark, "rss")
    items.write.format("xml").option("rootTag", "channel").option("rowTag", "item").save(folder)
    return G.read_rss_files(spark, folder)


@query(
    "parse_rss_payloads",
    f"""WITH {PAGE}, {ITEMS} SELECT page_id, entity, position, title, {MAIL} AS "pubDate", url AS link
    FROM items WHERE title <> ''""",
)
def _parse_rss_payloads(spark, sf):
    return G.parse_rss_payloads(rss_payloads(spark, sf))


# Kept feed items, numbered per entity in feed order.
FEED_ARTICLES = f"""
    c AS (SELECT *, {CLEAN('title')} AS headline, CAST(published AS DATE) AS date FROM items),
    k AS (SELECT *, md5(lower(headline || '|' || entity || '|' || strftime(date, '%Y-%m-%d'))) AS hash FROM c
          WHERE length(headline) >= 20
            AND floor((epoch(TIMESTAMP '2024-01-31 12:00:00') - epoch(published)) / 86400) BETWEEN 0 AND 7),
    f AS (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY page_id, position) AS i FROM k),
    t AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY page_id, position) AS j FROM f WHERE i = 1)"""


@query(
    "ingest_feed",
    f"""WITH {PAGE}, {ITEMS}, {FEED_ARTICLES}
    SELECT {ISO()}, entity, headline, '' AS true_label, 'google_news' AS source, url, hash FROM t WHERE j <= 20""",
)
def _ingest_feed(spark, sf):
    items = G.parse_rss_payloads(rss_payloads(spark, sf))
    order = [F.col("page_id"), F.col("position")]
    rows = G.ingest_feed(items, order, "2024-01-31 12:00:00")
    return rows.withColumn("date", iso("date"))


@query(
    "ingest_feed_loader",
    f"""WITH {PAGE}, {ITEMS},
    s AS (SELECT *, regexp_matches(title, '(?s)^.* - .*$') AS split FROM items),
    c AS (SELECT *, {CLEAN("CASE WHEN split THEN regexp_extract(title, '(?s)^(.*) - (.*)$', 1) ELSE title END", loader=True)} AS headline,
            CASE WHEN split THEN {STRIP("regexp_extract(title, '(?s)^(.*) - (.*)$', 2)")} ELSE 'Google News' END AS source
          FROM s),
    k AS (SELECT *, {FUZZY} AS hash FROM c WHERE length(headline) >= 20),
    f AS (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY page_id, position) AS i FROM k)
    SELECT strftime(published, '%Y-%m-%d') AS date, entity, headline, '' AS true_label, source, hash
    FROM f WHERE i = 1""",
)
def _ingest_feed_loader(spark, sf):
    items = G.parse_rss_payloads(rss_payloads(spark, sf))
    order = [F.col("page_id"), F.col("position")]
    rows = G.ingest_feed_loader(items, order, AS_OF)
    return rows.withColumn("date", iso("date"))


def news_payloads(spark, sf) -> DataFrame:
    """One news response per conversation turn; turns of the system report an error."""
    article = F.struct(
        F.col("text").alias("title"),
        F.when(F.col("turn") % 2 == 0, F.col("role")).alias("description"),
        F.date_format(
            F.date_add(F.lit("2024-01-01").cast("date"), F.col("turn").cast("int")),
            "yyyy-MM-dd'T'HH:mm:ss'Z'",
        ).alias("publishedAt"),
        F.struct(F.when(F.col("role") != "user", F.col("role")).alias("name")).alias("source"),
    )
    body = F.struct(
        F.when(F.col("role") == "system", "error").otherwise("ok").alias("status"),
        F.array(article).alias("articles"),
    )
    return conv(spark, sf).select("conv_id", "turn", F.to_json(body).alias("payload"))


NEWS = f"""
news AS (
  SELECT conv_id, turn, DATE '2024-01-01' + CAST(turn AS INTEGER) AS date,
         {CLEAN("text || '. ' || CASE WHEN turn % 2 = 0 THEN role ELSE '' END", loader=True)} AS headline,
         '' AS true_label, CASE WHEN role = 'user' THEN 'Unknown' ELSE role END AS source
  FROM conversations WHERE role <> 'system'
),
kept_news AS (SELECT * FROM news WHERE length(headline) >= 20 AND lower(headline) <> '[removed]')"""


@query(
    "parse_news_json",
    f"""WITH {NEWS} SELECT conv_id, turn, {ISO()}, headline, true_label, source FROM kept_news""",
)
def _parse_news_json(spark, sf):
    rows = G.parse_news_json(news_payloads(spark, sf), as_of=AS_OF)
    return rows.withColumn("date", iso("date"))


@query(
    "scan_headlines",
    f"""WITH {DOC} SELECT {ISO()}, entity, md5(headline) AS headline_md5, true_label, source FROM doc""",
)
def _scan_headlines(spark, sf):
    """Written as CSV with a header, read back with checked columns."""
    folder = run_dir(spark, "headlines")
    columns = ("date", "entity", "headline", "true_label", "source")
    rows = doc(spark, sf).select(*columns)
    rows.write.option("header", True).option("escape", '"').option("quoteAll", True).csv(folder)
    back = L.scan_headlines(spark, folder, "csv")
    return back.select(
        iso("date"),
        "entity",
        F.md5("headline").alias("headline_md5"),
        F.coalesce("true_label", F.lit("")).alias("true_label"),
        "source",
    )


# Lines of all documents in the single-byte encoding of the labelled files.
LINES = r"""
split_lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
lines AS (
  SELECT doc_id, array_to_string(list_transform(string_split(line, ''), lambda c: CASE
           WHEN regexp_matches(c, '^[\x09\x20-\x7e\x{a1}-\x{ff}]$') THEN c
           ELSE '\u{' || upper(to_hex(unicode(c))) || '}' END), '') AS line
  FROM split_lines
)"""
LATIN1 = r"[\x09\x20-\x7e\xa1-\xff]"


def latin1_lines(spark, sf) -> DataFrame:
    """Every line of every document; what the encoding lacks, and control characters, are written as escapes."""
    lines = table(spark, sf, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))

    def written(c):
        return F.when(F.rlike(c, F.lit(f"^{LATIN1}$")), c).otherwise(F.concat(F.lit("\\u{"), F.hex(F.ascii(c).cast("long")), F.lit("}")))

    escaped = F.array_join(F.transform(F.split("line", ""), written), "")
    plain = F.rlike("line", F.lit(f"^{LATIN1}*$"))
    return lines.select("doc_id", F.when(plain, F.col("line")).otherwise(escaped).alias("line"))


@query(
    "parse_labelled_text",
    f"""WITH {LINES} SELECT {STRIP('line')} AS sentence, CASE WHEN doc_id % 3 = 0 THEN 'positive' ELSE 'neutral' END AS label
    FROM lines WHERE doc_id % 5 <> 0
    UNION ALL SELECT {STRIP(r"regexp_extract(line, '(?s)^(.*)@(.*)$', 1)")}, {STRIP(r"regexp_extract(line, '(?s)^(.*)@(.*)$', 2)")}
    FROM lines WHERE doc_id % 5 = 0 AND contains(line, '@')""",
)
def _parse_labelled_text(spark, sf):
    """Every line of every document; each fifth document carries no label of its own."""
    label = F.when(F.col("doc_id") % 3 == 0, "positive").otherwise("neutral")
    line = F.when(F.col("doc_id") % 5 == 0, F.col("line")).otherwise(
        F.concat("line", F.lit("@"), label)
    )
    folder = run_dir(spark, "labelled-text")
    latin1_lines(spark, sf).select(line.alias("value")).write.option(
        "encoding", L.LABELLED_ENCODING
    ).option("quote", "").option("sep", "\u0001").option("ignoreLeadingWhiteSpace", False).option(
        "ignoreTrailingWhiteSpace", False
    ).option("emptyValue", "").csv(folder)
    return L.parse_labelled_text(spark, folder)


@query(
    "scan_labelled_csv",
    f"""WITH {LINES} SELECT CASE WHEN doc_id % 3 = 0 THEN 'positive' ELSE 'neutral' END AS sentiment,
    md5(line) AS sentence_md5 FROM lines""",
)
def _scan_labelled_csv(spark, sf):
    """Written with semicolons, which the reader has to find out."""
    label = F.when(F.col("doc_id") % 3 == 0, "positive").otherwise("neutral")
    folder = run_dir(spark, "labelled-csv")
    rows = latin1_lines(spark, sf).select(label, "line")
    rows.write.option("sep", ";").option("encoding", L.LABELLED_ENCODING).option(
        "quoteAll", True
    ).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option(
        "ignoreTrailingWhiteSpace", False
    ).csv(folder)
    back = L.scan_labelled_csv(spark, folder)
    return back.select("sentiment", F.md5(F.coalesce("sentence", F.lit(""))).alias("sentence_md5"))

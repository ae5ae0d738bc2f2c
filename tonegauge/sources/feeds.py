"""Landed feed payloads to article rows. Fetching is not done here."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from tonegauge.functions.dates import with_feed_dates
from tonegauge.functions.hashing import fuzzy_hash, ingest_hash
from tonegauge.functions.text import (
    PUBLISHER_SUFFIX_LOADER,
    clean_headline,
    headline_of,
    publisher_of,
    strip,
)
from tonegauge.functions.weights import day
from tonegauge.operators.dedup import first_per_key, only_new, top_per_key
from tonegauge.operators.filters import min_text_length, recent
from tonegauge.schemas import FEED_ITEM, NEWS_PAYLOAD, RSS_PAYLOAD

# Constant source names and the per-entity cap.
FEED_SOURCE = "google_news"
UNKNOWN_SOURCE = "Unknown"
MAX_PER_ENTITY = 20


def _text(c: Column) -> Column:
    return F.coalesce(strip(c), F.lit(""))


def read_rss_files(spark: SparkSession, path: str) -> DataFrame:
    """Items of landed RSS files; broken items and blank titles are skipped."""
    items = (
        spark.read.format("xml")
        .option("rowTag", "item")
        .option("mode", "DROPMALFORMED")
        .schema(FEED_ITEM)
        .load(path)
    )
    return items.select(
        _text(F.col("title")).alias("title"),
        _text(F.col("pubDate")).alias("pubDate"),
        _text(F.col("link")).alias("link"),
    ).filter(F.col("title") != "")


def read_payload_files(spark: SparkSession, path: str) -> DataFrame:
    """Landed payload documents, one row per file: `payload`, the file name, and whatever the
    folders name (`entity=<name>/`). A payload is one fetched feed page, hence small."""
    files = spark.read.option("wholetext", True).text(path)
    named = [name for name in files.columns if name != "value"]
    return files.select(
        *named, F.col("_metadata.file_name").alias("file"), F.col("value").alias("payload")
    )


def parse_rss_payloads(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """Items of one RSS document per row, with their feed position; a broken document has none.

    Items of all channels come first, in order, then those that stand beside the channels. The outer
    explode keeps Spark from deriving a filter that would parse the document once more.
    """
    root = F.from_xml(F.col(payload), RSS_PAYLOAD.simpleString(), {"mode": "PERMISSIVE"})
    keep = [name for name in payloads.columns if name != payload]
    none = F.array().cast(ArrayType(FEED_ITEM))
    every = lambda doc: F.concat(
        F.coalesce(
            F.flatten(F.transform(doc["channel"], lambda c: F.coalesce(c["item"], none))), none
        ),
        F.coalesce(doc["item"], none),
    )
    # Bound by a lambda, the parsed document is one value however often it is looked at.
    items = payloads.withColumn("__items", F.flatten(F.transform(F.array(root), every))).select(
        *keep, F.posexplode_outer("__items").alias("position", "item")
    )
    return items.select(
        *keep,
        "position",
        _text(F.col("item.title")).alias("title"),
        _text(F.col("item.pubDate")).alias("pubDate"),
        _text(F.col("item.link")).alias("link"),
    ).filter(F.col("title") != "")


def parse_news_json(payloads: DataFrame, payload: str = "payload", as_of=None) -> DataFrame:
    """Articles of JSON payloads whose status is ok, cleaned; removed and short ones are dropped.

    A missing or unreadable date becomes `as_of`.
    """
    keep = [name for name in payloads.columns if name != payload]
    parsed = payloads.withColumn("__news", F.from_json(F.col(payload), NEWS_PAYLOAD))
    articles = parsed.filter(F.col("__news.status") == "ok").select(
        *keep, F.inline("__news.articles")
    )
    headline = clean_headline(
        F.concat(
            F.coalesce("title", F.lit("")), F.lit(". "), F.coalesce("description", F.lit(""))
        ),
        PUBLISHER_SUFFIX_LOADER,
    )
    dated = with_feed_dates(articles, "publishedAt", day="__day")
    rows = dated.select(
        *keep,
        F.coalesce("__day", day(as_of)).alias("date"),
        headline.alias("headline"),
        F.lit("").alias("true_label"),
        F.coalesce("source.name", F.lit(UNKNOWN_SOURCE)).alias("source"),
    )
    return min_text_length(rows)


# Keys met before: a table with `hash`, or a function that keeps the rows whose `hash` is new.
Seen = DataFrame | Callable[[DataFrame], DataFrame] | None


def _first_unseen(rows: DataFrame, seen: Seen, order_by: list[Column]) -> DataFrame:
    """First row per hash, then the unseen ones. In this order the copies of a hot key are dropped
    before the first shuffle."""
    firsts = first_per_key(rows, ["hash"], order_by)
    if seen is None:
        return firsts
    return seen(firsts) if callable(seen) else only_new(firsts, seen, ["hash"])


def ingest_feed(
    items: DataFrame,
    order_by: list[Column],
    as_of=None,
    seen: Seen = None,
    max_per_entity: int = MAX_PER_ENTITY,
    max_age_days: int = 7,
) -> DataFrame:
    """Feed items with their `entity` to article rows.

    Clean, drop short, undated and old items, keep the first per (headline, entity, day) that was
    not seen before, then the first `max_per_entity` of each entity. Returns the articles with
    their `hash`; only these rows belong into the seen table.
    """
    rows = min_text_length(items.withColumn("headline", clean_headline(F.col("title"))))
    rows = with_feed_dates(rows, "pubDate", instant="__published", day="date")
    rows = recent(rows, "__published", as_of, max_age_days).withColumn(
        "hash", ingest_hash(F.col("headline"), F.col("entity"), F.col("date"))
    )
    rows = _first_unseen(rows, seen, order_by)
    rows = top_per_key(rows, ["entity"], order_by, max_per_entity)
    return rows.select(
        "date",
        "entity",
        "headline",
        F.lit("").alias("true_label"),
        F.lit(FEED_SOURCE).alias("source"),
        F.col("link").alias("url"),
        "hash",
    )


def ingest_feed_loader(
    items: DataFrame, order_by: list[Column], as_of=None, seen: Seen = None
) -> DataFrame:
    """The bulk-load variant: publisher from the title, near-duplicate key, undated items get
    `as_of`, no age limit and no cap."""
    rows = min_text_length(
        items.withColumns(
            {"headline": headline_of(F.col("title")), "source": publisher_of(F.col("title"))}
        )
    )
    rows = with_feed_dates(rows, "pubDate", day="date").withColumns(
        {"date": F.coalesce("date", day(as_of)), "hash": fuzzy_hash(F.col("headline"))}
    )
    rows = _first_unseen(rows, seen, order_by)
    return rows.select(
        "date", "entity", "headline", F.lit("").alias("true_label"), "source", "hash"
    )

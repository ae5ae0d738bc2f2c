"""Table merges as lazy transforms; writing is left to `tonegauge.sources.tables`."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tonegauge.functions.hashing import article_hash, headline_hash
from tonegauge.operators.cleaning import clean_articles
from tonegauge.operators.dedup import only_new

HASH = "headline_hash"


def with_article_hash(df: DataFrame, replace: bool = False) -> DataFrame:
    """Add the four-part article key unless the table already carries one."""
    if HASH in df.columns and not replace:
        return df
    parts = [
        F.col(name) if name in df.columns else F.lit(None).cast(kind)
        for name, kind in (
            ("headline", "string"),
            ("entity", "string"),
            ("date", "date"),
            ("source", "string"),
        )
    ]
    return df.withColumn(HASH, article_hash(*parts))


def with_headline_hash(df: DataFrame) -> DataFrame:
    return df.withColumn(HASH, headline_hash(F.col("headline")))


def union_sources(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Union by name; columns a table lacks become NULL."""
    merged = first
    for other in others:
        merged = merged.unionByName(other, allowMissingColumns=True)
    return merged


def absent_articles(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Incoming articles whose key is not stored, ready to append; repeats inside the batch stay."""
    return only_new(with_article_hash(incoming, replace=True), with_article_hash(stored), [HASH])


def insert_if_absent(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Stored articles plus the absent ones."""
    return union_sources(with_article_hash(stored), absent_articles(incoming, stored))


def upsert_by_key(
    stored: DataFrame, incoming: DataFrame, keys: Sequence[str] = (HASH,)
) -> DataFrame:
    """Stored rows without an incoming key, plus all incoming rows; text dates are parsed."""
    kept = only_new(stored, incoming, keys)
    return coerce_date(union_sources(kept, incoming))


def coerce_date(df: DataFrame) -> DataFrame:
    if "date" not in df.columns or not isinstance(df.schema["date"].dataType, StringType):
        return df
    return df.withColumn("date", F.to_date(F.try_to_timestamp("date")))


def merge_seen(seen: DataFrame, new: DataFrame) -> DataFrame:
    """Seen keys with the new ones added once each."""
    fresh = only_new(new.select("hash").distinct(), seen, ["hash"])
    return seen.select("hash").unionByName(fresh)


def append_refresh(
    stored: DataFrame, incoming: DataFrame, order_by: Sequence[Column]
) -> DataFrame:
    """Stored plus incoming rows, cleaned and de-duplicated per day as one table."""
    return clean_articles(union_sources(stored, incoming), order_by, daily=True)


def table_health(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count per table in one job; a table that does not exist yet counts 0."""
    counts = [
        df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "rows")
        for name, df in tables.items()
    ]
    return union_sources(*counts)

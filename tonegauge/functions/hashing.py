"""Article keys. Missing parts count as empty text; dates are always written yyyy-MM-dd."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tonegauge.functions.text import fingerprint_text, strip


def _part(c: Column) -> Column:
    return F.coalesce(strip(c), F.lit(""))


def day_text(date: Column) -> Column:
    return F.date_format(F.to_date(date), "yyyy-MM-dd")


def article_hash(headline: Column, entity: Column, date: Column, source: Column) -> Column:
    """Key of a stored article: headline, entity, day and source."""
    text = F.concat_ws("|", _part(headline), _part(entity), _part(day_text(date)), _part(source))
    return F.md5(F.lower(text))


def headline_hash(headline: Column) -> Column:
    """Key of a scored headline."""
    return F.md5(F.lower(_part(headline)))


def ingest_hash(headline: Column, entity: Column, date: Column) -> Column:
    """Key used while landing feeds: headline, entity and day, not trimmed."""
    return F.md5(F.lower(F.concat_ws("|", headline, entity, day_text(date))))


def fuzzy_hash(headline: Column) -> Column:
    """Near-duplicate key: equal for headlines that differ in numbers, case or punctuation."""
    return F.md5(fingerprint_text(headline))

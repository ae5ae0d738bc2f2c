"""Feed date parsing without the session locale and without raising on junk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonegauge.functions.text import collapse_whitespace, strip

# The accepted shapes. The week day is checked but not parsed.
TRAILING_ZONE_WORD = r"(?U)\s+[A-Z]{2,4}$"
OFFSET = r"(?-i:Z)|[+-]\d{2}:?[0-5]\d(?::?[0-5]\d)?"
MAIL_DATE = r"(?i)^(?:mon|tue|wed|thu|fri|sat|sun), (\d.*?)(?: (" + OFFSET + r"))?$"
ISO_DATE = r"(?i)^(\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2})(" + OFFSET + r")$"
MAIL_FORMAT = "d MMM yyyy H:m:s"
ISO_FORMAT = "yyyy-M-d'T'H:m:s"
DAY_FORMAT = "yyyy-M-d"


def _normalised(raw: Column) -> Column:
    return collapse_whitespace(F.regexp_replace(strip(raw), TRAILING_ZONE_WORD, ""))


def _wall_clock(mail: Column, iso: Column, text: Column) -> Column:
    return F.coalesce(
        F.try_to_timestamp(mail, F.lit(MAIL_FORMAT)),
        F.try_to_timestamp(iso, F.lit(ISO_FORMAT)),
        F.try_to_timestamp(text, F.lit(DAY_FORMAT)),
    )


def _offset_seconds(zone: Column) -> Column:
    digits = F.rpad(F.regexp_replace(zone, "[^0-9]", ""), 6, "0")
    seconds = (
        F.substring(digits, 1, 2).cast("int") * 3600
        + F.substring(digits, 3, 2).cast("int") * 60
        + F.substring(digits, 5, 2).cast("int")
    )
    return F.when(F.startswith(zone, F.lit("-")), -seconds).otherwise(seconds)


def with_feed_dates(
    df: DataFrame, raw: str, instant: str | None = None, day: str | None = None
) -> DataFrame:
    """Add the moment of a feed date and its calendar day, NULL for an unknown shape.

    Without a zone the text is UTC; the day is that of the feed's own zone. The steps are columns
    of their own so that each pattern is matched once per row.
    """
    text, mail, iso = F.col("__text"), F.col("__mail"), F.col("__iso")
    steps = (
        df.withColumn("__text", _normalised(F.col(raw)))
        .withColumns(
            {
                "__mail": F.regexp_extract(text, MAIL_DATE, 1),
                "__iso": F.regexp_extract(text, ISO_DATE, 1),
            }
        )
        .withColumn("__wall", _wall_clock(mail, iso, text))
    )
    added = {}
    if day:
        added[day] = F.to_date("__wall")
    if instant:
        zone = F.when(mail != "", F.regexp_extract(text, MAIL_DATE, 2)).otherwise(
            F.regexp_extract(text, ISO_DATE, 2)
        )
        steps = steps.withColumn("__zone", zone)
        shift = F.when(F.col("__zone") == "", F.lit(0)).otherwise(_offset_seconds(F.col("__zone")))
        added[instant] = F.timestamp_seconds(F.unix_timestamp("__wall") - shift)
    return steps.withColumns(added).drop("__text", "__mail", "__iso", "__wall", "__zone")

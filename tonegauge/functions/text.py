"""String expressions. All of them stay inside generated JVM code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as white space, the two publisher suffixes, and the cleanup patterns.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
PUBLISHER_SUFFIX_CURRENT = r"\s[-–]\s[A-Za-z0-9.&\- ]{2,50}$"
PUBLISHER_SUFFIX_LOADER = r"\s[-–]\s[A-Z][A-Za-z &]{2,35}$"
TAG = r"<[^>]+>"
NUMBER = r"\p{Nd}+(\.\p{Nd}+)?"
PUNCTUATION = r"(?U)[^\p{L}\p{N}_\s\x1c-\x1f]+"
WHITESPACE_RUN = r"(?U)[\s\x1c-\x1f]+"
DEFAULT_PUBLISHER = "Google News"


def strip(c: Column) -> Column:
    """Trim every Unicode white-space character at both ends (plain `trim` knows only 0x20)."""
    return F.btrim(c, F.lit(WHITESPACE))


def collapse_whitespace(c: Column) -> Column:
    return F.regexp_replace(c, WHITESPACE_RUN, " ")


def clean_headline(c: Column, suffix: str = PUBLISHER_SUFFIX_CURRENT) -> Column:
    """Drop tags, squeeze white space, then drop a trailing ` - Publisher`."""
    plain = strip(collapse_whitespace(F.regexp_replace(c, TAG, "")))
    return F.regexp_replace(plain, suffix, "")


def _has_publisher(title: Column) -> Column:
    return F.contains(title, F.lit(" - "))


def publisher_of(title: Column) -> Column:
    """Text after the last ` - `, or the default publisher."""
    return F.when(
        _has_publisher(title), strip(F.substring_index(title, " - ", -1))
    ).otherwise(F.lit(DEFAULT_PUBLISHER))


def headline_of(title: Column) -> Column:
    """Text before the last ` - ` (the whole title if there is none), cleaned."""
    tail = F.char_length(F.substring_index(title, " - ", -1))
    head = F.substr(title, F.lit(1), F.char_length(title) - tail - F.lit(3))
    return clean_headline(
        F.when(_has_publisher(title), head).otherwise(title), PUBLISHER_SUFFIX_LOADER
    )


def fingerprint_text(c: Column) -> Column:
    """Lower-case, numbers become NUM, punctuation goes, white space is squeezed."""
    lowered = F.lower(strip(c))
    numbers = F.regexp_replace(lowered, NUMBER, "NUM")
    return collapse_whitespace(F.regexp_replace(numbers, PUNCTUATION, ""))

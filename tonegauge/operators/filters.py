"""Row filters and guards."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonegauge.functions.probabilities import CLASS_ORDER

# Minimum lengths, the placeholder headline and the name of the evaluation corpus.
MIN_LENGTH_INGEST = 20
MIN_LENGTH_CLEAN = 15
PLACEHOLDER = "[removed]"
EVALUATION_SOURCE = "phrasebank"
MIN_LABELLED_ROWS = 50


def min_text_length(
    df: DataFrame, column: str = "headline", at_least: int = MIN_LENGTH_INGEST
) -> DataFrame:
    """Keep rows whose text is long enough and is not the placeholder of a withdrawn article."""
    text = F.col(column)
    return df.filter((F.char_length(text) >= at_least) & (F.lower(text) != PLACEHOLDER))


def recent(df: DataFrame, instant: str, as_of=None, max_age_days: int = 7) -> DataFrame:
    """Keep rows whose whole-day age lies in 0..max_age_days; without `as_of` the age is that of
    now (of the batch, on a stream). The bounds are on the bare column, so they reach the scan."""
    if as_of is None:
        end = F.current_timestamp()
    else:
        end = as_of if isinstance(as_of, Column) else F.to_timestamp(F.lit(as_of))
    start = end - F.make_dt_interval(F.lit(max_age_days + 1))
    return df.filter((F.col(instant) <= end) & (F.col(instant) > start))


def exclude_evaluation_corpus(
    df: DataFrame, column: str = "source", corpus: str = EVALUATION_SOURCE
) -> DataFrame:
    """Everything but the labelled corpus; rows without a source stay."""
    return df.filter(~F.col(column).eqNullSafe(F.lit(corpus)))


def labelled_rows(
    df: DataFrame, column: str = "true_label", at_least: int | None = None
) -> DataFrame:
    """Rows with a real label. With `at_least`, a cheap bounded count guards the caller."""
    kept = df.filter(F.col(column).isin(*CLASS_ORDER))
    if at_least is not None:
        found = kept.limit(at_least).count()
        if found < at_least:
            raise ValueError(f"only {found} labelled rows, at least {at_least} needed")
    return kept


def require_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Fail before any job runs when columns are missing, naming them."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df

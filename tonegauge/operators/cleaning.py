"""Article cleaning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tonegauge.functions.probabilities import CLASS_ORDER
from tonegauge.functions.text import strip
from tonegauge.operators.dedup import first_per_key
from tonegauge.operators.filters import EVALUATION_SOURCE, MIN_LENGTH_CLEAN

# Raw label spellings and what they mean.
LABEL_NAMES = {
    "positive": "positive",
    "negative": "negative",
    "neutral": "neutral",
    "2": "positive",
    "1": "neutral",
    "0": "negative",
}


def _instant(df: DataFrame, column: str) -> Column:
    typed = df.schema[column].dataType
    return F.try_to_timestamp(F.col(column)) if isinstance(typed, StringType) else F.col(column)


def known_label(c: Column) -> Column:
    """Lower-cased label, or empty text for anything that is not a class name."""
    label = F.lower(strip(c))
    return F.when(label.isin(*CLASS_ORDER), label).otherwise(F.lit(""))


def usable_articles(
    df: DataFrame, daily: bool = False, min_length: int = MIN_LENGTH_CLEAN
) -> DataFrame:
    """Trim, normalise labels and drop unusable rows: the part of cleaning that looks at one row.

    With `daily` the date loses its time.
    """
    date = _instant(df, "date")
    prepared = df.withColumns(
        {
            "headline": strip(F.col("headline")),
            "entity": strip(F.col("entity")),
            "true_label": known_label(F.col("true_label")),
            "date": F.to_date(date) if daily else date,
        }
    )
    return prepared.filter(
        F.col("date").isNotNull()
        & (F.char_length("headline") >= min_length)
        & ~F.col("entity").isin("", "nan")
    )


def clean_articles(
    df: DataFrame,
    order_by: Sequence[Column],
    daily: bool = False,
    min_length: int = MIN_LENGTH_CLEAN,
) -> DataFrame:
    """Usable articles, the first of each (headline, entity, date).

    With `daily` repeats within one day collapse. `order_by` says what "first" means. The result is
    unordered; sort where it is shown or written.
    """
    usable = usable_articles(df, daily, min_length)
    return first_per_key(usable, ["headline", "entity", "date"], order_by)


def clean_whole_rows(df: DataFrame) -> DataFrame:
    """Drop rows without a headline and exact repeats of whole rows."""
    return df.filter(F.col("headline").isNotNull()).dropDuplicates()


def normalise_labels(df: DataFrame, column: str, into: str = "true_label") -> DataFrame:
    """Map the raw spellings to class names by literal lookup and drop everything else."""
    table = F.create_map(*[F.lit(x) for pair in LABEL_NAMES.items() for x in pair])
    label = F.try_element_at(table, F.lower(strip(F.col(column))))
    return df.withColumn(into, label).filter(F.col(into).isNotNull())


def corpus_schema(df: DataFrame, sentence: str, source: str = EVALUATION_SOURCE) -> DataFrame:
    """Labelled sentences in the article shape, with a constant source."""
    return df.select(
        "date",
        "entity",
        strip(F.col(sentence)).alias("headline"),
        "true_label",
        F.lit(source).alias("source"),
    )

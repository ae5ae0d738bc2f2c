"""Building the article table from a labelled corpus and landed live articles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonegauge.operators.cleaning import clean_articles, corpus_schema, normalise_labels
from tonegauge.operators.dating import spread_dates
from tonegauge.operators.entities import infer_entity
from tonegauge.operators.maintenance import append_refresh, union_sources


def corpus_articles(
    sentences: DataFrame,
    order_by: Sequence[Column],
    sentence: str = "sentence",
    label: str = "label",
) -> DataFrame:
    """Labelled sentences as article rows: known labels only, evenly spread dates, inferred entity
    and a constant source."""
    known = normalise_labels(sentences.filter(F.col(sentence).isNotNull()), label, "true_label")
    named = infer_entity(spread_dates(known, order_by), sentence)
    return corpus_schema(named, sentence)


def build_dataset(
    frames: Sequence[DataFrame], order_by: Sequence[Column], stored: DataFrame | None = None
) -> DataFrame:
    """Union, clean and de-duplicate per day; with `stored` the result is an append refresh."""
    if not frames:
        raise ValueError("no article source given")
    fresh = union_sources(*frames)
    if stored is None:
        return clean_articles(fresh, order_by, daily=True)
    return append_refresh(stored, fresh, order_by)

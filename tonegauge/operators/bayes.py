"""Multinomial naive Bayes in closed form: word counts by class over the whole vocabulary.

Training is one aggregate over the words of the labelled rows; hot words are summed before they are
shuffled, and the vocabulary stays a table. Scoring joins the distinct words of a row with it.
A word that training has not met says nothing; a class without rows is never chosen.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonegauge.functions.probabilities import CLASS_ORDER
from tonegauge.operators.filters import labelled_rows
from tonegauge.operators.scoring import score_columns
from tonegauge.session import materialise
from tonegauge.sources.models import ModelStore

WORD_BREAK = r"[^\p{L}\p{N}]+"
SMOOTHING = 1.0


def words_of(text: Column) -> Column:
    """Lower-cased words of a text: runs of letters and digits."""
    return F.filter(F.split(F.lower(text), WORD_BREAK), lambda w: w != "")


@dataclass(frozen=True)
class BayesModel:
    """`words` has a count per class (n_<label>), the rest is one number per class."""

    words: DataFrame
    labels: tuple[str, ...]
    documents: tuple[int, ...]
    tokens: tuple[int, ...]
    vocabulary: int

    def save(self, store: ModelStore) -> int:
        settings = {"documents": self.documents, "tokens": self.tokens, "vocabulary": self.vocabulary}
        return store.save(self.labels, {"words": self.words}, settings=settings)

    @classmethod
    def load(cls, store: ModelStore, version: int | None = None) -> BayesModel:
        kept = store.load(version)
        s = kept.settings
        return cls(kept.tables["words"], kept.labels, tuple(s["documents"]), tuple(s["tokens"]), s["vocabulary"])


def train_bayes(
    df: DataFrame, text: str = "headline", label: str = "true_label", labels: Sequence[str] = CLASS_ORDER
) -> BayesModel:
    """Count words and rows by class; the counts are written once."""
    rows = labelled_rows(df, label).select(F.col(label).alias("__label"), words_of(F.col(text)).alias("__words"))
    counts = [F.count_if(F.col("__label") == name).alias(f"n_{name}") for name in labels]
    each = rows.select("__label", F.explode("__words").alias("word"))
    words = materialise(each.groupBy("word").agg(*counts), "bayes-words")
    of_rows = rows.agg(*counts).first()
    of_words = words.agg(F.count("*").alias("v"), *[F.sum(f"n_{name}").alias(f"n_{name}") for name in labels]).first()
    documents = tuple(of_rows[f"n_{name}"] for name in labels)
    tokens = tuple(of_words[f"n_{name}"] or 0 for name in labels)
    return BayesModel(words, tuple(labels), documents, tokens, of_words["v"])


def log_likelihoods(df: DataFrame, model: BayesModel, row_id: str, text: str = "headline") -> DataFrame:
    """row_id and, per class, the sum of the logs of its words (l_<label>); rows without a known word are absent."""
    each = df.select(row_id, F.sort_array(words_of(F.col(text))).alias("__words"))
    counted = each.select(row_id, F.inline(runs("__words")))
    logs = [
        F.sum(F.col("__n") * F.ln((F.col(f"n_{name}") + SMOOTHING) / F.lit(float(tokens + SMOOTHING * model.vocabulary)))).alias(f"l_{name}")
        for name, tokens in zip(model.labels, model.tokens)
    ]
    return counted.join(model.words, "word").groupBy(row_id).agg(*logs)


def runs(words: str) -> Column:
    """Distinct words (word, __n) of a sorted array, counted inside the row."""
    size = F.size(words)
    places = F.when(size > 0, F.sequence(F.lit(0), size - 1)).otherwise(F.array().cast("array<int>"))
    starts = F.filter(places, lambda i: (i == 0) | (F.get(words, i) != F.get(words, i - 1)))

    def counted(at: Column) -> Column:
        last = lambda k: F.coalesce(F.get(at, k + 1), size)
        return F.transform(at, lambda i, k: F.struct(F.get(words, i).alias("word"), (last(k) - i).cast("long").alias("__n")))

    return F.transform(F.array(starts), counted)[0]


def score_bayes(df: DataFrame, model: BayesModel, row_id: str, text: str = "headline") -> DataFrame:
    """The rows of `df` with class probabilities, label, confidence and score; `row_id` must be unique."""
    total = sum(model.documents)
    known = log_likelihoods(df, model, row_id, text)
    logs = []
    for name, documents in zip(model.labels, model.documents):
        prior = F.lit(float(documents) / total) if documents else None
        # ln(0) without a special case further on: no sum of logs comes near.
        logs.append(F.coalesce(f"l_{name}", F.lit(0.0)) + F.ln(prior) if documents else F.lit(-1e300))
    raised = F.array(*logs)
    shares = F.transform(raised, lambda x: F.exp(x - F.array_max(raised)))
    scored = df.join(known, row_id, "left").withColumn("__shares", shares)
    total_share = F.aggregate("__shares", F.lit(0.0), lambda a, x: a + x)
    probabilities = F.transform("__shares", lambda x: x / total_share)
    return score_columns(scored, probabilities, model.labels).drop("__shares", *[f"l_{name}" for name in model.labels])

"""Batch scoring: any predictor, or a stored Spark ML model, and the columns derived from it."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.functions import predict_batch_udf, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from tonegauge.config import EngineConfig
from tonegauge.functions.probabilities import CLASS_ORDER, argmax_label, class_probability
from tonegauge.operators.dedup import only_new

BATCH_SIZE = EngineConfig().score_batch_size


def score_columns(
    df: DataFrame, probabilities: Column, labels: Sequence[str] = CLASS_ORDER
) -> DataFrame:
    """Class probabilities, label, confidence and score P(positive) - P(negative).

    `labels` names the classes in the order of the array.
    """
    scored = df.withColumn("__p", probabilities)
    p = F.col("__p")
    return (
        scored.withColumns(
            {f"prob_{name}": class_probability(p, name, labels) for name in CLASS_ORDER}
        )
        .withColumns(
            {
                "predicted_label": argmax_label(p, labels),
                "confidence": F.array_max(p).cast("double"),
                "sentiment_score": F.col("prob_positive") - F.col("prob_negative"),
            }
        )
        .drop("__p")
    )


def score_batch(
    df: DataFrame,
    make_predict: Callable,
    text: str = "headline",
    labels: Sequence[str] = CLASS_ORDER,
    batch_size: int = BATCH_SIZE,
) -> DataFrame:
    """Score with any predictor. `make_predict()` loads the model once per Python worker and
    returns a function from an array of texts to an (n, classes) array of probabilities.

    The texts go to the predictor whole; only the text column crosses into Python.
    """
    predict = predict_batch_udf(
        make_predict, return_type=ArrayType(DoubleType()), batch_size=batch_size
    )
    return score_columns(df, predict(F.col(text)), labels)


def score_with_model(
    df: DataFrame, model: PipelineModel, labels: Sequence[str] = CLASS_ORDER
) -> DataFrame:
    """Score with a trained Spark ML model; its working columns are dropped."""
    predicted = model.transform(df)
    added = [name for name in predicted.columns if name not in df.columns]
    return score_columns(predicted, vector_to_array(F.col("probability")), labels).drop(*added)


def score_incremental(
    incoming: DataFrame,
    stored: DataFrame,
    score: Callable[[DataFrame], DataFrame],
    keys: Sequence[str] = ("headline_hash",),
) -> DataFrame:
    """Score only rows whose key is not stored; the anti join sits below the model on purpose."""
    return score(only_new(incoming, stored, keys))

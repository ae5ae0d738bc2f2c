"""A three-class text classifier trained and evaluated on the cluster."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonegauge.functions.probabilities import CLASS_ORDER
from tonegauge.operators.evaluation import classification_report
from tonegauge.operators.filters import MIN_LABELLED_ROWS, labelled_rows
from tonegauge.operators.scoring import score_with_model
from tonegauge.session import materialise
from tonegauge.sources.models import ModelStore

FEATURES = 1 << 16


def train_classifier(
    df: DataFrame,
    text: str = "headline",
    label: str = "true_label",
    features: int = FEATURES,
    iterations: int = 20,
    regularisation: float = 0.01,
) -> PipelineModel:
    """Fit tokens -> hashed counts -> IDF -> multinomial regression on the labelled rows.

    The labelled rows are written once, as every stage and every iteration comes back to them.
    Class indexes follow the fixed class order, so model probabilities need no reordering.
    """
    rows = materialise(labelled_rows(df, label).select(text, label), "training")
    labelled_rows(rows, label, MIN_LABELLED_ROWS)
    names = F.array(*[F.lit(name) for name in CLASS_ORDER])
    index = (F.array_position(names, F.col(label)) - 1).cast("double")
    stages = [
        RegexTokenizer(
            inputCol=text, outputCol="__tokens", pattern=r"[^\p{L}\p{N}]+", toLowercase=True
        ),
        HashingTF(inputCol="__tokens", outputCol="__counts", numFeatures=features),
        IDF(inputCol="__counts", outputCol="__features"),
        LogisticRegression(
            featuresCol="__features",
            labelCol="__label",
            predictionCol="__prediction",
            family="multinomial",
            maxIter=iterations,
            regParam=regularisation,
        ),
    ]
    return Pipeline(stages=stages).fit(rows.select(text, index.alias("__label")))


def evaluate_model(
    model: PipelineModel, holdout: DataFrame, label: str = "true_label"
) -> DataFrame:
    """Per-class report of a model on held-out rows."""
    return classification_report(score_with_model(holdout, model), truth=label)


def evaluate_stored(store: ModelStore, holdout: DataFrame, label: str = "true_label", version: int | None = None) -> DataFrame:
    """Per-class report of a stored pipeline, the newest by default; its class order comes with it."""
    kept = store.load(version)
    return classification_report(score_with_model(holdout, kept.pipeline, kept.labels), truth=label)

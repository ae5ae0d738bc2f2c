"""Classifier metrics and an exact stratified holdout."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonegauge.functions.probabilities import CLASS_ORDER
from tonegauge.functions.rounding import round_exact

# Share and seed of the holdout, digits of reported metrics.
HOLDOUT_SHARE = 0.15
HOLDOUT_SEED = 42
METRIC_DIGITS = 4

_BUCKET_CHARS = 4  # 65,536 hash buckets


def confusion(df: DataFrame, truth: str = "true_label", predicted: str = "predicted_label"):
    """Rows per (truth, prediction). The only pass over the data; everything else uses this."""
    return (
        df.filter(F.col(truth).isNotNull() & F.col(predicted).isNotNull())
        .groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted"))
        .agg(F.count("*").alias("n"))
    )


def class_scores(pairs: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class from a confusion table.

    Each confusion cell is counted once for its true and once for its predicted class, so the
    table is read a single time. A division by zero is 0.
    """
    roles = F.array(
        F.struct(F.col("truth").alias("label"), F.lit(True).alias("as_truth")),
        F.struct(F.col("predicted").alias("label"), F.lit(False).alias("as_truth")),
    )
    cells = pairs.select(
        F.inline(roles), "n", (F.col("truth") == F.col("predicted")).alias("correct")
    )
    n = F.col("n")
    sums = cells.groupBy("label").agg(
        F.sum(F.when(F.col("as_truth") & F.col("correct"), n).otherwise(0)).alias("hits"),
        F.sum(F.when(F.col("as_truth"), n).otherwise(0)).alias("support"),
        F.sum(F.when(~F.col("as_truth"), n).otherwise(0)).alias("claimed"),
    )
    zero = F.lit(0.0)
    return sums.select(
        "label",
        F.coalesce(F.try_divide("hits", "claimed"), zero).alias("precision"),
        F.coalesce(F.try_divide("hits", "support"), zero).alias("recall"),
        F.coalesce(
            F.try_divide(F.col("hits") * 2.0, F.col("claimed") + F.col("support")), zero
        ).alias("f1"),
        "support",
        "hits",
    )


def _weighted(column: str) -> Column:
    total = F.sum("support")
    return F.coalesce(F.try_divide(F.sum(F.col(column) * F.col("support")), total), F.lit(0.0))


def classification_metrics(
    df: DataFrame, truth: str = "true_label", predicted: str = "predicted_label"
) -> DataFrame:
    """One row: accuracy, macro F1 and support-weighted F1, rounded."""
    scores = class_scores(confusion(df, truth, predicted))
    accuracy = F.coalesce(F.try_divide(F.sum("hits"), F.sum("support")), F.lit(0.0))
    return scores.agg(
        round_exact(accuracy, METRIC_DIGITS).alias("accuracy"),
        round_exact(F.avg("f1"), METRIC_DIGITS).alias("macro_f1"),
        round_exact(_weighted("f1"), METRIC_DIGITS).alias("weighted_f1"),
    )


def classification_report(
    df: DataFrame, truth: str = "true_label", predicted: str = "predicted_label"
) -> DataFrame:
    """Per-class rows, plus the macro and the support-weighted averages."""
    scores = class_scores(confusion(df, truth, predicted))
    # At most one row per class from here on; the grouping sets give classes and totals together.
    label = F.col("label")
    is_total = F.grouping(label) == 1
    rolled = scores.groupingSets([[label], []], label).agg(
        is_total.alias("is_total"),
        *[F.avg(name).alias(f"macro_{name}") for name in ("precision", "recall", "f1")],
        *[_weighted(name).alias(f"weighted_{name}") for name in ("precision", "recall", "f1")],
        F.sum("support").alias("support"),
    )

    def line(name: Column, kind: str) -> Column:
        return F.struct(
            name.alias("label"),
            *[F.col(f"{kind}_{m}").alias(m) for m in ("precision", "recall", "f1")],
            F.col("support").alias("support"),
        )

    lines = F.when(
        F.col("is_total"),
        F.array(line(F.lit("macro avg"), "macro"), line(F.lit("weighted avg"), "weighted")),
    ).otherwise(F.array(line(label, "macro")))
    return rolled.select(F.inline(lines))


def stratified_split(
    df: DataFrame,
    label: str,
    row_id: str,
    share: float = HOLDOUT_SHARE,
    seed: int = HOLDOUT_SEED,
    labels: Sequence[str] = CLASS_ORDER,
) -> DataFrame:
    """Mark exactly ceil(share * n) rows of each class as `is_holdout`; `row_id` must be unique.

    Rows are drawn by the hash of seed and id. Ranking a whole class would put it into one task,
    so the rows are first counted per hash bucket; that table names, per class, the bucket in which
    the quota ends. Buckets below it are in, buckets above it are out, and only the rows of that
    one bucket are ranked.
    """
    rows = df.filter(F.col(label).isin(*labels)).withColumns(
        {"__draw": F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(row_id).cast("string")))}
    )
    rows = rows.withColumn("__bucket", F.substring("__draw", 1, _BUCKET_CHARS))
    # Bounded by classes x buckets, whatever the number of rows.
    sizes = rows.groupBy(F.col(label).alias("__label"), "__bucket").agg(
        F.count("*").alias("__size")
    )
    by_label = Window.partitionBy("__label")
    before = by_label.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    quota = F.ceil(F.sum("__size").over(by_label) * F.lit(share))
    ends = (
        sizes.withColumn("__before", F.coalesce(F.sum("__size").over(before), F.lit(0)))
        .withColumn("__quota", quota)
        .filter(
            (F.col("__before") < F.col("__quota"))
            & (F.col("__before") + F.col("__size") >= F.col("__quota"))
        )
        .select(
            "__label",
            F.col("__bucket").alias("__end"),
            (F.col("__quota") - F.col("__before")).alias("__left"),
        )
    )
    placed = rows.join(F.broadcast(ends), F.col(label) == F.col("__label"))
    inside = F.col("__bucket") == F.col("__end")
    settled = placed.filter(~inside).withColumn(
        "is_holdout", F.col("__bucket") < F.col("__end")
    )
    rank = F.row_number().over(Window.partitionBy(label).orderBy("__draw", row_id))
    ranked = placed.filter(inside).withColumn("is_holdout", rank <= F.col("__left"))
    extra = ("__draw", "__bucket", "__label", "__end", "__left")
    return settled.unionByName(ranked).drop(*extra)

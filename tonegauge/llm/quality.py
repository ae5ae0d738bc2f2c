"""Quality by naive Bayes support vectors over byte n-grams.

1. Features are indicators of byte n-grams (one to four bytes), hashed to `BUCKETS` numbers. They are taken
   from the whole text; an n-gram counts once per document.
2. Class counts of all features are summed over the training rows by Spark: per partition first, then by
   feature. The log-count ratio r of a feature compares its smoothed shares in the two classes.
3. Each document becomes the vector of its features' r, scaled to length one. A linear model with squared
   hinge loss is fitted to these by dual coordinate descent, on the features whose ratio is well founded.
4. The margin becomes a probability by a logistic curve over training rows that the fit did not see.

Training looks at `ROWS_PER_CLASS` labelled rows of either class at most, outside the held-out fold.
Scoring is one pass over whole texts with the weights (one per bucket) in the closure: no shuffle.

Edge cases: a null or empty text has no features and scores by the constant alone; null or other labels
and null ids are left out; ids labelled twice count once; without rows of both classes every score is 0.5.
Repeated rows score alike. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonegauge.llm.common import fold, small_batches, training_rows
from tonegauge.llm.toxicity import logistic

ROWS_PER_CLASS = 3000
BUCKETS = 1 << 17
ORDERS = (1, 2, 3, 4)
MIN_ROWS, KEPT = 8, 30_000  # features seen in fewer rows are left out; the strongest are kept
ALPHA, COST, EPOCHS = 1.0, 1.0, 15


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # svm weight times ratio, by bucket
    ratios: np.ndarray
    constant: float
    curve: tuple[float, float]


class Indicators:
    """Distinct n-gram buckets of a text, without sorting: the last writer of a bucket names it."""

    def __init__(self) -> None:
        self.slot = np.zeros(BUCKETS, np.int32)

    def __call__(self, text: str | None) -> np.ndarray:
        b = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
        found: list[np.ndarray] = []
        for at in range(0, len(b), 1 << 18):  # very long texts in stretches, each n-gram in one of them
            part = b[at : at + (1 << 18) + max(ORDERS) - 1].astype(np.uint32)
            starts = min(1 << 18, len(b) - at)
            code = np.zeros(len(part), np.uint32)
            pieces = []
            for n in ORDERS:
                if len(part) < n:
                    break
                code = (code[: len(part) - n + 1] << np.uint32(8)) | part[n - 1 :]
                mixed = (code + np.uint32(n * 0x3C6EF372)) * np.uint32(2654435761)
                pieces.append(((mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x85EBCA6B) >> np.uint32(15))[:starts])
            if pieces:
                found.append(self._distinct(np.concatenate(pieces)))
        if not found:
            return np.zeros(0, np.uint32)
        return found[0] if len(found) == 1 else self._distinct(np.concatenate(found))

    def _distinct(self, h: np.ndarray) -> np.ndarray:
        order = np.arange(len(h), dtype=np.int32)
        self.slot[h] = order
        return h[self.slot[h] == order]


def coordinate_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, size: int) -> np.ndarray:
    """Dual coordinate descent for the L2-regularised squared-hinge machine; the last weight is the constant."""
    w, alpha = np.zeros(size + 1), np.zeros(len(rows))
    diagonal = 0.5 / COST
    norms = np.array([float(v @ v) + 1.0 for v in values]) + diagonal
    draw = np.random.default_rng(7)
    for _ in range(EPOCHS):
        largest = 0.0
        for i in draw.permutation(len(rows)):
            at, v = rows[i], values[i]
            gradient = y[i] * (w[at] @ v + w[size]) - 1.0 + diagonal * alpha[i]
            if alpha[i] == 0.0 and gradient >= 0:
                continue
            new = max(alpha[i] - gradient / norms[i], 0.0)
            step = (new - alpha[i]) * y[i]
            largest = max(largest, abs(step))
            alpha[i] = new
            w[at] += step * v
            w[size] += step
        if largest < 1e-3:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", parts: int = 4, held_out: int = 2) -> Model | None:
    small_batches(docs.sparkSession)
    rows = training_rows(docs, labels, label, parts, held_out, ROWS_PER_CLASS, "quality")
    counts = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) < 2:
        return None

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        indicators, total = Indicators(), np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist()):
                total[y][indicators(text)] += 1
        used = np.flatnonzero(total.sum(0))
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[0][used]), pa.array(total[1][used])], ["f", "n0", "n1"])

    seen = rows.mapInArrow(counted, "f long, n0 long, n1 long").groupBy("f").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    total = np.zeros((2, BUCKETS))
    got = seen.where(F.col("n0") + F.col("n1") >= MIN_ROWS).toArrow()  # BUCKETS rows at most
    total[:, got.column("f").to_numpy()] = [got.column("n0").to_numpy(), got.column("n1").to_numpy()]
    # Shares of documents rather than of features: either class has about as many rows, not as much text.
    rate = (total + ALPHA) / (np.array([[counts[0]], [counts[1]]]) + 2 * ALPHA)
    ratio = np.where(total.sum(0) > 0, np.log(rate[1] / rate[0]), 0.0)
    keep = np.argsort(-np.abs(ratio), kind="stable")[:KEPT]
    ratio_kept = np.zeros(BUCKETS)
    ratio_kept[keep] = ratio[keep]
    held = np.flatnonzero(ratio_kept)
    place = np.full(BUCKETS, -1, np.int32)
    place[held] = np.arange(len(held), dtype=np.int32)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        indicators = Indicators()
        for batch in batches:
            f = [(lambda p: p[p >= 0])(place[indicators(t)]) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), batch.column("half"), pa.array(f, pa.list_(pa.int32()))], ["doc_id", "y", "half", "f"])

    sample = rows.mapInArrow(vectors, "doc_id long, y int, half int, f array<int>").orderBy("doc_id").toArrow()
    y = np.where(np.array(sample.column("y").to_pylist()) > 0, 1.0, -1.0)
    # Three rows in four fit the machine, one calibrates it.
    ids = np.array(sample.column("doc_id").to_pylist(), np.int64)
    fitting = (ids * 2654435761 >> 7) % 4 != 0
    r = ratio_kept[held]
    features = [np.asarray(x.values.to_numpy(zero_copy_only=False), np.int64) for c in sample.column("f").chunks for x in c]
    values = [r[f] / max(np.sqrt(float(r[f] @ r[f])), 1e-9) for f in features]
    chosen = np.flatnonzero(fitting)
    w = coordinate_descent([features[i] for i in chosen], [values[i] for i in chosen], y[chosen], len(held))
    margin = np.array([w[f] @ v + w[-1] for f, v in zip(features, values)])
    test = ~fitting if len(set(y[~fitting])) == 2 else fitting
    curve = logistic(margin[test][:, None], (y[test] > 0).astype(float), ridge=1e-2)
    weights = np.zeros(BUCKETS)
    weights[held] = w[:-1] * r
    return Model(weights.astype(np.float32), ratio_kept.astype(np.float32), float(w[-1]), (float(curve[0]), float(curve[1])))


def score(docs: DataFrame, model: Model | None, threshold: float = 0.7) -> DataFrame:
    """doc_id, score, predicted for every row."""
    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    if model is None:
        return rows.select("doc_id", F.lit(0.5).alias("score"), F.lit(0).alias("predicted"))
    sent = docs.sparkSession.sparkContext.broadcast((model.weights, model.ratios, model.constant, model.curve))  # two numbers per bucket

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        indicators = Indicators()
        weights, ratios, constant, curve = sent.value
        for batch in batches:
            margin = []
            for text in batch.column("text").to_pylist():
                f = indicators(text)
                r = ratios[f]
                margin.append(float(weights[f].sum(dtype=np.float64)) / max(float(np.sqrt((r * r).sum(dtype=np.float64))), 1e-9) + constant)
            s = 1.0 / (1.0 + np.exp(-np.clip(np.array(margin) * curve[0] + curve[1], -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return rows.mapInArrow(scored, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double, predicted int")


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    scored = score(docs, train(docs, labels))
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "score", "predicted")

"""Scoring, class labels, holdout and metrics."""

from __future__ import annotations

import sys

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import functions as F

from queries.base import DOC, EV, R6, STRIP, ev, labelled_doc, plain_doc, query, r6, rounded
from queries.text import HASHED
from tonegauge.functions.hashing import headline_hash
from tonegauge.functions.probabilities import CLASS_ORDER, argmax_label
from tonegauge.operators import evaluation as E
from tonegauge.operators import scoring as S
from tonegauge.operators.bayes import BayesModel, score_bayes, train_bayes
from tonegauge.operators.training import evaluate_stored, train_classifier
from tonegauge.schemas import columns
from tonegauge.session import balanced, materialise, run_dir
from tonegauge.sources.bucketed import BucketedTable
from tonegauge.sources.models import ModelStore

# The predictor travels to the workers by value: they need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def vowel_model():
    """A stand-in for a user's classifier: softmax of the shares of e, a and o in the whole text."""

    def predict(texts: np.ndarray) -> np.ndarray:
        texts = np.array(texts, dtype=np.dtypes.StringDType())
        size = np.maximum(np.strings.str_len(texts), 1)
        weights = np.exp(10.0 * np.stack([np.strings.count(texts, letter) for letter in "eao"], axis=-1) / size[:, None])
        return weights / weights.sum(axis=1, keepdims=True)

    return predict


def SHARE(letter: str) -> str:
    return (
        f"exp(10.0 * (length(headline) - length(replace(headline, '{letter}', '')))"
        " / CAST(greatest(length(headline), 1) AS DOUBLE))"
    )


VOWELS = f"""
e AS (SELECT *, {SHARE('e')} AS x, {SHARE('a')} AS y, {SHARE('o')} AS z FROM doc),
p AS (SELECT *, x / (x + y + z) AS pp, y / (x + y + z) AS pn, z / (x + y + z) AS pu FROM e),
scored AS (
  SELECT *, CASE WHEN pp >= pn AND pp >= pu THEN 'positive' WHEN pn >= pu THEN 'negative'
                 ELSE 'neutral' END AS predicted_label FROM p)"""
SCORED_OUT = (
    f"doc_id, {R6('pp', 'prob_positive')}, {R6('pn', 'prob_negative')}, {R6('pu', 'prob_neutral')}, "
    f"predicted_label, {R6('greatest(pp, pn, pu)', 'confidence')}, {R6('pp - pn', 'sentiment_score')}"
)
SCORES = ("prob_positive", "prob_negative", "prob_neutral", "confidence", "sentiment_score")


def scored_out(df):
    return rounded(df.select("doc_id", *SCORES, "predicted_label"), *SCORES)


@query("score_batch", f"WITH {DOC}, {VOWELS} SELECT {SCORED_OUT} FROM scored")
def _score_batch(spark, sf):
    rows = balanced(plain_doc(spark, sf).select("doc_id", "headline"))
    return scored_out(S.score_batch(rows, vowel_model))


@query(
    "score_incremental",
    f"""WITH {DOC}, {VOWELS} SELECT {SCORED_OUT} FROM scored
    WHERE {HASHED(STRIP('headline'))} NOT IN (SELECT {HASHED(STRIP('headline'))} FROM stored)""",
)
def _score_incremental(spark, sf):
    key = headline_hash(F.col("headline")).alias("headline_hash")
    incoming = plain_doc(spark, sf).select("doc_id", "headline", key)
    stored = labelled_doc(spark, sf).select(key)
    return scored_out(
        S.score_incremental(incoming, stored, lambda new: S.score_batch(new, vowel_model))
    )


@query(
    "score_incremental_bucketed",
    f"""WITH {DOC}, {VOWELS} SELECT {SCORED_OUT} FROM scored
    WHERE {HASHED(STRIP('headline'))} NOT IN (SELECT {HASHED(STRIP('headline'))} FROM stored)""",
)
def _score_incremental_bucketed(spark, sf):
    """The stored keys lie in buckets; only the incoming rows are shuffled."""
    key = headline_hash(F.col("headline")).alias("headline_hash")
    path = run_dir(spark, "scored-keys")
    name = "scored_keys_" + path.rsplit("-", 1)[-1]
    stored = BucketedTable(spark, name, path, columns(headline_hash="string"), "headline_hash", 16)
    stored.append(labelled_doc(spark, sf).select(key))
    incoming = plain_doc(spark, sf).select("doc_id", "headline", key)
    return scored_out(S.score_batch(stored.only_new(incoming), vowel_model))


@query(
    "score_columns",
    f"""WITH {EV} SELECT event_id, {R6('prob_positive', 'prob_positive')},
    {R6('prob_negative', 'prob_negative')}, {R6('prob_neutral', 'prob_neutral')},
    CASE WHEN prob_neutral >= prob_positive AND prob_neutral >= prob_negative THEN 'neutral'
         WHEN prob_positive >= prob_negative THEN 'positive' ELSE 'negative' END AS predicted_label,
    {R6('greatest(prob_positive, prob_negative, prob_neutral)', 'confidence')},
    {R6('prob_positive - prob_negative', 'sentiment_score')} FROM ev""",
)
def _score_columns(spark, sf):
    # The class order of this array differs from the default on purpose; ties go to its first class.
    probabilities = F.array("prob_neutral", "prob_positive", "prob_negative")
    rows = ev(spark, sf).select("event_id", probabilities.alias("p"))
    scored = S.score_columns(rows, F.col("p"), ("neutral", "positive", "negative")).drop("p")
    return rounded(scored, *SCORES)


@query("argmax_label", f"WITH {EV} SELECT event_id, model_label AS label FROM ev")
def _argmax_label(spark, sf):
    probabilities = F.array("prob_positive", "prob_negative", "prob_neutral")
    return ev(spark, sf).select("event_id", argmax_label(probabilities).alias("label"))


@query(
    "stratified_split",
    f"""WITH {EV}, d AS (
      SELECT event_id, predicted_label,
             row_number() OVER (PARTITION BY predicted_label ORDER BY md5('42|' || event_id), event_id) AS i,
             count(*) OVER (PARTITION BY predicted_label) AS n FROM ev)
    SELECT event_id, predicted_label, i <= ceil(n * CAST(0.15 AS DOUBLE)) AS is_holdout FROM d""",
)
def _stratified_split(spark, sf):
    rows = ev(spark, sf).select("event_id", "predicted_label")
    return E.stratified_split(rows, "predicted_label", "event_id")


CLASS_SCORES = f"""
pairs AS (SELECT predicted_label AS truth, model_label AS predicted, count(*) AS n FROM ev GROUP BY 1, 2),
labels3 AS (SELECT DISTINCT truth AS label FROM pairs UNION SELECT DISTINCT predicted FROM pairs),
sums AS (
  SELECT label,
    (SELECT coalesce(sum(n), 0) FROM pairs WHERE truth = label AND predicted = label) AS hits,
    (SELECT coalesce(sum(n), 0) FROM pairs WHERE truth = label) AS support,
    (SELECT coalesce(sum(n), 0) FROM pairs WHERE predicted = label) AS claimed FROM labels3),
scores AS (
  SELECT label, CAST(support AS BIGINT) AS support, hits,
    coalesce(CAST(hits AS DOUBLE) / nullif(claimed, 0), 0.0) AS p,
    coalesce(CAST(hits AS DOUBLE) / nullif(support, 0), 0.0) AS r,
    coalesce(CAST(hits AS DOUBLE) * 2 / nullif(claimed + support, 0), 0.0) AS f FROM sums)"""


@query(
    "classification_metrics",
    f"""WITH {EV}, {CLASS_SCORES}
    SELECT round_even(CAST(sum(hits) AS DOUBLE) / sum(support), 4) AS accuracy,
           round_even(avg(f), 4) AS macro_f1,
           round_even(sum(f * support) / sum(support), 4) AS weighted_f1 FROM scores""",
)
def _classification_metrics(spark, sf):
    return E.classification_metrics(ev(spark, sf), "predicted_label", "model_label")


REPORT = f"""SELECT label, {R6('p', 'precision')}, {R6('r', 'recall')}, {R6('f', 'f1')}, support FROM scores
    UNION ALL SELECT 'macro avg', {R6('avg(p)', 'p')}, {R6('avg(r)', 'r')}, {R6('avg(f)', 'f')},
      CAST(sum(support) AS BIGINT) FROM scores
    UNION ALL SELECT 'weighted avg', {R6('sum(p * support) / sum(support)', 'p')},
      {R6('sum(r * support) / sum(support)', 'r')}, {R6('sum(f * support) / sum(support)', 'f')},
      CAST(sum(support) AS BIGINT) FROM scores"""


@query(
    "classification_report",
    f"""WITH {EV}, {CLASS_SCORES}
    {REPORT}""",
)
def _classification_report(spark, sf):
    report = E.classification_report(ev(spark, sf), "predicted_label", "model_label")
    return rounded(report, "precision", "recall", "f1")


def _split_documents(spark, sf):
    return materialise(
        E.stratified_split(labelled_doc(spark, sf), "true_label", "doc_id"), "split"
    )


# The split and the word counts by class of its training part, as in the operators.
BAYES = f"""{DOC}, d AS (
  SELECT *, row_number() OVER (PARTITION BY true_label ORDER BY md5('42|' || doc_id), doc_id)
              <= ceil(count(*) OVER (PARTITION BY true_label) * CAST(0.15 AS DOUBLE)) AS is_holdout FROM stored),
classes AS (
  SELECT c.label, c.position, count(d.doc_id) AS documents, sum(count(d.doc_id)) OVER () AS total
  FROM (VALUES ('positive', 0), ('negative', 1), ('neutral', 2)) c(label, position)
  LEFT JOIN d ON d.true_label = c.label AND NOT is_holdout GROUP BY ALL),
said AS (SELECT true_label, unnest(string_split_regex(lower(headline), '[^\\p{{L}}\\p{{N}}]+')) AS word FROM d WHERE NOT is_holdout),
counts AS (SELECT word, true_label AS label, count(*) AS n FROM said WHERE word <> '' GROUP BY ALL),
vocabulary AS (SELECT DISTINCT word FROM counts),
sizes AS (
  SELECT label, position, documents, total, coalesce((SELECT sum(n) FROM counts c WHERE c.label = k.label), 0)
           + (SELECT count(*) FROM vocabulary) AS under FROM classes k),
asked AS (
  SELECT doc_id, word, count(*) AS n
  FROM (SELECT doc_id, unnest(string_split_regex(lower(headline), '[^\\p{{L}}\\p{{N}}]+')) AS word FROM doc)
  WHERE word IN (SELECT word FROM vocabulary) GROUP BY ALL),
logs AS (
  SELECT a.doc_id, k.label, sum(a.n * ln((coalesce(c.n, 0) + 1.0) / CAST(k.under AS DOUBLE))) AS l
  FROM asked a CROSS JOIN sizes k LEFT JOIN counts c ON c.word = a.word AND c.label = k.label GROUP BY ALL),
best AS (
  SELECT doc.doc_id, k.label AS predicted_label,
         row_number() OVER (PARTITION BY doc.doc_id
                            ORDER BY coalesce(l, 0) + ln(documents / CAST(total AS DOUBLE)) DESC, position) AS i
  FROM doc CROSS JOIN sizes k LEFT JOIN logs ON logs.doc_id = doc.doc_id AND logs.label = k.label
  WHERE documents > 0)"""


@query(
    "train_classifier",
    f"WITH {BAYES} SELECT doc_id, predicted_label FROM best WHERE i = 1",
)
def _train_classifier(spark, sf):
    """Every document labelled by naive Bayes counted on the training part of the labelled ones."""
    model = train_bayes(_split_documents(spark, sf).filter(~F.col("is_holdout")))
    rows = plain_doc(spark, sf).select("doc_id", "headline")
    return score_bayes(rows, model, "doc_id").select("doc_id", "predicted_label")


@query(
    "evaluate_model",
    f"""WITH {BAYES},
    {CLASS_SCORES.replace("predicted_label AS truth, model_label AS predicted, count(*) AS n FROM ev", "true_label AS truth, predicted_label AS predicted, count(*) AS n FROM d JOIN (SELECT doc_id, predicted_label FROM best WHERE i = 1) USING (doc_id) WHERE is_holdout")}
    {REPORT}""",
)
def _evaluate_model(spark, sf):
    """Report on the held-out labelled documents by a stored model that another session has loaded."""
    split = _split_documents(spark, sf)
    path = run_dir(spark, "models")
    train_bayes(split.filter(~F.col("is_holdout"))).save(ModelStore(spark, path))
    other = spark.newSession()
    model = BayesModel.load(ModelStore(other, path))
    holdout = _split_documents(other, sf).filter("is_holdout")
    scored = score_bayes(holdout.select("doc_id", "headline", "true_label"), model, "doc_id")
    return rounded(E.classification_report(scored, "true_label"), "precision", "recall", "f1")


@query("train_regression")
def _train_regression(spark, sf):
    """Every document scored by a regression fitted on the training part of the labelled ones."""
    train = _split_documents(spark, sf).filter(~F.col("is_holdout"))
    model = train_classifier(train)
    scored = S.score_with_model(plain_doc(spark, sf), model)
    return scored.select("doc_id", "predicted_label", r6("sentiment_score", "sentiment_score"))


@query("evaluate_regression")
def _evaluate_regression(spark, sf):
    """Report on the held-out labelled documents by a stored and reloaded regression."""
    split = _split_documents(spark, sf)
    store = ModelStore(spark, run_dir(spark, "models"))
    store.save(CLASS_ORDER, pipeline=train_classifier(split.filter(~F.col("is_holdout"))))
    report = evaluate_stored(store, split.filter("is_holdout"))
    return rounded(report, "precision", "recall", "f1")

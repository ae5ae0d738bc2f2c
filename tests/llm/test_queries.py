"""The registered queries of the package at the smallest scale, with SQL where they have it, and the pipeline."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
import corpus_pipeline
from tests.llm.test_operators import SCHEMA, prose
from tonegauge.llm import embeddings, mixing, toxicity
from tonegauge.llm.queries import QUERIES, SQL
from tools.check_oracle import compare, connect

SMALL = "/root/testdata/sf0.001"


def test_all_queries_are_registered():
    assert {*QUERIES, "pipeline"} <= set(contract.queries()) and set(SQL) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    problem = compare(QUERIES[name](spark, SMALL), connect(SMALL), SQL[name])
    assert problem is None, problem


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_has_rows(spark, name):
    assert QUERIES[name](spark, SMALL).count() > 0


def test_toxicity_without_a_marked_word(spark):
    """Both classes use the same words: nothing is marked, and every document has a score."""
    r = random.Random(3)
    texts = [prose(r, 30) for _ in range(120)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0, "x", "x", "x", "x") for i, t in enumerate(texts)], SCHEMA)
    labels = spark.createDataFrame([(i, i % 2) for i in range(120)], "doc_id long, toxic int")
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == 120 and all(0 <= row["score"] <= 1 for row in got)


def test_near_duplicates_around_one_direction(spark):
    """Most of a walk's cells hold such vectors, so short walks lose links."""
    r = np.random.default_rng(2)
    base = r.normal(size=64)
    x = base / np.linalg.norm(base) + 0.033 * r.normal(size=(1200, 64)) * np.linspace(0.3, 1.4, 64)
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x.astype(np.float32))]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    unit = x.astype(np.float32).astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    cos = unit @ unit.T
    links = (cos >= embeddings.LIMIT).sum(1) - 1
    got = {row["vec_id"]: row["n_links"] for row in embeddings.near_duplicates(frame).collect()}
    found = sum(got.values())
    assert links.sum() > 500 and 0.9 * links.sum() <= found <= links.sum()
    assert all(got[i] <= links[i] for i in got)


def test_pipeline_keeps_documents_apart_under_null_and_repeated_ids(spark, tmp_path):
    r = random.Random(9)
    own = [prose(r, 60) for _ in range(12)]
    documents = [(i, own[i]) for i in range(6)] + [(None, own[6]), (None, own[7]), (3, own[8]), (20, own[0]), (None, own[1])]
    frame = spark.createDataFrame([(i, t, "en", "ab"[k % 2], len(t)) for k, (i, t) in enumerate(documents)], "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = corpus_pipeline.near_dedup(spark, frame, str(tmp_path))
    assert sorted(row["text"] for row in kept.collect()) == sorted({t for _, t in documents})
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert packed.count() > 0 and packed.select("sequence_id").distinct().count() >= 1
    assert packed.agg(F.max(F.col("offset") + F.col("length"))).first()[0] <= 2048


def test_mixing_solves_the_dual_and_takes_equal_rows_apart(spark):
    """Rates against bisection of each source's constraint; rows of one id, or of none, are rows of their own."""
    r = random.Random(4)
    rows = [(None, "a b c d e", "x")] * 300 + [(7, "a b c", "x")] * 300 + [(i, prose(r, r.randint(1, 80)), "yyz"[i % 3]) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mixed(mixing.numbered(docs)).collect()
    for source in "xyz":
        mine = [g for g in got if g["source"] == source]
        target = mine[0]["target"]
        low, high = -5.0, 5.0
        met = lambda m: sum(g["size"] * min(np.exp(min(m * g["size"], 5.0)), mixing.CEILING) for g in mine)
        for _ in range(200):
            middle = (low + high) / 2
            low, high = (middle, high) if met(middle) < target else (low, middle)
        for g in mine:
            assert g["rate"] == pytest.approx(min(np.exp(min(low * g["size"], 5.0)), mixing.CEILING), rel=1e-5)
            assert abs(g["copies"] - g["rate"]) <= 1 and g["copies"] <= mixing.CEILING
        assert abs(sum(g["size"] * g["copies"] for g in mine) - target) <= 40
    repeated = mixing.repeat_documents(docs)
    taken = {}
    for row in repeated.collect():
        taken[row["source"]] = taken.get(row["source"], 0) + len(row["text"].split())
    for source in "xyz":
        assert taken[source] == sum(g["size"] * g["copies"] for g in got if g["source"] == source)

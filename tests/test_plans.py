"""What the physical plans must and must not contain."""

from __future__ import annotations

import re

import pytest

import __spark_entry__ as contract
from queries import REGISTRY
from tonegauge.schemas import columns
from tonegauge.sources.bucketed import BucketedTable

SMALL = "/root/testdata/sf0.001"
PYTHON = {"score_batch", "score_incremental", "score_incremental_bucketed"}
# Queries that return what a job has written: their plan is a plain scan.
EAGER = {"evaluate_model", "evaluate_regression", "train_regression", "full_run_repeated", "full_run_feeds", "full_run_legacy_stored"}


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


# Queries of the optional part have tests of their own.
LAZY = [n for n in REGISTRY if not n.startswith(("stream_", "full_run_stored")) and n not in EAGER]


@pytest.mark.parametrize("name", LAZY)
def test_no_nested_loops_and_no_python_outside_scoring(spark, name):
    text = plan(contract.queries()[name](spark, SMALL))
    assert "NestedLoop" not in text and "Cartesian" not in text
    assert ("EvalPython" in text) == (name in PYTHON)


def test_risk_summary_reads_once_and_shuffles_raw_rows_once(spark):
    text = plan(contract.queries()["risk_summary"](spark, SMALL))
    assert text.count("FileScan") == 1 and "Join" not in text
    assert len(re.findall(r"Exchange hashpartitioning", text)) == 2
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint,event_type:string,value:double>" in text


@pytest.mark.parametrize(
    "name", ["clean_articles", "dedup_ingest_key", "dedup_fuzzy_fingerprint", "cap_per_entity", "ingest_feed"]
)
def test_hot_keys_are_cut_before_the_shuffle(spark, name):
    text = plan(contract.queries()[name](spark, SMALL))
    assert re.search(r"WindowGroupLimit .* Partial", text)


def test_filters_reach_the_scan(spark):
    text = plan(contract.queries()["filter_recent"](spark, SMALL))
    assert "PushedFilters: [IsNotNull(ts), LessThanOrEqual(ts" in text and "GreaterThan(ts" in text
    text = plan(contract.queries()["read_by_entity"](spark, SMALL))
    assert "EqualTo(entity,error)" in text


def test_stored_keys_in_buckets_are_not_shuffled(spark, tmp_path):
    table = BucketedTable(spark, "plan_test_keys", f"file://{tmp_path}/keys", columns(k="string"), "k", 16)
    frame = lambda *names: spark.createDataFrame([(n,) for n in names], "k string")
    table.append(frame(*[f"k{i}" for i in range(100)]))
    table.append(frame(*[f"m{i}" for i in range(100)]))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for a table too large to be sent around
    try:
        found = table.only_new(frame("k1", "m99", "new", None))
        text = plan(found)
        assert {r["k"] for r in found.collect()} == {"new", None}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    stored = text[text.index("FileScan") - 400 : text.index("FileScan")]
    assert "SortMergeJoin" in text and text.count("Exchange hashpartitioning") == 1 and "Exchange" not in stored.split("+- ")[-1]
    assert "Bucketed: true" in text
    again = BucketedTable(spark.newSession(), "plan_test_keys_again", f"file://{tmp_path}/keys", columns(k="string"), "k", 16)
    assert again.read().count() == 200

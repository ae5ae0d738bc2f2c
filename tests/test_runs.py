"""Stored runs: death after every step, feed input, versions and parts of tables, stored models."""

from __future__ import annotations

from dataclasses import replace
from datetime import date

import pytest
from pyspark.sql import functions as F

from queries.composite import Died, DyingJournal
from tests.conftest import rows
from tonegauge.operators.bayes import BayesModel, score_bayes, train_bayes
from tonegauge.operators.risk import risk_summary_direct
from tonegauge.operators.scoring import score_columns
from tonegauge.plans.journal import RunJournal
from tonegauge.plans.runs import STEPS, StoredRun, run_legacy_stored
from tonegauge.schemas import columns
from tonegauge.sources.models import ModelStore
from tonegauge.sources.tables import TableStore

ARTICLE = columns(entity="string", date="date", headline="string", source="string", true_label="string")
RISK = ("entity", "total_headlines", "composite_risk_score", "anomaly_days")
AS_OF = "2024-01-31"


def articles(spark, numbers):
    data = [(f"e{i % 3}", date(2024, 1, 1 + i % 20), f"A headline with number {i:03d}", "s", "") for i in numbers]
    return spark.createDataFrame(data, ARTICLE)


class Model:
    """Counts the rows it has scored."""

    def __init__(self, spark):
        self.rows = spark.sparkContext.accumulator(0)

    def __call__(self, df):
        p = (F.char_length("headline") % 10 + F.dayofmonth("date") % 3) / F.lit(20.0)
        return score_columns(df, F.array(p, F.lit(1.0) - p, F.lit(0.0)))


def expected(spark, numbers):
    scored = Model(spark)(articles(spark, numbers))
    weight = F.pow(F.lit(0.5), F.datediff(F.lit(AS_OF).cast("date"), "date") / F.lit(3.0))
    return risk_summary_direct(scored.withColumn("time_weight", weight))


@pytest.mark.parametrize("noted", [False, True])
def test_a_run_that_dies_after_any_step_is_finished_by_the_next(spark, tmp_path, noted):
    class Dying(DyingJournal):
        """With `noted` the run ends behind the note of the step, else in front of it."""

        def enter(self, run, step, mark=""):
            if noted and step == self.fatal:
                RunJournal.enter(self, run, step, mark)
                raise Died(step)
            return super().enter(run, step, mark)

    for step in STEPS[::3] if noted else STEPS:
        store = TableStore(spark, f"{tmp_path}/{step}")
        run = StoredRun.of_articles(store, Model(spark), [F.col("headline")], as_of=AS_OF)
        run(articles(spark, range(30)))
        journal = Dying(run.journal)
        journal.fatal = step
        with pytest.raises(Died):
            replace(run, journal=journal)(articles(spark, range(20, 60)))
        # What comes in now is something else; the run that died goes on from its own arrivals.
        arrived = step != STEPS[0] or noted
        run(articles(spark, range(55, 70)))
        numbers = range(70) if arrived else [*range(30), *range(55, 70)]
        assert rows(run.result().summary, *RISK) == rows(expected(spark, numbers), *RISK)
        scored = run.result().scored
        assert scored.count() == len(numbers) == scored.select("headline_hash").distinct().count()
        assert store.read("news_articles").count() == len(numbers)
        assert len(store.versions("risk_summary")) <= 2


def test_stored_articles_without_a_score_are_scored(spark, tmp_path):
    store = TableStore(spark, str(tmp_path))
    run = StoredRun.of_articles(store, Model(spark), [F.col("headline")], as_of=AS_OF)
    run(articles(spark, range(10)))
    stray = articles(spark, range(10, 15))
    store.insert_articles(stray.withColumn("score_key", F.md5(F.lower("headline"))), part="by-hand")
    run(articles(spark, range(3)))
    assert run.result().scored.count() == 15


def test_a_run_reads_and_shuffles_each_table_once(spark, tmp_path):
    plans = {}

    class Store(TableStore):
        def append(self, name, new, part=None):
            plans.setdefault(name, []).append(new._jdf.queryExecution().executedPlan().toString())
            return super().append(name, new, part)

    store = Store(spark, str(tmp_path))
    run = StoredRun.of_articles(store, Model(spark), [F.col("headline")], as_of=AS_OF)
    run(articles(spark, range(10)))
    run(articles(spark, range(5, 15)))
    # Nothing was stored in front of the first run: nothing is joined or shuffled. Later, both sides of the anti join.
    assert [p.count("Exchange") for p in plans["news_articles"]][0] == 0 == [p.count("Join") for p in plans["scored_headlines"]][0]
    assert plans["scored_headlines"][1].count("Scan parquet") <= 2 and plans["scored_headlines"][1].count("LeftAnti") == 1
    assert "LeftSemi" not in plans["scored_headlines"][1]
    assert run.result().scored.count() == 15


def test_journal_numbers_runs_and_keeps_marks(spark, tmp_path):
    journal = RunJournal(spark, f"{tmp_path}/runs", ("a", "b"))
    run = journal.current()
    assert (run.number, run.done, journal.newest()) == (0, {}, None)
    run = journal.enter(run, "a", "mark")
    assert journal.current() == run and run.done == {"a": "mark"}
    with pytest.raises(FileExistsError):
        journal.enter(run, "a")
    journal.step(run, "b", lambda: None)
    assert journal.current().number == 1 and journal.newest().done == {"a": "mark", "b": ""}


def test_appends_are_parts_and_a_part_is_written_again_without_harm(spark, tmp_path):
    store = TableStore(spark, str(tmp_path), {"t": columns(n="long")})
    frame = lambda *n: spark.createDataFrame([(x,) for x in n], "n long")
    store.replace("t", frame(1))
    files = set(store.read("t").inputFiles())
    for _ in range(2):
        assert store.append("t", frame(2, 3), "run-1") == 2
    assert rows(store.read("t")) == [(1,), (2,), (3,)] and files < set(store.read("t").inputFiles())
    assert rows(store.read("t", without="run-1")) == [(1,)]
    assert store.append("t", frame(), "empty") == 0
    # A part without its marker does not exist for readers.
    frame(9).write.parquet(f"{store.path('t')}/part=half")
    assert store.read("t").count() == 3
    for n in range(4, 7):
        store.replace("t", frame(n))
    assert store.retire("t") == [0, 1] and rows(store.read("t")) == [(6,)]


def test_legacy_run_saves_its_tables(spark, tmp_path):
    store = TableStore(spark, str(tmp_path))
    raw = articles(spark, range(40)).withColumn("source", F.when(F.col("entity") == "e0", "phrasebank").otherwise("s"))
    result = run_legacy_stored(store, raw, Model(spark), AS_OF)
    assert result.scored.count() == 40 and {r.entity for r in result.summary.collect()} == {"e1", "e2"}
    assert all(store.path(name) for name in ("scored_headlines", "temporal_risk", "risk_summary", "source_summary"))


def test_bayes_against_counts_by_hand_and_through_a_store(spark, tmp_path):
    data = [(1, "good good day", "positive"), (2, "bad day", "negative"), (3, "Good news", "positive"), (4, None, "negative"), (5, "x", "other")]
    frame = spark.createDataFrame(data, "id long, headline string, true_label string")
    model = train_bayes(frame)
    assert (model.labels, model.documents, model.tokens, model.vocabulary) == (("positive", "negative", "neutral"), (2, 2, 0), (5, 2, 0), 4)
    store = ModelStore(spark, f"{tmp_path}/models")
    with pytest.raises(FileNotFoundError):
        store.load()
    assert model.save(store) == 1 and model.save(store) == 2 and store.versions() == [1, 2]
    loaded = BayesModel.load(ModelStore(spark.newSession(), f"{tmp_path}/models"), 1)
    assert loaded.labels == model.labels and loaded.tokens == model.tokens
    asked = spark.createDataFrame([(1, "GOOD, bad!"), (2, ""), (3, None), (4, "unheard of"), (5, "bad bad")], "id long, headline string")
    got = {r["id"]: r for r in score_bayes(asked, model, "id").collect()}
    positive, negative = (3 + 1) / (5 + 4) * (0 + 1) / (5 + 4), (0 + 1) / (2 + 4) * (1 + 1) / (2 + 4)
    assert got[1]["prob_positive"] == pytest.approx(positive / (positive + negative)) and got[1]["prob_neutral"] == 0.0
    assert [got[i]["predicted_label"] for i in (2, 3, 4, 5)] == ["positive", "positive", "positive", "negative"]
    assert all(got[i]["prob_positive"] == 0.5 for i in (2, 3, 4))

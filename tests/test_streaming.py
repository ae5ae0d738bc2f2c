from __future__ import annotations

import re
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tonegauge.functions.hashing import headline_hash
from tonegauge.operators.risk import risk_summary_direct
from tonegauge.operators.scoring import score_columns
from tonegauge.operators.temporal import daily_rollup, temporal_risk
from tonegauge.schemas import columns
from tonegauge.config import LEGACY as J_LEGACY
from tonegauge.sources.feeds import read_payload_files
from tonegauge.sources.seen import SeenKeys
from tonegauge.streaming import jobs as J
from tonegauge.streaming.batchlog import BatchLog
from tonegauge.streaming.series_state import partial_days

START = datetime(2024, 1, 1)
SCORED = columns(
    entity="string", date="date", sentiment_score="double", predicted_label="string"
)


def scored(spark, n=400):
    data = [
        (
            "hot" if i % 3 == 0 else f"e{i % 5}",
            (START + timedelta(hours=5 * i)).date(),
            ((i * 37) % 21 - 10) / 10,
            ["negative", "positive", "neutral"][i % 3],
        )
        for i in range(n)
    ]
    return spark.createDataFrame(data, SCORED)


def play(spark, folder, state, *parts):
    """Land one part after the other and let the stream catch up, each time as a new start from its checkpoint."""
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(f"{folder}/landed")
        stream = spark.readStream.schema(part.schema).parquet(f"{folder}/landed")
        J.drain(state.writer(stream), f"{folder}/checkpoint")


def same_series(found, expected):
    left = {(r.entity, r.date): r for r in found.collect()}
    for r in expected.collect():
        other = left.pop((r.entity, r.date))
        assert other.anomaly_flag == r.anomaly_flag
        for name in ("daily_avg_sentiment", "rolling_mean", "rolling_std", "z_score"):
            assert other[name] == (r[name] if r[name] is None else pytest.approx(r[name], abs=1e-9))
    assert not left


def weighted(data, as_of):
    return data.withColumn("time_weight", J.half_life_weight(F.col("date"), as_of))


RISK = ("entity", "total_headlines", "composite_risk_score", "anomaly_days", "risk_tier")


def test_risk_stream_equals_batch_also_for_late_days_and_after_restarts(spark, folder):
    data = scored(spark)
    late = "date between '2024-01-08' and '2024-01-12'"
    parts = [data.filter(c) for c in (f"date < '2024-01-20' and not {late}", "date between '2024-01-20' and '2024-02-20'", late, "date > '2024-02-20'")]
    for as_of in ("2024-01-01", "2024-03-31"):
        state = J.RiskStream(spark, f"{folder}/{as_of}", as_of)
        play(spark, f"{folder}/{as_of}", state, *parts)
        same_series(state.temporal(), temporal_risk(data))
        expected = risk_summary_direct(weighted(data, as_of))
        assert rows(state.summary(as_of), *RISK) == rows(expected, *RISK)
        touched = {r.entity for r in state.days("entity").collect()}
        assert touched == {"hot", *(f"e{i}" for i in range(5))}
        lines = rows(J.alerts(expected), "entity", "composite_risk_score", "alert_line")
        assert rows(state.current_alerts()) == lines


def test_a_batch_reads_nothing_that_an_earlier_one_wrote(spark, folder, monkeypatch):
    state = J.RiskStream(spark, folder, "2024-01-01")
    data = scored(spark, 100)
    read = []
    monkeypatch.setattr(BatchLog, "read", lambda self, *a, **k: read.append(self.path))
    play(spark, folder, state, data.filter("date < '2024-01-10'"), data.filter("date >= '2024-01-10'"))
    assert read == []


def test_a_batch_run_again_changes_nothing(spark, folder):
    data = scored(spark, 200)
    state = J.RiskStream(spark, folder, "2024-01-01")
    play(spark, folder, state, data)
    before = (rows(state.temporal()), rows(state.summary()), rows(state.current_alerts()))
    again = state.series.read_batch(0).cache()
    again.count()
    state.land(again, 0)
    assert (rows(state.temporal()), rows(state.summary()), rows(state.current_alerts())) == before


def test_closed_days_keep_their_share_and_later_rows_come_out_as_late(spark, folder):
    data = scored(spark, 300)
    as_of = "2024-03-15"
    parts = [data.filter(f"date >= date_add('2024-01-01', {k}) and date < date_add('2024-01-01', {k + 12})") for k in range(0, 72, 12)]
    state = J.RiskStream(spark, folder, as_of, keep_days=3)
    stray = data.filter("date = '2024-01-05'")
    play(spark, folder, state, *parts, stray)
    same_series(state.temporal(), temporal_risk(data))
    assert state.late().agg(F.sum("headlines")).first()[0] == stray.count()
    # The totals that the state carried on, not the logged sums.
    newest = J.first_per_key(state.days("entity"), ["entity"], [F.desc("batch_id")])
    carried = J.finish_summary(J.totals_with_shares(newest, state.config.profile))
    assert rows(carried, *RISK) == rows(risk_summary_direct(weighted(data, as_of)), *RISK)


def test_rows_without_a_day_count_but_make_no_series(spark, folder):
    extra = spark.createDataFrame([("e1", None, 0.5, "negative"), (None, date(2024, 1, 2), 0.5, "negative"), ("e1", date(2024, 1, 3), None, None)], SCORED)
    data = scored(spark, 60).unionByName(extra)
    state = J.RiskStream(spark, folder, "2024-02-01")
    play(spark, folder, state, data)
    expected = risk_summary_direct(weighted(data, "2024-02-01"))
    assert rows(state.summary(), *RISK) == rows(expected, *RISK)
    same_series(state.temporal(), temporal_risk(data))
    with pytest.raises(ValueError):
        J.RiskStream(spark, folder, config=J.EngineConfig(profile=J_LEGACY))


def test_compaction_changes_nothing(spark, tmp_path):
    data = scored(spark)
    cut = F.col("date") < "2024-02-01"
    state = J.RiskStream(spark, f"{tmp_path}/a", "2024-01-01")
    play(spark, f"{tmp_path}/a", state, data.filter(cut), data.filter(~cut))
    smaller = state.compacted(f"{tmp_path}/b", 1)
    assert rows(smaller.temporal()) == rows(state.temporal())
    assert rows(smaller.summary(), *RISK) == rows(state.summary(), *RISK)
    assert rows(smaller.current_alerts()) == rows(state.current_alerts())
    more = data.withColumn("date", F.date_add("date", 100))
    play(spark, f"{tmp_path}/a", smaller, more)  # goes on from the same checkpoint
    same_series(smaller.temporal(), temporal_risk(data.unionByName(more)))


def test_partial_sums_leave_little_to_shuffle(spark):
    data = scored(spark, 400).coalesce(1)
    sums = partial_days(data)
    assert sums.count() == data.select("entity", "date").distinct().count()
    total = sums.agg(F.sum("headlines"), F.sum("negatives"), F.sum("value_count")).first()
    assert tuple(total) == (400, data.filter("predicted_label = 'negative'").count(), 400)


def test_batch_log_overwrites_its_own_batch_only(spark, folder):
    log = BatchLog(spark, folder, columns(k="string", n="long"))
    assert log.read().count() == 0
    frame = lambda *pairs: spark.createDataFrame(list(pairs), "k string, n long")
    log.write(frame(("a", 1), ("b", 1)), 0)
    log.write(frame(("a", 2), ("a", 3)), 1)
    log.write(frame(("a", 2), ("a", 3)), 1)
    assert log.read().count() == 4 and log.read(before=1).count() == 2
    assert rows(log.latest_batch_rows(["k"])) == [("a", 2), ("a", 3), ("b", 1)]


def test_dedup_forever_over_replayed_batches(spark, folder):
    log, seen = BatchLog(spark, f"{folder}/log", columns(id="long", k="string", m="string")), SeenKeys(spark, f"{folder}/seen", 4, 2)
    handle = J.dedup_forever(log, seen, ["k", "m"], [F.col("id")])
    frame = lambda *r: spark.createDataFrame(list(r), "id long, k string, m string")
    first = frame((1, "a", "x"), (2, "a", "x"), (3, "b", "x"), (4, None, "x"))
    second = frame((5, "a", "x"), (6, "c", "x"), (7, "a", "y"), (8, None, "x"))
    for batch, i in ((first, 0), (second, 1), (second, 1)):
        handle(batch, i)
    assert rows(log.read(), "id") == [(1,), (3,), (4,), (6,), (7,)]
    assert seen.keys().count() == 5


def test_seen_keys_open_only_the_buckets_that_may_hold_a_key(spark, folder):
    seen = SeenKeys(spark, folder, buckets=32, slices_per_bucket=2)
    frame = lambda *names: spark.createDataFrame([(n,) for n in names], "hash string")
    assert seen.only_new(frame("a")).count() == 1 and seen.opened == []
    seen.add(frame(*[f"key-{i}" for i in range(500)]), 0)
    seen.add(frame(*[f"more-{i}" for i in range(500)]), 1)
    fresh = frame(*[f"other-{i}" for i in range(200)])
    assert seen.only_new(fresh).count() == 200 and len(seen.opened) < 8
    asked = frame("key-7", "more-9", "new")
    assert rows(seen.only_new(asked)) == [("new",)]
    assert 2 <= len(seen.opened) <= 3
    # The other buckets are pruned before anything is read.
    plan = seen.known(asked)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket#\d+ IN \(|PartitionFilters: \[[^\]]*bucket#\d+ = ", plan)
    assert rows(seen.only_new(asked, before=1)) == [("more-9",), ("new",)]
    seen.add(frame(*[f"more-{i}" for i in range(500)]), 1)
    assert seen.keys().count() == 1000
    smaller = seen.compacted(f"{folder}/compacted", 1)
    assert rows(smaller.only_new(asked)) == [("new",)] and smaller.keys().count() == 1000


EVENTS = columns(ts="timestamp_ntz", k="string")


def land(spark, folder, *batches):
    for batch in batches:
        spark.createDataFrame(batch, EVENTS).coalesce(1).write.mode("append").parquet(folder)
    return J.landed_files(spark, folder, EVENTS, files_per_trigger=1)


def test_dedup_within_the_delay_and_late_rows(spark, tmp_path):
    day = lambda n: datetime(2024, 1, n)
    stream = land(
        spark,
        f"{tmp_path}/in",
        [(day(1), "a"), (day(2), "a"), (day(20), "b")],
        [(day(21), "b"), (day(22), "c")],
        [(day(23), "d"), (day(3), "late")],  # a watermark acts one batch after it is set
    )
    out = J.dedup_within(stream, ["k"])
    J.drain(out.writeStream.format("parquet").option("path", f"{tmp_path}/out"), f"{tmp_path}/cp")
    assert rows(spark.read.parquet(f"{tmp_path}/out"), "k") == [("a",), ("b",), ("c",), ("d",)]


def test_restart_goes_on_where_it_stopped(spark, tmp_path):
    land(spark, f"{tmp_path}/in", [(datetime(2024, 1, 1), "a")])
    log = BatchLog(spark, f"{tmp_path}/log", columns(k="string"))
    run = lambda: J.drain(
        J.landed_files(spark, f"{tmp_path}/in", EVENTS).writeStream.foreachBatch(J.upsert_into(log)),
        f"{tmp_path}/cp",
    )
    run()
    run()
    land(spark, f"{tmp_path}/in", [(datetime(2024, 1, 2), "b")])
    run()
    assert rows(log.read(), "k", "batch_id") == [("a", 0), ("b", 1)]


def by_length(df):
    share = (F.char_length("headline") % 10) / F.lit(10.0)
    return score_columns(df, F.array(share, F.lit(1.0) - share, F.lit(0.0)))


def test_refresh_stream_scores_a_headline_once(spark, folder):
    plain = columns(entity="string", date="date", headline="string", source="string", true_label="string")
    kept = columns(entity="string", date="date", headline_hash="string", predicted_label="string", sentiment_score="double")
    state = J.RefreshStream(spark, folder, by_length, kept, "2024-01-31")
    data = [(f"e{i % 2}", date(2024, 1, 1 + i % 9), f"A headline with number {i:03d}", "s", "") for i in range(40)]
    frame = spark.createDataFrame(data, plain)
    short = spark.createDataFrame([("e0", date(2024, 1, 2), "too short", "s", "")], plain)
    again = frame.withColumn("date", F.lit(date(2024, 1, 20)))  # the same headlines on another day
    play(spark, folder, state, frame.limit(20).unionByName(short), frame, again)
    assert state.scored().count() == 40 == state.scored().select("headline_hash").distinct().count()
    one = frame.select(headline_hash(F.col("headline"))).first()[0]
    assert state.scored().filter(F.col("headline_hash") == one).count() == 1
    expected = weighted(by_length(frame), "2024-01-31")
    assert rows(state.summary(), *RISK) == rows(risk_summary_direct(expected), *RISK)
    assert state.rollups().count() == daily_rollup(expected).count()
    smaller = state.compacted(f"{folder}/compacted", 2)
    play(spark, folder, smaller, frame)
    assert smaller.scored().count() == 40 and rows(smaller.summary()) == rows(state.summary())


def test_refresh_interval_is_the_trigger(spark, tmp_path):
    seen = {}

    class Writer:
        def trigger(self, **kwargs):
            seen.update(kwargs)
            return self

    J.periodic(Writer())
    assert seen == {"processingTime": "60 minutes"}


def test_feed_stream_remembers_what_it_kept(spark, tmp_path):
    item = "<item><title>Headline {} about the company</title><pubDate>2024-01-10</pubDate><link>u</link></item>"

    def put(name, numbers):
        folder = tmp_path / "in" / "entity=acme"
        folder.mkdir(parents=True, exist_ok=True)
        body = "".join(item.format(f"{n:02d}") for n in numbers)
        (folder / name).write_text(f"<rss><channel>{body}</channel></rss>")

    def payloads():
        return read_payload_files(spark, str(tmp_path / "in"))

    put("a.xml", range(25))
    log = BatchLog(
        spark,
        f"{tmp_path}/log",
        columns(date="date", entity="string", headline="string", true_label="string", source="string", url="string", hash="string"),
    )
    order = [F.col("file"), F.col("position")]
    handle = J.ingest_forever(log, SeenKeys(spark, f"{tmp_path}/seen", 4, 2), order, "2024-01-11 00:00:00")
    handle(payloads(), 0)
    assert log.read().count() == 20
    put("b.xml", range(22, 28))
    for _ in range(2):
        handle(payloads(), 1)
    found = [r.headline[9:11] for r in log.read().orderBy("headline").collect()]
    assert found == [f"{n:02d}" for n in range(28)]
    assert {r.entity for r in log.read().collect()} == {"acme"}

"""Streaming jobs over EV, landed in three parts that follow each other in time.

Each query lands every event, lets its job catch up after each part, and returns what a reader of
the sink sees afterwards; its SQL is the batch answer over the same table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from queries.base import (
    AS_OF,
    DAILY,
    EV,
    ISO,
    R6,
    RISK,
    TEMPORAL_OUT,
    ZSCORE,
    ev,
    ev_by_type,
    query,
    rounded,
    temporal_out,
)
from queries.composite import RUN_SERIES, run_events, score_events
from queries.series import ALERT_LINE, BY_TYPE_SQL, CURRENT_SERIES
from tonegauge.operators.maintenance import with_headline_hash
from tonegauge.schemas import columns
from tonegauge.session import run_dir
from tonegauge.sources.seen import SeenKeys
from tonegauge.streaming import jobs as J
from tonegauge.streaming.batchlog import BatchLog

CUTS = ("2024-01-11", "2024-01-21")  # the first part is open below and has rows without a time, the last is open above


def parts_of(events: DataFrame):
    """The events in three parts."""
    for first, end in zip((None, *CUTS), (*CUTS, None)):
        late = F.lit(True) if first is None else F.col("ts") >= first
        early = F.lit(True) if end is None else F.col("ts") < end
        yield events.filter(late & early if first else early | F.col("ts").isNull())


def played(
    spark: SparkSession,
    events: DataFrame,
    start: Callable[[DataFrame], DataStreamWriter],
) -> None:
    """Land one part after the other and let the job catch up each time, from one checkpoint. The job is
    started anew for each part, which so arrives as one batch."""
    folder, checkpoint = run_dir(spark, "landed"), run_dir(spark, "offsets")
    for part in parts_of(events):
        part.write.mode("append").parquet(folder)
        J.drain(start(J.landed_files(spark, folder, events.schema)), checkpoint)


def played_live(
    spark: SparkSession,
    events: DataFrame,
    start: Callable[[DataFrame], DataStreamWriter],
) -> None:
    """Land the parts while the job runs. How files group into batches is left to the source: for jobs
    whose answer does not depend on it."""
    folder, checkpoint = run_dir(spark, "landed"), run_dir(spark, "offsets")
    first, *rest = parts_of(events)
    first.write.parquet(folder)
    stream = J.landed_files(spark, folder, events.schema)
    query = start(stream).option("checkpointLocation", checkpoint).start()
    try:
        query.processAllAvailable()
        for part in rest:
            part.write.mode("append").parquet(folder)
            query.processAllAvailable()
    finally:
        query.stop()


def handled(handle: J.Handler, prepare=lambda stream: stream, mode: str = "append"):
    """A writer that passes every prepared batch to the handler."""
    return lambda stream: prepare(stream).writeStream.outputMode(mode).foreachBatch(handle)


def filed(path: str, prepare):
    """A writer that appends the prepared rows to Parquet files."""
    return lambda stream: prepare(stream).writeStream.format("parquet").option("path", path)


@query(
    "stream_ingest",
    f"""WITH {EV} SELECT event_id, entity, {ISO()}, {R6('sentiment_score', 'sentiment_score')} FROM ev""",
)
def _stream_ingest(spark, sf):
    out, rows = run_dir(spark, "ingested"), ev(spark, sf)
    names = ("event_id", "entity", "date", "sentiment_score")
    played_live(spark, rows, filed(out, lambda stream: stream.select(*names)))
    return rounded(spark.read.schema(rows.select(*names).schema).parquet(out), "sentiment_score")


@query(
    "stream_dedup",
    f"""WITH {EV} SELECT min(event_id) AS event_id, md5(lower(headline)) AS headline_hash FROM ev GROUP BY 2""",
)
def _stream_dedup(spark, sf):
    """First event of each headline over the life of the stream."""
    kept = columns(event_id="long", headline_hash="string")
    log, seen = BatchLog(spark, run_dir(spark, "firsts"), kept), SeenKeys(spark, run_dir(spark, "seen"))
    handle = J.dedup_forever(log, seen, ["headline_hash"], [F.col("event_id")])
    played(spark, ev(spark, sf), handled(handle, with_headline_hash))
    return log.read().drop("batch_id")


@query(
    "stream_dedup_within",
    f"""WITH {EV} SELECT DISTINCT headline FROM ev""",
)
def _stream_dedup_within(spark, sf):
    """Distinct headlines by watermarked state, with a delay that spans the whole stream."""
    out = run_dir(spark, "within")

    def prepare(stream):
        return J.dedup_within(stream, ["headline"], delay="36500 days").select("headline")

    played_live(spark, ev(spark, sf), filed(out, prepare))
    return spark.read.schema(columns(headline="string")).parquet(out)


@query(
    "stream_late",
    """SELECT event_id FROM events
    WHERE floor((epoch(TIMESTAMP '2024-01-20 12:00:00') - epoch(ts)) / 86400) BETWEEN 0 AND 7""",
)
def _stream_late(spark, sf):
    out = run_dir(spark, "recent")

    def prepare(stream):
        return J.recent_stream(stream, "2024-01-20 12:00:00").select("event_id")

    played_live(spark, ev(spark, sf), filed(out, prepare))
    return spark.read.schema(columns(event_id="long")).parquet(out)


@query(
    "stream_daily",
    f"""WITH {EV}, {DAILY('sentiment_score')} SELECT entity, {ISO()}, {R6('d', 'daily_avg_sentiment')} FROM daily""",
)
def _stream_daily(spark, sf):
    daily = columns(entity="string", date="date", daily_avg_sentiment="double")
    log = BatchLog(spark, run_dir(spark, "daily"), daily)

    def prepare(stream):
        return J.daily_mean_stream(stream.withWatermark("ts", "7 days"))

    played_live(spark, ev(spark, sf), handled(log.write, prepare, mode="update"))
    return rounded(log.latest(["entity", "date"]), "daily_avg_sentiment")


def _risk_stream(spark, events, as_of=AS_OF) -> J.RiskStream:
    state = J.RiskStream(spark, run_dir(spark, "risk"), as_of)
    played_live(spark, events, state.writer)
    return state


@query(
    "stream_zscore",
    f"WITH {EV}, {DAILY('sentiment_score')}, {ZSCORE()} SELECT {TEMPORAL_OUT} FROM temporal",
)
def _stream_zscore(spark, sf):
    return temporal_out(_risk_stream(spark, ev(spark, sf)).temporal())


@query("stream_zscore_as_of", f"{CURRENT_SERIES} SELECT {TEMPORAL_OUT} FROM temporal")
def _stream_zscore_as_of(spark, sf):
    return temporal_out(_risk_stream(spark, ev(spark, sf)).temporal_as_of(AS_OF))


@query(
    "stream_upsert",
    f"""WITH {EV}, b AS (
      SELECT *, md5(lower(headline)) AS headline_hash,
             CASE WHEN ts < TIMESTAMP '2024-01-11' THEN 0 WHEN ts < TIMESTAMP '2024-01-21' THEN 1 ELSE 2 END AS batch
      FROM ev),
    l AS (SELECT *, max(batch) OVER (PARTITION BY headline_hash) AS newest FROM b)
    SELECT event_id, headline_hash, {R6('sentiment_score', 'sentiment_score')} FROM l WHERE batch = newest""",
)
def _stream_upsert(spark, sf):
    kept = columns(event_id="long", headline_hash="string", sentiment_score="double")
    log = BatchLog(spark, run_dir(spark, "upserts"), kept)
    played(spark, ev(spark, sf), handled(J.upsert_into(log), with_headline_hash))
    return rounded(log.latest_batch_rows(["headline_hash"]), "sentiment_score")


# Age weights of a day before all events are 1, which makes the scores equal to the unweighted ones.
WEIGHT_FREE = "2024-01-01"


@query(
    "stream_alerts",
    f"""{BY_TYPE_SQL} SELECT entity, composite_risk_score, {ALERT_LINE} AS alert_line FROM risk
    WHERE risk_tier = 'HIGH' AND composite_risk_score >= 35 AND total_headlines >= 5""",
)
def _stream_alerts(spark, sf):
    return _risk_stream(spark, ev_by_type(spark, sf), WEIGHT_FREE).current_alerts()


@query("stream_full_run", f"{RUN_SERIES}, {RISK(source='run')} SELECT * FROM risk")
def _stream_full_run(spark, sf):
    """Events arrive as unscored articles; the stream cleans, scores and sums them up."""
    events = run_events(spark, sf)
    kept = columns(
        entity="string",
        date="date",
        headline_hash="string",
        predicted_label="string",
        sentiment_score="double",
    )
    state = J.RefreshStream(spark, run_dir(spark, "refresh"), score_events, kept, AS_OF)
    played_live(spark, events, state.writer)
    return state.summary()

"""Streaming jobs over landed files."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import StructType, TimestampNTZType

from tonegauge.config import EngineConfig
from tonegauge.functions.weights import half_life_weight
from tonegauge.operators.cleaning import usable_articles
from tonegauge.operators.dedup import first_per_key
from tonegauge.operators.filters import recent
from tonegauge.operators.maintenance import HASH, with_headline_hash
from tonegauge.operators.risk import alerts, finish_summary, summary_from_rollup
from tonegauge.operators.temporal import min_history, temporal_from_rollup
from tonegauge.schemas import ALERTS, DAILY_ROLLUP, TEMPORAL, columns
from tonegauge.sources.feeds import ingest_feed, parse_rss_payloads
from tonegauge.session import materialise
from tonegauge.sources.seen import SeenKeys
from tonegauge.streaming.batchlog import BatchLog
from tonegauge.streaming.series_state import DAY, ENTITY, LATE, SCORED, SERIES, series_rows, totals_with_shares

Handler = Callable[[DataFrame, int], None]
KEEP_DAYS = 60  # how long a day stays open for late rows

# Keyed state of any size lives on the executors' disks; only changes travel to the checkpoint.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def landed_files(
    spark: SparkSession,
    folder: str,
    schema: StructType,
    event_time: str = "ts",
    file_format: str = "parquet",
    files_per_trigger: int | None = None,
) -> DataFrame:
    """Stream of files as they land. Time without a zone becomes a UTC instant, which watermarks
    require."""
    reader = spark.readStream.schema(schema).format(file_format)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    stream = reader.load(folder)
    if isinstance(schema[event_time].dataType, TimestampNTZType):
        stream = stream.withColumn(event_time, F.col(event_time).cast("timestamp"))
    return stream


def periodic(writer: DataStreamWriter, config: EngineConfig | None = None) -> DataStreamWriter:
    """Run at the configured refresh interval, one batch at a time."""
    minutes = (config or EngineConfig()).refresh_interval_minutes
    return writer.trigger(processingTime=f"{minutes} minutes")


def drain(writer: DataStreamWriter, checkpoint: str) -> None:
    """Process what has landed, then stop."""
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def recent_stream(
    stream: DataFrame, as_of=None, event_time: str = "ts", max_age_days: int = 7
) -> DataFrame:
    """Drop late rows: the filter is exact, the watermark bounds the state of later operators."""
    return recent(stream, event_time, as_of, max_age_days).withWatermark(
        event_time, f"{max_age_days} days"
    )


def dedup_within(
    stream: DataFrame, keys: Sequence[str], event_time: str = "ts", delay: str = "7 days"
) -> DataFrame:
    """First row per key among rows at most `delay` apart; the state is dropped afterwards."""
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(list(keys))


def dedup_forever(
    log: BatchLog, seen: SeenKeys, keys: Sequence[str], order_by: Sequence[Column]
) -> Handler:
    """First row per key over the whole life of the stream.

    The memory is the table of seen keys, so nothing has to fit into executor state, and a batch opens
    only the buckets that its keys may be in. Keys of several columns are stored as their SHA-256.
    """
    key = F.col(keys[0]).cast("string") if len(keys) == 1 else F.sha2(F.to_json(F.struct(*keys)), 256)
    # A missing key is a key of its own and must differ from every text.
    marked = F.coalesce(F.concat(F.lit("="), key), F.lit("null"))

    def handle(batch: DataFrame, batch_id: int) -> None:
        firsts = materialise(first_per_key(batch, keys, order_by).withColumn("hash", marked), "firsts")
        new = seen.only_new(firsts, before=batch_id)
        log.write(new.drop("hash") if "hash" not in batch.columns else new, batch_id)
        seen.add(log.read_batch(batch_id).select(marked.alias("hash")), batch_id)

    return handle


def ingest_forever(
    log: BatchLog,
    seen: SeenKeys,
    order_by: Sequence[Column],
    as_of=None,
    config: EngineConfig | None = None,
) -> Handler:
    """Landed RSS payloads (`entity`, `payload`) to new articles, each kept once for good.

    Only kept articles enter the table of seen keys, so items beyond the cap of a batch stay new.
    """
    config = config or EngineConfig()

    def handle(batch: DataFrame, batch_id: int) -> None:
        articles = ingest_feed(
            parse_rss_payloads(batch),
            order_by,
            as_of,
            seen=lambda rows: seen.only_new(materialise(rows, "items"), before=batch_id),
            max_per_entity=config.max_articles_per_entity,
            max_age_days=config.max_age_days,
        )
        log.write(articles, batch_id)
        seen.add(log.read_batch(batch_id).select("hash"), batch_id)

    return handle


def upsert_into(log: BatchLog) -> Handler:
    """Replace-by-key sink; read it with `latest_batch_rows(keys)`."""
    return log.write


def daily_mean_stream(
    stream: DataFrame, event_time: str = "ts", value: str = "sentiment_score"
) -> DataFrame:
    """Tumbling daily mean per entity. Use update mode with an upsert on (entity, date): append
    mode would hold back the days that are still open."""
    day = F.window(event_time, "1 day")
    return (
        stream.groupBy(day, "entity")
        .agg(F.avg(value).alias("daily_avg_sentiment"))
        .select("entity", F.to_date(F.col("window.start")).alias("date"), "daily_avg_sentiment")
    )


class RiskStream:
    """Daily sums, z-scores and alerts kept up to date by keyed state.

    A batch is summed per entity and day before it is shuffled, meets the state of its own entities and
    leaves the days it changed and the totals of the entities it touched. No batch reads what an earlier
    one has written. Days stay open for `keep_days`; `idle_ttl_ms` drops the state of entities without
    news for that long.
    """

    def __init__(
        self,
        spark: SparkSession,
        root: str,
        as_of=None,
        config: EngineConfig | None = None,
        keep_days: int = KEEP_DAYS,
        idle_ttl_ms: int | None = None,
        passing: StructType | None = None,
    ):
        self.config = config or EngineConfig()
        if self.config.profile.normalised_recency:
            raise ValueError("totals with normalised recency cannot be carried on from day to day")
        self.spark, self.root, self.as_of, self.keep_days, self.idle_ttl_ms = spark, root, as_of, keep_days, idle_ttl_ms
        self.passing = passing
        carried = [f for f in passing or [] if f.name not in SERIES.names]
        self.series = BatchLog(spark, f"{root}/series", StructType([*SERIES.fields, *carried]), split_by="kind")
        self.alerts = BatchLog(spark, f"{root}/alerts", columns(**{f.name: f.dataType for f in ALERTS}, hit="boolean"))

    def prepared(self, stream: DataFrame) -> DataFrame:
        """Scored headlines of a stream; a stream of other rows is scored here."""
        return stream

    def writer(self, stream: DataFrame) -> DataStreamWriter:
        """The whole job: one plan with all its state, one sink."""
        for key, value in STATE_STORE.items():
            self.spark.conf.set(key, value)
        as_of = date.fromisoformat(self.as_of) if isinstance(self.as_of, str) else self.as_of
        rows = series_rows(self.prepared(stream), self.config.profile, as_of, self.keep_days, self.idle_ttl_ms, self.passing)
        return rows.writeStream.outputMode("append").foreachBatch(self.land)

    def land(self, rows: DataFrame, batch_id: int) -> None:
        """Write the rows of a batch once, then the alerts of its entities."""
        self.series.write(rows, batch_id)
        entities = self.series.read_batch(batch_id).filter(F.col("kind") == ENTITY)
        summary = finish_summary(totals_with_shares(entities, self.config.profile), self.config.profile)
        hits = alerts(summary, self.config).withColumn("hit", F.lit(True))
        # An entity whose alert has ended leaves a row without a hit.
        self.alerts.write(entities.select("entity").join(hits, "entity", "left"), batch_id)

    def days(self, kind: str = DAY) -> DataFrame:
        """Rows of one kind with the batch they came in."""
        return self.series.read().filter(F.col("kind") == kind)

    def rollups(self) -> DataFrame:
        """Current sums of every day."""
        current = first_per_key(self.days(), ["entity", "date"], [F.desc("batch_id")])
        return current.select(*DAILY_ROLLUP.names)

    def weigh(self, rollup: DataFrame, as_of=None) -> DataFrame:
        """Apply the age weight to the sums: it depends on the day alone, and rows without a day have none."""
        as_of = self.as_of if as_of is None else as_of
        weight = half_life_weight(F.col("date"), as_of, self.config.profile.half_life_days)
        return rollup.withColumns(
            {
                "value_sum": F.col("value_sum") * weight,
                "value_count": F.when(weight.isNotNull(), F.col("value_count")).otherwise(F.lit(0).cast("long")),
            }
        )

    def temporal(self) -> DataFrame:
        """The current series; the history rule is applied here because it may turn true late."""
        dated = self.days().filter(F.col("date").isNotNull())
        rows = first_per_key(dated, ["entity", "date"], [F.desc("batch_id")]).select(*TEMPORAL.names)
        return min_history(rows, self.config.profile.min_history_days)

    def temporal_as_of(self, as_of) -> DataFrame:
        """The series with age weights of a given day. Those change every day for all history, so
        they are applied to the sums on reading instead of being stored."""
        return temporal_from_rollup(self.weigh(self.rollups(), as_of), self.config.profile)

    def current_alerts(self) -> DataFrame:
        """Alerts of the last batch that touched the entity."""
        return self.alerts.latest(["entity"]).filter("hit").drop("hit")

    def late(self) -> DataFrame:
        """Sums that came after their day was closed."""
        return self.days(LATE).select(*DAILY_ROLLUP.names)

    def opened(self, root: str) -> RiskStream:
        """The same stream under another root."""
        return RiskStream(self.spark, root, self.as_of, self.config, self.keep_days, self.idle_ttl_ms, self.passing)

    def compacted(self, root: str, upto: int) -> RiskStream:
        """Output under a new root with only the current rows up to a finished batch. The state stays in
        the checkpoint, from which the stream goes on."""
        other = self.opened(root)
        rows = self.series.read(upto=upto)
        # A day and an entity have one current row; rows of the other kinds all stay.
        newest = first_per_key(rows.filter(F.col("kind").isin(DAY, ENTITY)), ["kind", "entity", "date"], [F.desc("batch_id")])
        kept = newest.unionByName(rows.filter(~F.col("kind").isin(DAY, ENTITY)))
        self.series.compacted(other.series.path, kept, upto)
        self.alerts.compacted(other.alerts.path, self.alerts.latest(["entity"]), upto)
        return other

    def summary(self, as_of=None) -> DataFrame:
        """Composite risk of all entities from the sums."""
        return summary_from_rollup(self.weigh(self.rollups(), as_of), self.config.profile)


class RefreshStream(RiskStream):
    """The periodic run as one streaming plan: clean, keep new headlines, score them, update risk.

    Two stateful operators follow each other, the headlines known so far and the series of each entity.
    A headline is scored once in the life of the stream, for the article it first comes with; another
    article under it adds nothing. `kept` names the columns of the scored rows to keep beside the series.
    """

    def __init__(
        self,
        spark: SparkSession,
        root: str,
        score: Callable[[DataFrame], DataFrame],
        kept: StructType,
        as_of=None,
        config: EngineConfig | None = None,
        keep_days: int = KEEP_DAYS,
        idle_ttl_ms: int | None = None,
    ):
        super().__init__(spark, root, as_of, config, keep_days, idle_ttl_ms, kept)
        self.score = score

    def prepared(self, stream: DataFrame) -> DataFrame:
        usable = with_headline_hash(usable_articles(stream, daily=True))
        return self.score(usable.dropDuplicates([HASH]))

    def scored(self) -> DataFrame:
        """All scored headlines, the columns of `kept`."""
        return self.days(SCORED).select(*self.passing.names)

    def opened(self, root: str) -> RefreshStream:
        return RefreshStream(self.spark, root, self.score, self.passing, self.as_of, self.config, self.keep_days, self.idle_ttl_ms)

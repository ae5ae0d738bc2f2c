"""Keys met so far, in buckets by key hash, with a Bloom filter in front of each bucket.

    <path>/keys/batch_id=<n>/bucket=<b>/    the keys a batch added
    <path>/filters/batch_id=<n>/            their bits, as bit sets of 4 KB

A key has one bit set, chosen by its hash, and `PROBES` bits in it; the bit sets of a bucket are its filter.
A batch asks the filters first. Keys with a bit missing are new for certain, and only the buckets that the other keys
fall into are opened, so a batch of new keys reads filters alone: some 10 bits a key where a stored
key takes over 32 bytes. The filters only choose what is opened; whether a key is known is decided by
the stored keys.

A batch owns its folders and overwrites them, so running it again changes nothing. The number of buckets and
of bit sets belongs to the table: give the same ones every time. A bit set serves some 3,000 keys
well; beyond that more buckets are opened than need be.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tonegauge.schemas import columns
from tonegauge.session import materialise

BITS, PROBES = 1 << 15, 4
KEYS = columns(hash="string", bucket="integer", batch_id="long")
FILTERS = columns(slice="long", bitmap="binary", batch_id="long")


def slice_of(key: Column, slices: int) -> Column:
    """Number of the bit set of a key."""
    return F.pmod(F.xxhash64(key), F.lit(slices))


def bits_of(key: Column) -> list[Column]:
    """Positions of a key's bits in its bit set."""
    return [F.pmod(F.xxhash64(key, F.lit(probe)), F.lit(BITS)) for probe in range(1, PROBES + 1)]


def bit_is_set(bitmap: Column, position: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bitmap, (position / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, F.pmod(position, F.lit(8)).cast("int")) == 1


class SeenKeys:
    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, slices_per_bucket: int = 16):
        self.spark, self.path = spark, path.rstrip("/")
        self.buckets, self.slices = buckets, buckets * slices_per_bucket
        self.slices_per_bucket = slices_per_bucket
        #: Buckets that the last question had to open.
        self.opened: list[int] = []

    def _read(self, folder: str, schema, before: int | None) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).parquet(f"{self.path}/{folder}")
        return rows if before is None else rows.filter(F.col("batch_id") < before)

    def keys(self, before: int | None = None) -> DataFrame:
        """All stored keys (hash, bucket, batch_id); the bucket and the batch prune folders."""
        return self._read("keys", KEYS, before)

    def maybe_known(self, keys: DataFrame, before: int | None = None) -> DataFrame:
        """The keys (hash) all of whose bits are set, with their bucket."""
        filters = self._read("filters", FILTERS, before).groupBy("slice").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))
        asked = keys.select("hash", slice_of(F.col("hash"), self.slices).alias("slice"))
        hit = reduce(Column.__and__, [bit_is_set(F.col("bitmap"), bit) for bit in bits_of(F.col("hash"))])
        bucket = (F.col("slice") / self.slices_per_bucket).cast("int").alias("bucket")
        return asked.join(filters, "slice").filter(hit).select("hash", bucket)

    def known(self, keys: DataFrame, before: int | None = None) -> DataFrame:
        """Those of the given distinct keys (hash) that are stored."""
        maybe = materialise(self.maybe_known(keys, before), "maybe-known")
        self.opened = sorted(r["bucket"] for r in maybe.select("bucket").distinct().collect())  # `buckets` numbers at most
        stored = self.keys(before).filter(F.col("bucket").isin(self.opened)) if self.opened else self.keys(before).limit(0)
        return maybe.join(stored, ["bucket", "hash"], "left_semi").select("hash")

    def only_new(self, rows: DataFrame, before: int | None = None) -> DataFrame:
        """Rows whose `hash` is not stored. They are read twice: pass rows that have been written."""
        return rows.join(self.known(rows.select("hash").distinct(), before), "hash", "left_anti")

    def add(self, keys: DataFrame, batch_id: int) -> None:
        """Store the distinct keys (hash) of a batch and their bits. The keys are computed once."""
        at = slice_of(F.col("hash"), self.slices)
        rows = keys.select("hash", (at / self.slices_per_bucket).cast("int").alias("bucket"))
        placed = rows.repartition("bucket").sortWithinPartitions("bucket", "hash")
        folder = f"{self.path}/keys/batch_id={batch_id}"
        placed.write.mode("overwrite").partitionBy("bucket").parquet(folder)
        stored = self.spark.read.schema(columns(hash="string", bucket="integer")).parquet(folder)
        bits = stored.select(at.alias("slice"), F.explode(F.array(*bits_of(F.col("hash")))).alias("bit"))
        made = bits.groupBy("slice").agg(F.bitmap_construct_agg("bit").alias("bitmap"))
        made.write.mode("overwrite").parquet(f"{self.path}/filters/batch_id={batch_id}")

    def compacted(self, path: str, upto: int) -> SeenKeys:
        """The table under a new path with all batches up to a finished one filed as that batch: one
        filter and one set of files a bucket instead of one for each batch."""
        other = SeenKeys(self.spark, path, self.buckets, self.slices_per_bucket)
        other.add(self.keys(before=upto + 1).select("hash"), upto)
        return other

"""Micro-batch outputs on a shared folder, safe to replay.

Each batch owns the sub-folder `batch_id=<n>` and overwrites it, so running a batch again after a
failure changes nothing. A batch writes only its own rows, never the table; which row is current
is decided by the reader.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tonegauge.operators.dedup import first_per_key

BATCH = "batch_id"


class BatchLog:
    """`split_by` names a column with few values that gets folders of its own inside a batch, so a reader of
    one value opens no file of another."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, split_by: str | None = None):
        self.spark = spark
        self.path = path.rstrip("/")
        self.schema = StructType([f for f in schema.fields if f.name != BATCH])
        self.split_by = split_by

    def write(self, df: DataFrame, batch_id: int) -> None:
        names = [f.name for f in self.schema.fields]
        writer = df.select(*names).write.mode("overwrite")
        if self.split_by:
            writer = writer.partitionBy(self.split_by)
        writer.parquet(f"{self.path}/{BATCH}={batch_id}")

    def _exists(self) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def read(self, before: int | None = None, upto: int | None = None) -> DataFrame:
        """All rows with their batch; the bounds prune whole batch folders."""
        full = StructType([*self.schema.fields, StructField(BATCH, LongType())])
        if not self._exists():
            return self.spark.createDataFrame([], full)
        rows = self.spark.read.schema(full).parquet(self.path)
        if before is not None:
            rows = rows.filter(F.col(BATCH) < before)
        if upto is not None:
            rows = rows.filter(F.col(BATCH) <= upto)
        return rows

    def read_batch(self, batch_id: int) -> DataFrame:
        """The rows of one finished batch."""
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/{BATCH}={batch_id}")

    def latest(self, keys: Sequence[str]) -> DataFrame:
        """One current row per key, for logs that hold a key once per batch."""
        return first_per_key(self.read(), keys, [F.desc(BATCH)]).drop(BATCH)

    def latest_batch_rows(self, keys: Sequence[str]) -> DataFrame:
        """All rows of the newest batch that holds the key: replace-by-key, repeats kept.

        The newest batch per key is a partial aggregate; the join has one row per key on its right
        side, so a hot key may be split on the left.
        """
        rows = self.read()
        newest = rows.groupBy(*keys).agg(F.max(BATCH).alias(BATCH))
        return rows.join(newest, [*keys, BATCH], "left_semi").drop(BATCH)

    def compacted(self, path: str, merged: DataFrame, upto: int) -> BatchLog:
        """A new log that starts from `merged`, filed under batch `upto`; the old one is untouched.

        Run between two starts of the stream, whose next batch id is above `upto`.
        """
        log = BatchLog(self.spark, path, self.schema, self.split_by)
        log.write(merged, upto)
        return log

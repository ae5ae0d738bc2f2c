"""A stored key table laid out in buckets, so that looking keys up moves the incoming side only.

Rows lie in files by the hash that Spark shuffles with. A join on the key reads them where they are: the
incoming rows are shuffled to the same buckets, the stored side, which may be years of keys, is not.
The table is known to the session's catalog under a name; its files belong to a path, from which any session
registers it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class BucketedTable:
    def __init__(self, spark: SparkSession, name: str, path: str, schema: StructType, key: str, buckets: int = 64):
        self.spark, self.name, self.key, self.buckets = spark, name, key, buckets
        self.names = [f.name for f in schema]
        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS `{name}` ({kinds}) USING parquet "
            f"CLUSTERED BY (`{key}`) INTO {buckets} BUCKETS LOCATION '{path}'"
        )

    def read(self) -> DataFrame:
        return self.spark.table(f"`{self.name}`")

    def append(self, rows: DataFrame) -> None:
        """Add rows; each bucket gets one file more. Repartitioned by the key, a task writes one bucket."""
        placed = rows.select(*self.names).repartition(self.buckets, self.key)
        placed.write.insertInto(f"`{self.name}`")

    def only_new(self, incoming: DataFrame) -> DataFrame:
        """Incoming rows whose key is not stored. Rows without a key are new, as a null key equals nothing."""
        stored = self.read().select(F.col(self.key).alias("__stored"))
        return incoming.join(stored, F.col(self.key) == F.col("__stored"), "left_anti")

"""A stored table in folders by key hash, so that an upsert rewrites only the folders it touches.

    <path>/bucket=<b>/part-...

An upsert reads the touched folders, replaces its keys in them and overwrites these folders alone; the files of
all others stay as they are. Replacing by key is idempotent: an upsert that died while its folders were
exchanged is completed by running it again. The number of buckets belongs to the table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from tonegauge.operators.maintenance import upsert_by_key
from tonegauge.session import materialise

BUCKET = "bucket"


class KeyedTable:
    def __init__(self, spark: SparkSession, path: str, schema: StructType, keys: Sequence[str], buckets: int = 64):
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), list(keys), buckets
        self.schema = StructType([f for f in schema if f.name != BUCKET])
        self._stored = StructType([*self.schema.fields, StructField(BUCKET, IntegerType())])

    def _bucket(self):
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _rows(self) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], self._stored)
        return self.spark.read.schema(self._stored).parquet(self.path)

    def read(self) -> DataFrame:
        return self._rows().drop(BUCKET)

    def lookup(self, keys: DataFrame) -> DataFrame:
        """Stored rows with one of the given keys; only the folders that may hold one are opened."""
        asked = keys.select(*self.keys).distinct()
        touched = self._touched(asked)
        return self._rows().filter(F.col(BUCKET).isin(touched)).join(asked, self.keys, "left_semi").drop(BUCKET)

    def _touched(self, rows: DataFrame) -> list[int]:
        found = rows.select(self._bucket().alias(BUCKET)).distinct().collect()  # `buckets` numbers at most
        return sorted(r[BUCKET] for r in found)

    def upsert(self, incoming: DataFrame) -> list[int]:
        """Replace rows by key; returns the buckets that were rewritten, none for an empty input.

        The incoming rows are computed once. Repeats of a key among them all stay.
        """
        names = [f.name for f in self.schema]
        new = materialise(incoming.select(*names), "upsert")
        touched = self._touched(new)
        if touched:
            stored = self._rows().filter(F.col(BUCKET).isin(touched)).select(*names)
            # Written aside first: a folder cannot be read while it is being replaced.
            merged = materialise(upsert_by_key(stored, new, self.keys).withColumn(BUCKET, self._bucket()), "merged")
            merged.repartition(BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(self.path)
        return touched

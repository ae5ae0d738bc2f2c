"""Stored tables: one folder per table, one sub-folder per version, in it the parts of the version.

    <table>/v=<n>/part=<name>/      Spark's files and, once they are committed, the marker

A version counts once it has a part with a marker; readers take the newest version and all its marked
parts. A replaced table is a new version; added rows are a new part beside the others, never
files inside a committed one, so a reader sees all rows of an append or none. A part of a given name is
overwritten when it is written again, which makes appends of a repeated run harmless. Old versions go with
`retire`. All file access goes through Hadoop, hence any shared store.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tonegauge.operators.maintenance import (
    HASH,
    absent_articles,
    table_health,
    upsert_by_key,
    with_headline_hash,
)
from tonegauge.schemas import TABLES
from tonegauge.session import materialise

MARKER = "_COMMITTED"


class TableStore:
    """Named tables below one root folder."""

    def __init__(self, spark: SparkSession, root: str, schemas: dict[str, StructType] | None = None):
        self.spark = spark
        self.root = root.rstrip("/")
        self.schemas = TABLES if schemas is None else schemas

    def _hadoop(self, path: str):
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target, target.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, path: str) -> list[str]:
        folder, fs = self._hadoop(path)
        return [status.getPath().getName() for status in fs.listStatus(folder)] if fs.exists(folder) else []

    def _parts(self, name: str, version: int) -> list[str]:
        """Paths of the committed parts of a version."""
        folder = f"{self.root}/{name}/v={version}"
        paths = [f"{folder}/{part}" for part in sorted(self._names(folder)) if part.startswith("part=")]
        return [p for p in paths if MARKER in self._names(p)]

    def versions(self, name: str) -> list[int]:
        """Numbers of the committed versions, oldest first."""
        numbers = sorted(int(n[2:]) for n in self._names(f"{self.root}/{name}") if n.startswith("v="))
        return [n for n in numbers if self._parts(name, n)]

    def path(self, name: str) -> str | None:
        """Folder of the newest committed version, None for a table never written."""
        versions = self.versions(name)
        return f"{self.root}/{name}/v={versions[-1]}" if versions else None

    def read(self, name: str, entity: str | None = None, without: str | None = None) -> DataFrame:
        """The table, or an empty one of its declared schema; an entity filter is pushed down.

        Parts may differ in columns; what one lacks is NULL there. `without` leaves one part out.
        """
        versions = self.versions(name)
        parts = [p for p in (self._parts(name, versions[-1]) if versions else []) if not p.endswith(f"/part={without}")]
        if not parts:
            # The filter tells the planner that there are no rows: joins with them shuffle nothing.
            df = self.spark.createDataFrame([], self.schemas[name]).filter(F.lit(False))
        else:
            df = self.spark.read.option("mergeSchema", str(len(parts) > 1).lower()).parquet(*parts)
        return df.filter(F.col("entity") == entity) if entity else df

    def _commit(self, target: str, df: DataFrame) -> int:
        """Write a part; the rows are counted while they are written. Without rows it stays unmarked."""
        written = Observation()
        # `overwrite` clears what an attempt without a marker may have left behind.
        df.observe(written, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(target)
        rows = written.get["rows"]
        if rows:
            marker, fs = self._hadoop(f"{target}/{MARKER}")
            fs.create(marker, True).close()
        return rows

    def replace(self, name: str, df: DataFrame, sort_by: str | None = None) -> bool:
        """Write a new version; an empty input leaves the table as it is and returns False.

        The input is computed once. Versions are numbered one up: one writer per table at a time.
        """
        versions = self.versions(name)
        target = f"{self.root}/{name}/v={versions[-1] + 1 if versions else 0}"
        return self._commit(f"{target}/part=all", df.sortWithinPartitions(sort_by) if sort_by else df) > 0

    def append(self, name: str, new: DataFrame, part: str | None = None) -> int:
        """Add rows as a part of their own and return their number. Written again under the same name, a part
        replaces what it held. `new` must not read the part that it is written to."""
        versions = self.versions(name)
        target = f"{self.root}/{name}/v={versions[-1] if versions else 0}"
        return self._commit(f"{target}/part={part or uuid.uuid4().hex}", new)

    def retire(self, name: str, keep: int = 2) -> list[int]:
        """Delete all but the newest `keep` versions; returns their numbers. Readers of a retired version
        must have ended."""
        old = self.versions(name)[: -max(keep, 1)]
        for version in old:
            folder, fs = self._hadoop(f"{self.root}/{name}/v={version}")
            fs.delete(folder, True)
        return old

    def insert_articles(self, incoming: DataFrame, name: str = "news_articles", part: str | None = None) -> int:
        """Add articles whose key is not stored; returns how many were added.

        Only the new rows are written and counted, in one job. What `part` held before is not counted as
        stored, so a repeated run writes the same rows again.
        """
        stored = self.read(name, without=part)
        return self.append(name, absent_articles(incoming, stored), part)

    def upsert_scores(
        self, incoming: DataFrame, name: str = "scored_headlines", keys=(HASH,)
    ) -> bool:
        """Replace rows by key and keep the table ordered by date inside its files.

        The incoming rows are written first, so that they are computed once. For large tables see
        `tonegauge.sources.keyed`, which rewrites only the folders that an upsert touches.
        """
        stored = self.read(name)
        seen = Observation()
        incoming = materialise(incoming.observe(seen, F.count(F.lit(1)).alias("rows")), "upsert")
        if not seen.get["rows"]:
            return False
        if HASH in keys and HASH not in stored.columns:
            stored = with_headline_hash(stored)
        return self.replace(name, upsert_by_key(stored, incoming, keys), sort_by="date")

    def health(self) -> DataFrame:
        """Row count of every declared table."""
        return table_health({name: self.read(name) for name in self.schemas})

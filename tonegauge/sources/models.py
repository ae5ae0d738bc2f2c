"""Stored models: one folder per version, which counts once its notes are there.

    <path>/version=<n>/<table>/...   the model's tables, or a Spark ML pipeline
    <path>/version=<n>/notes.json    kind, class order, settings; created last
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

NOTES = "notes.json"
PIPELINE = "pipeline"


@dataclass(frozen=True)
class StoredModel:
    version: int
    labels: tuple[str, ...]  # class order of every probability array
    settings: dict
    tables: dict[str, DataFrame]
    pipeline: PipelineModel | None


class ModelStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _hadoop(self, path: str):
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target, target.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """Numbers of the finished versions, oldest first."""
        folder, fs = self._hadoop(self.path)
        if not fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        numbers = sorted(int(n.removeprefix("version=")) for n in names if n.startswith("version="))
        return [n for n in numbers if fs.exists(self._hadoop(f"{self.path}/version={n}/{NOTES}")[0])]

    def save(
        self,
        labels: Sequence[str],
        tables: dict[str, DataFrame] | None = None,
        pipeline: PipelineModel | None = None,
        settings: dict | None = None,
    ) -> int:
        """Store a new version and return its number. One writer at a time."""
        versions = self.versions()
        number = versions[-1] + 1 if versions else 1
        folder = f"{self.path}/version={number}"
        for name, table in (tables or {}).items():
            table.write.mode("overwrite").parquet(f"{folder}/{name}")
        if pipeline is not None:
            pipeline.write().overwrite().save(f"{folder}/{PIPELINE}")
        notes = {"labels": list(labels), "tables": sorted(tables or {}), "pipeline": pipeline is not None, "settings": settings or {}}
        aside, fs = self._hadoop(f"{folder}/.{NOTES}")
        out = fs.create(aside, True)
        out.writeUTF(json.dumps(notes))
        out.close()
        fs.rename(aside, self._hadoop(f"{folder}/{NOTES}")[0])
        return number

    def load(self, version: int | None = None) -> StoredModel:
        """A version, the newest one by default."""
        versions = self.versions()
        if not versions or (version is not None and version not in versions):
            raise FileNotFoundError(f"no model {'' if version is None else f'version {version} '}below {self.path}")
        number = versions[-1] if version is None else version
        folder = f"{self.path}/version={number}"
        file, fs = self._hadoop(f"{folder}/{NOTES}")
        data = fs.open(file)
        try:
            notes = json.loads(data.readUTF())
        finally:
            data.close()
        tables = {name: self.spark.read.parquet(f"{folder}/{name}") for name in notes["tables"]}
        pipeline = PipelineModel.load(f"{folder}/{PIPELINE}") if notes["pipeline"] else None
        return StoredModel(number, tuple(notes["labels"]), notes["settings"], tables, pipeline)

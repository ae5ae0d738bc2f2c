"""What several operators share: reading, folds, bounded training rows, connected components."""

from __future__ import annotations

import sys
from collections.abc import Callable, Hashable
from types import ModuleType
from typing import TypeVar

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from tonegauge.session import materialise

# The white space that separates words everywhere in this package.
SPACE = "[\\x20\\x09-\\x0D]"
WORD = "[^\\x20\\x09-\\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Bound an Arrow batch by rows and bytes: texts may be very long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


T = TypeVar("T")


def kept_in_worker(kind: str, key: Hashable, make: Callable[[], T]) -> T:
    """What a Python worker keeps from task to task: one object per kind, made anew for another key.

    Functions sent by value have no module of their own in a worker, so the place is a module made there.
    """
    place = sys.modules.setdefault("_tonegauge_kept", ModuleType("_tonegauge_kept"))
    held = getattr(place, kind, None)
    if held is None or held[0] != key:
        held = (key, make())
        setattr(place, kind, held)
    return held[1]


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo `parts`; a null id has no fold."""
    return F.crc32(doc_id.cast("string")) % parts


def training_rows(
    docs: DataFrame, labels: DataFrame, label: str, parts: int, held_out: int, per_class: int, purpose: str
) -> DataFrame:
    """At most `per_class` labelled rows of either class outside the held-out fold: doc_id, text, y, half.

    Ids are drawn by hash from the label table alone (the lowest hashes of each class), so no text is
    sorted; the drawn ids, at most 2 * per_class, are broadcast. A doc_id labelled twice counts once,
    with the larger label. The rows are written once. `half` (0 or 1) splits them by hash.
    """
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
        .where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), parts) != held_out))
        .groupBy("doc_id")
        .agg(F.max("y").alias("y"))
        .withColumn("h", F.xxhash64("doc_id", F.lit(label)))
    )
    drawn = None
    for y in (0, 1):
        one = known.where(F.col("y") == y).orderBy("h", "doc_id").limit(per_class)
        drawn = one if drawn is None else drawn.unionByName(one)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(drawn), "doc_id").select(
        "doc_id", "text", "y", F.pmod("h", F.lit(2)).cast("int").alias("half")
    )
    return materialise(rows, purpose)


def row_mark(docs: DataFrame) -> Column:
    """Hash of a row's content: a mark for rows whose ids are null or repeated. Equal rows share it."""
    return F.xxhash64(*docs.columns, *[F.col(c).isNull() for c in docs.columns])


def first_rows(docs: DataFrame, found: DataFrame) -> DataFrame:
    """One row of `docs` for each component of `found` (doc_id, row_mark, component), all columns kept.

    It is the row of the smallest doc_id, null ids last, and of the smallest mark among equal ids. Rows
    are met again by mark and id, so those without an id, or with one id and unlike texts, stay apart.
    """
    first = found.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_mark")).alias("r"))
    kept = first.select(F.col("r.doc_id").alias("__kept"), F.col("r.row_mark").alias("__kept_mark"))
    mark, turn = "__row_mark", "__row_turn"
    rows = docs.withColumn(mark, row_mark(docs))
    same = (F.col(mark) == F.col("__kept_mark")) & F.col("doc_id").cast("long").eqNullSafe(F.col("__kept"))
    return (
        rows.join(kept, same, "left_semi")
        .withColumn(turn, F.row_number().over(Window.partitionBy(mark, "doc_id").orderBy(mark)))  # rows equal in every column
        .where(F.col(turn) == 1)
        .drop(mark, turn)
    )


def connected_components(edges: DataFrame, purpose: str = "components") -> DataFrame:
    """Smallest reachable id of every node of an undirected edge table (a, b): columns id, component_id.

    Alternating large-star and small-star rounds: each connects the neighbours of a node to the least
    of them, by aggregates and joins, until nothing changes. Hubs are minima under partial aggregation
    and one-row-per-key join sides. Every round is a written table below the shared folder.
    """
    a, b = F.col("a"), F.col("b")
    now, mark = _written(
        edges.where("a is not null and b is not null and a <> b").select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(),
        purpose,
    )
    while mark[0]:
        both = now.unionByName(now.select(b.alias("a"), a.alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(b.alias("a"), F.col("m").alias("b"))
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(b.alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        now, new = _written(small.where("a <> b").distinct(), purpose)
        if new == mark:
            break
        mark = new
    members = now.select(a.alias("id"), b.alias("component_id"))
    return members.unionByName(now.select(b.alias("id"), b.alias("component_id")).distinct())


def _written(edges: DataFrame, purpose: str) -> tuple[DataFrame, tuple[int, int]]:
    seen = Observation()
    code = F.xxhash64("a", "b").cast("decimal(38,0)")
    out = materialise(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(code).alias("s")), purpose)
    got = seen.get
    return out, (got["n"], int(got["s"] or 0))

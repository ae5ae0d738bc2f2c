"""SimHash near-duplicates by a segment-popcount embedding.

A 64-bit fingerprint maps to 32 coordinates: the bit counts of its two-bit segments. Each differing bit
moves one coordinate by one, so the Manhattan distance of two embeddings is at most the Hamming
distance of the fingerprints. The search is a range join of radius `LIMIT` on a grid over that space:

* The 32 coordinates form six axes. Within Manhattan distance 3 at least three axes agree in every
  coordinate, so a fingerprint enters one grid cell for each choice of three axes (20 cells), and every
  pair in range meets in a cell. Cells are hashed to 64 bits; a hash collision only adds candidates.
* Inside a cell the Manhattan distance is the lower bound that is tested first, then the exact Hamming
  distance. Equal fingerprints are one row from the start, however many documents share them.
* Cells are walked in sorted order, in vectorised batches. A cell above `BLOCK` members is dealt in
  blocks, every pair of blocks to a task, and returns a spanning forest, never its pairs.

Components of the links come from `common.connected_components`.

Edge cases: null and empty texts have no words and fingerprint zero, which links like any other;
fewer than three words make one shingle; repeated rows share a fingerprint and a component; a null
doc_id keeps its row and takes its class's smallest id. Extra columns are ignored. An empty table
gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonegauge.llm.common import connected_components, first_rows, row_mark, small_batches
from tonegauge.session import materialise

SHINGLE, SEED, LIMIT = 3, 42, 3
AXES = np.array_split(np.arange(32), 6)  # coordinates of each axis
CELLS = list(combinations(range(6), 3))
BLOCK = 4096  # members of a cell that one task compares at once
TOKENS = re.compile(rb"[^ \t-\r]+")


def fingerprint(text: str | None) -> int:
    """Bit i is set if more than half of the shingle hashes set it; zero without words."""
    words = TOKENS.findall((text or "").encode("utf-8", "surrogatepass").lower())  # bytes: A-Z only
    if not words:
        return 0
    if len(words) < SHINGLE:
        shingles: Iterator[bytes] = iter([b" ".join(words)])
    else:
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        shingles = (joined[a:b] for a, b in zip(starts[: 1 - SHINGLE].tolist(), ends[SHINGLE - 1 :].tolist()))
    return majority(np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), np.uint64))


def majority(h: np.ndarray) -> int:
    """The fingerprint of shingle hashes: bit i is set if more than half of them set it."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 14):  # bounded memory for very long texts
        part = h[at : at + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, marked: bool = False) -> DataFrame:
    """doc_id, fp (signed long) and on demand row_mark of every row; one pass, no shuffle."""
    small_batches(docs.sparkSession)
    names = ["doc_id", "row_mark"] if marked else ["doc_id"]

    def computed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = np.array([fingerprint(t) for t in batch.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*map(batch.column, names), pa.array(f)], [*names, "fp"])

    marks = [row_mark(docs).alias("row_mark")] if marked else []
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *marks, F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(computed, ", ".join(f"{n} long" for n in [*names, "fp"]))


def embed(f: np.ndarray) -> np.ndarray:
    """Bit counts of the 32 two-bit segments, one row per fingerprint."""
    bits = np.unpackbits(f.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits[:, 0::2] + bits[:, 1::2]


def cell_keys(f: np.ndarray) -> np.ndarray:
    """One 64-bit key for each choice of three axes: the coordinates on them, mixed."""
    e = embed(f).astype(np.uint64)
    axes = []
    for n, axis in enumerate(AXES):
        code = np.zeros(len(f), np.uint64)
        for c in axis:
            code = code * np.uint64(3) + e[:, c]
        axes.append(_mix(code + np.uint64(1000003 * (n + 1))))
    keys = [_mix(axes[i] * np.uint64(3) + axes[j] * np.uint64(5) + axes[k] * np.uint64(7) + np.uint64(n)) for n, (i, j, k) in enumerate(CELLS)]
    return np.stack(keys, axis=1).view(np.int64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _near(x: np.ndarray, ex: np.ndarray, y: np.ndarray, ey: np.ndarray) -> np.ndarray:
    """Lower bound first, exact distance only where it holds; rows of x against all of y."""
    near = np.zeros((len(x), len(y)), bool)
    i, j = np.nonzero(np.abs(ex[:, None, :] - ey[None, :, :]).sum(2, dtype=np.int16) <= LIMIT) if len(y) <= 64 else np.nonzero(_bound(ex, ey) <= LIMIT)
    near[i, j] = np.bitwise_count(x[i] ^ y[j]) <= LIMIT
    return near


def _bound(ex: np.ndarray, ey: np.ndarray) -> np.ndarray:
    """Manhattan distance of counts 0..2: |a-b| summed as the distance of unary codes, by matrix product."""
    a = np.concatenate([ex >= 1, ex >= 2], axis=1).astype(np.float32)
    b = np.concatenate([ey >= 1, ey >= 2], axis=1).astype(np.float32)
    return a.sum(1)[:, None] + b.sum(1)[None, :] - 2 * (a @ b.T)


def forest(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (member, smallest position of its component) of the links among distinct fingerprints."""
    e, n = embed(x).astype(np.int8), len(x)
    label = np.arange(n)
    while True:
        before = label.copy()
        for at in range(0, n, 512):
            near = _near(x[at : at + 512], e[at : at + 512], x, e)
            least = np.where(near, label[None, :], n).min(1)
            i, j = np.nonzero(near)
            np.minimum.at(label, j, least[i])  # both ways, so a hub passes its label on at once
            label[at : at + 512] = np.minimum(label[at : at + 512], least)
        label = label[label]
        if np.array_equal(label, before):
            members = np.flatnonzero(label != np.arange(n))
            return members, label[members]


def links(fps: DataFrame) -> DataFrame:
    """Edges (a, b) over distinct fingerprints `fp` whose components are those of all links."""
    small_batches(fps.sparkSession, 20_000)

    def celled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = batch.column("fp").to_numpy(zero_copy_only=False).astype(np.int64)
            keys = cell_keys(f.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(f, len(CELLS)))], ["cell", "fp"])

    members = fps.select("fp").mapInArrow(celled, "cell long, fp long")
    crowded = members.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # A cell of up to BLOCK members is one group (0, 0); a larger one a group for every pair of blocks.
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("fp", F.lit("block")), F.col("blocks")).cast("int")
    dealt = (
        members.join(crowded, "cell")
        .withColumn("blocks", blocks)
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("cell", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp")
    )
    grouped = dealt.withColumn("g", F.xxhash64("cell", "i", "j")).select("g", "fp").repartition("g").sortWithinPartitions("g", "fp")

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, f = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            g = np.concatenate([g, batch.column("g").to_numpy()])
            f = np.concatenate([f, batch.column("fp").to_numpy()])
            done = int(np.searchsorted(g, g[-1])) if len(g) else 0  # the last group may go on
            yield _edges(*_runs(g[:done], f[:done]))
            g, f = g[done:], f[done:]
        yield _edges(*_runs(g, f))

    return grouped.mapInArrow(linked, "a long, b long").distinct()


def _runs(g: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links inside each run of equal g: pairs at once, longer runs one by one."""
    if not len(g):
        return f, f
    starts = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
    sizes = np.diff(np.append(starts, len(g)))
    two = starts[sizes == 2]
    x, y = f[two].view(np.uint64), f[two + 1].view(np.uint64)
    bound = np.abs(embed(x).astype(np.int8) - embed(y).astype(np.int8)).sum(1) <= LIMIT if len(x) else np.zeros(0, bool)
    hit = np.zeros(len(x), bool)
    hit[bound] = np.bitwise_count(x[bound] ^ y[bound]) <= LIMIT
    a, b = [f[two][hit]], [f[two + 1][hit]]
    for at, n in zip(starts[sizes > 2], sizes[sizes > 2]):
        run = f[at : at + n]
        member, least = forest(run.view(np.uint64))
        a.append(run[member])
        b.append(run[least])
    return np.concatenate(a), np.concatenate(b)


def _edges(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp, component_id of every row; component_id is the smallest doc_id reachable by links."""
    marked = materialise(fingerprints(docs), "simhash")
    classes = materialise(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-classes")
    parts = connected_components(links(classes), "simhash-parts")
    # Components are over fingerprints; their smallest document follows from the classes.
    joined = parts.join(classes.withColumnRenamed("fp", "id"), "id")
    least = joined.groupBy("component_id").agg(F.min("least").alias("component"))
    moved = parts.join(least, "component_id").select(F.col("id").alias("fp"), "component")
    every = classes.join(moved, "fp", "left").select("fp", F.coalesce("component", "least").alias("component_id"))
    return marked.join(every, "fp").select("doc_id", "fp", "component_id")


def simhash_near_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint as 16 hex digits, component_id."""
    found = near_duplicates(docs)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of `docs` for each component, all columns kept: see `common.first_rows`."""
    marked = materialise(fingerprints(docs, marked=True), "simhash")
    parts = connected_components(links(materialise(marked.select("fp").distinct(), "simhash-classes")), "simhash-parts")
    found = marked.join(parts.withColumnRenamed("id", "fp"), "fp", "left")
    return first_rows(docs, found.withColumn("component", F.coalesce("component_id", "fp")))

"""Near-duplicate vectors by an inverted multi-index.

* Two codebooks, one for each half of the unit vectors, are fitted on at most `FIT_ROWS` vectors; their
  product is a grid of `CENTRES` ** 2 cells. Every vector is indexed in its own cell.
* A query walks the cells in order of the summed distances of its halves (multi-sequence order: the
  n best cells lie on the staircase (i + 1) * (j + 1) <= n of the two sorted lists). The length of the
  walk is the shortest that reaches `RECALL` for partners exactly at the limit, the hardest links,
  measured on the fitted sample. Where vectors crowd around one direction that may be the whole grid,
  which is then walked: the walk has no cap, and at its end it is exact.
* Every candidate is verified by its cosine in double precision. A link counts for both ends: the query's
  walk adds it to the query, and to its partner too where the partner's walk does not come by.
* Equal vectors are one row with a count. A cell with many members or visitors is dealt in blocks of
  `BLOCK` by `BLOCK`; a task returns counts per vector and a spanning forest, never its pairs.

Every length of vector that makes up a sixteenth of the sample or more has codebooks of its own. The other
lengths have one cell each, which is compared whole, in the same blocks.

Edge cases: vectors that are null, empty, zero, or hold null or non-finite components link with nothing
(n_links 0, a component of their own, kept); vectors of different lengths never link; components of any
finite size are scaled exactly before they are squared; repeated vec_ids are rows of their own that share a
component; an empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from tonegauge.llm.common import connected_components, small_batches
from tonegauge.session import materialise

LIMIT, RECALL = 0.95, 0.98
FIT_ROWS, CENTRES, ROUNDS = 4096, 32, 12
BLOCK = 2048
GRID = CENTRES * CENTRES
INDEXED = 16  # most lengths of vector that get codebooks
BLOCK_BITS = 20  # of a group's number, for either block


def unit(raw: list[bytes], number: str) -> np.ndarray:
    """Unit vectors, all of one length, from components stored as `number`."""
    x = np.frombuffer(b"".join(raw), number).reshape(len(raw), -1).astype(np.float64)
    x = np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def codebook(x: np.ndarray, centres: int) -> np.ndarray:
    """Lloyd's algorithm from a seeded draw; empty centres keep their place."""
    draw = np.random.default_rng(11)
    c = x[draw.permutation(len(x))[: min(centres, len(x))]].copy()
    for _ in range(ROUNDS):
        near = distances(x, c).argmin(1)
        for k in range(len(c)):
            if (near == k).any():
                c[k] = x[near == k].mean(0)
    return c


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] + (c * c).sum(1)[None, :] - 2 * (x @ c.T), 0.0)


def walk(x: np.ndarray, books: tuple[np.ndarray, np.ndarray], length: int) -> np.ndarray:
    """The first `length` cells of every row's traversal, its own cell first."""
    half = x.shape[1] // 2
    d = [distances(x[:, :half], books[0]), distances(x[:, half:], books[1])]
    order = [v.argsort(1, kind="stable") for v in d]
    ranked = [np.take_along_axis(v, o, 1) for v, o in zip(d, order)]
    i, j = np.nonzero((np.arange(1, len(books[0]) + 1)[:, None] * np.arange(1, len(books[1]) + 1)[None, :]) <= length)
    best = (ranked[0][:, i] + ranked[1][:, j]).argsort(1, kind="stable")[:, :length]
    return (np.take_along_axis(order[0], i[best], 1) * len(books[1]) + np.take_along_axis(order[1], j[best], 1)).astype(np.int32)


def walk_length(x: np.ndarray, books: tuple[np.ndarray, np.ndarray]) -> int:
    """Shortest walk that meets a partner, from either end, with probability `RECALL`.

    Measured twice, the longer walk counts: for partners at cosine `LIMIT` in any direction, and for the
    links within the sample itself. Those say more where vectors crowd around one direction: there two
    vectors may link although what tells them apart from the crowd, and so their cells, has nothing in common.
    """
    most = len(books[0]) * len(books[1])
    noise = np.random.default_rng(13).normal(size=x.shape)
    noise -= (noise * x).sum(1, keepdims=True) * x
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    y = LIMIT * x + np.sqrt(1 - LIMIT**2) * noise
    a, b = steps_to(x, books, most), steps_to(y, books, most)
    rows = np.arange(len(x))
    own, other = a.argmin(1), b.argmin(1)
    steps = np.minimum(a[rows, other], b[rows, own]) + 1
    length = int(np.quantile(steps, RECALL, method="higher"))
    counts = np.zeros(most + 1, np.int64)
    for start in range(0, len(x), 512):
        linked = x[start : start + 512] @ x.T >= LIMIT
        i, j = np.nonzero(linked & (rows[None, :] > rows[start : start + 512, None]))
        i += start
        counts += np.bincount(np.minimum(a[i, own[j]], a[j, own[i]]) + 1, minlength=most + 1)
    if counts.any():
        length = max(length, int(np.searchsorted(np.cumsum(counts), RECALL * counts.sum())))
    return length


def steps_to(x: np.ndarray, books: tuple[np.ndarray, np.ndarray], most: int) -> np.ndarray:
    """Place of every cell of the grid in every row's walk."""
    order = walk(x, books, most)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.broadcast_to(np.arange(most, dtype=order.dtype), order.shape), 1)
    return place


def near_duplicates(vectors: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    small_batches(vectors.sparkSession, 2000)
    kind = vectors.schema["embedding"].dataType
    single = isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType)
    number, item = ("<f4", 4) if single else ("<f8", 8)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, key = [], []
            for v in batch.column("embedding").to_pylist():
                x = None
                if v and None not in v:
                    x = np.array(v, number)
                    if not (np.isfinite(x).all() and x.any()):
                        x = None
                raw.append(None if x is None else x.tobytes())
                key.append(None if x is None else hashlib.md5(x.tobytes()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(raw, pa.binary()), pa.array(key, pa.string())], ["vec_id", "raw", "key"])

    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>" if single else "array<double>").alias("embedding"))
    marked = materialise(rows.mapInArrow(keyed, "vec_id long, raw binary, key string"), "vectors")
    classes = materialise(
        marked.where("key is not null and vec_id is not null")
        .groupBy("key")
        .agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("n"), F.first("raw").alias("raw")),
        "vector-classes",
    )
    sample = classes.select("raw").orderBy(F.xxhash64("key")).limit(FIT_ROWS).toArrow().column("raw").to_pylist()
    if not len(sample):
        return marked.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    widths, counts = np.unique([len(r) // item for r in sample], return_counts=True)
    index = {}
    for width in widths[counts * INDEXED >= len(sample)].tolist():
        x = unit([r for r in sample if len(r) == item * width], number)
        books = (codebook(x[:, : width // 2], CENTRES), codebook(x[:, width // 2 :], CENTRES))
        index[width] = (GRID * len(index), books, walk_length(x, books))

    def walks_of(raw: list[bytes], width: int) -> np.ndarray:
        if width not in index:
            return np.full((len(raw), 1), GRID * INDEXED + width, np.int32)
        first, books, length = index[width]
        return walk(unit(raw, number), books, length) + np.int32(first)

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column("raw").to_pylist()
            width = np.array([len(r) // item for r in raw])
            walks = [b""] * len(raw)
            for w in np.unique(width).tolist():
                at = np.flatnonzero(width == w).tolist()
                for k, cells in zip(at, walks_of([raw[k] for k in at], w)):
                    walks[k] = cells.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n"), batch.column("raw"), pa.array(walks, pa.binary())], ["id", "n", "raw", "walk"])

    indexed = materialise(classes.select("id", "n", "raw").mapInArrow(visits, "id long, n long, raw binary, walk binary"), "vector-index")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list[int]] = {}
        for batch in batches:
            walks = [np.frombuffer(w, np.int32) for w in batch.column("walk").to_pylist()]
            if walks:
                for k, cells in enumerate(([w[0] for w in walks], np.concatenate(walks))):
                    for cell, n in zip(*(v.tolist() for v in np.unique(cells, return_counts=True))):
                        total.setdefault(cell, [0, 0])[k] += n
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), *(pa.array([v[k] for v in total.values()], pa.int64()) for k in (0, 1))], ["cell", "members", "visitors"])

    # One row per cell: GRID for each of at most INDEXED lengths, one for any other length.
    cells = indexed.mapInArrow(counted, "cell long, members long, visitors long").groupBy("cell").agg(F.sum("members").alias("members"), F.sum("visitors").alias("visitors")).collect()
    parts = np.zeros((2, max((r["cell"] for r in cells), default=0) + 1), np.int64)
    for r in cells:
        if r["members"]:
            parts[:, r["cell"]] = -(-r["members"] // BLOCK), -(-r["visitors"] // BLOCK)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Members go to every block of visitors of their cell, visitors to every block of members."""
        for batch in batches:
            group, visitor, at = [], [], []
            walks = [np.frombuffer(w, np.int32) for w in batch.column("walk").to_pylist()]
            for k, (i, w) in enumerate(zip(batch.column("id").to_pylist(), walks)):
                for cell in w[parts[0, w] > 0].tolist():
                    m, q = parts[:, cell]
                    own = (i * 2654435761 + cell * 40503 >> 5) % int(q)
                    for block in range(m):
                        group.append((cell << 2 * BLOCK_BITS) + (block << BLOCK_BITS) + own)
                        visitor.append(True)
                        at.append(k)
                cell = int(w[0])
                m, q = parts[:, cell]
                own = (i * 2246822519 + cell * 40503 >> 5) % int(m)
                for block in range(q):
                    group.append((cell << 2 * BLOCK_BITS) + (own << BLOCK_BITS) + block)
                    visitor.append(False)
                    at.append(k)
            took = pa.array(at, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(group, pa.int64()), pa.array(visitor, pa.bool_()), *(batch.column(c).take(took) for c in ("id", "n", "raw", "walk"))],
                ["grp", "visitor", "id", "n", "raw", "walk"],
            )

    def verified(g: pd.DataFrame) -> pd.DataFrame:
        q, m = g[g["visitor"]], g[~g["visitor"]]
        if not len(q) or not len(m):
            return pd.DataFrame({"id": pd.Series(dtype="int64"), "links": pd.Series(dtype="int64"), "least": pd.Series(dtype="int64")})
        a, b = unit(q["raw"].tolist(), number), unit(m["raw"].tolist(), number)
        ia, ib, na, nb = q["id"].to_numpy(), m["id"].to_numpy(), q["n"].to_numpy(), m["n"].to_numpy()
        own = np.array([np.frombuffer(w[:4], np.int32)[0] for w in q["walk"]])
        walks = np.frombuffer(b"".join(m["walk"]), np.int32).reshape(len(m), -1)
        near = np.zeros((len(q), len(m)), bool)
        got_a, got_b = np.zeros(len(q), np.int64), np.zeros(len(m), np.int64)
        for s in range(0, len(q), 128):
            hit = (a[s : s + 128] @ b.T >= LIMIT) & (ia[s : s + 128, None] != ib[None, :])
            near[s : s + 128] = hit
            i, j = np.nonzero(hit)
            np.add.at(got_a, i + s, nb[j])
            back = (walks[j] == own[i + s][:, None]).any(1)  # the partner's walk finds this link itself
            np.add.at(got_b, j[~back], na[i + s][~back])
        la, lb = ia.copy(), ib.copy()
        while True:
            before = (la.copy(), lb.copy())
            top = np.iinfo(np.int64).max
            for s in range(0, len(q), 256):
                part = near[s : s + 256]
                la[s : s + 256] = np.minimum(la[s : s + 256], np.where(part, lb[None, :], top).min(1))
                lb = np.minimum(lb, np.where(part, la[s : s + 256, None], top).min(0))
            if np.array_equal(la, before[0]) and np.array_equal(lb, before[1]):
                break
        out = pd.DataFrame({"id": np.concatenate([ia, ib]), "links": np.concatenate([got_a, got_b]), "least": np.concatenate([la, lb])})
        return out[(out["links"] > 0) | (out["least"] != out["id"])]

    found = materialise(
        indexed.mapInArrow(dealt, "grp long, visitor boolean, id long, n long, raw binary, walk binary")
        .groupBy("grp")
        .applyInPandas(verified, "id long, links long, least long"),
        "vector-links",
    )
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    components = connected_components(found.where("id <> least").select(F.col("id").alias("a"), F.col("least").alias("b")), "vector-parts")
    every = (
        classes.select("key", "id", "n")
        .join(links, "id", "left")
        .join(components, "id", "left")
        .select("key", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    )
    alone = marked.where("key is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    linked = marked.where("key is not null").join(every, "key", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))

"""Ranked lexical search by best positions over impact lists.

Every document is scored for every item of a query table; the best `TOP` of each item come back. The
work goes in blocks of items (`ITEM_BYTES` of text each, so what travels to the tasks is bounded) and,
inside a task, in blocks of postings:

1. One pass over whole texts counts each document's terms and, for the terms of the items, their
   frequencies (one row a document, written once). Totals and document frequencies come from these rows.
2. A task lays its documents, `POSTINGS` at a time, out as one impact list per term, highest impact first.
   For an item it keeps a best position per list: up to there every position has been seen. It reads the
   next positions behind the best ones directly; a document met there is scored at once through direct
   accesses to its places in the other lists, which counts as seeing them, so best positions also
   move past documents met elsewhere. What has not been seen anywhere can score at most the sum of the impacts just
   behind the best positions. Once that bound is strictly below the item's k-th score no other document, a
   tied one included, can enter, and the item ends. k-th scores carry over from block to block.
3. The best of each task meet per item, first in `SALTS` groups, then in one of `SALTS * TOP` rows at most.

Scores are 64-bit integers; equal ones rank by ascending doc_id.

Edge cases: a null or empty text has no terms, takes no part and counts nowhere; items with one id (null
is an id too) are one item with the terms of all; an item without terms, or whose terms no document holds,
has no rows; repeated documents rank one by one, null ids last; an empty table on either side gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tonegauge.llm.common import small_batches
from tonegauge.session import materialise

TOP, SALTS = 50, 32
ITEM_BYTES = 4 << 20  # text of the items that are looked for in one pass
POSTINGS = 1 << 20  # postings of a block, one document more at most
STEP = 64  # positions read from each list in the first turn; doubled from turn to turn

# What a term is made of. ASCII digits and letters, and everything above ASCII; A-Z in lower case.
TERM_BYTES = [*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]
TABLE = bytes(b if b in TERM_BYTES else 0x20 for b in bytes(range(256)).lower()[:128]) + bytes(range(128, 256))


def terms(text: bytes) -> list[bytes]:
    """Terms of a UTF-8 text, in order."""
    return text.translate(TABLE).split()


class Lists:
    """The impact lists of one block of documents, highest impact first, then by row."""

    def __init__(self, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, docs: int, n_terms: int):
        # Postings come in document order; `place` is where each of them stands in the lists.
        order = np.lexsort((doc, -impact, term))
        self.place = np.empty(len(order), np.int64)
        self.place[order] = np.arange(len(order))
        self.doc, self.impact = doc[order], impact[order]
        self.starts = np.searchsorted(term[order], np.arange(n_terms + 1))
        self.first = np.searchsorted(doc, np.arange(docs + 1))  # postings of each document
        self.term, self.of_doc = term, impact
        self.seen = np.zeros(len(order), bool)
        self.wanted = np.zeros(n_terms, bool)

    def scored(self, docs: np.ndarray) -> np.ndarray:
        """Scores of documents by direct access to all their places, which are marked as seen."""
        sizes = self.first[docs + 1] - self.first[docs]
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1]) + np.repeat(self.first[docs] - (ends - sizes), sizes)
        used = self.wanted[self.term[at]]
        self.seen[self.place[at[used]]] = True
        return np.add.reduceat(np.where(used, self.of_doc[at], 0), ends - sizes)


class Best:
    """The best rows of one item so far: scores and ids, in rank order."""

    def __init__(self, k: int):
        self.k = k
        self.score, self.none, self.doc_id = (np.zeros(0, kind) for kind in (np.int64, bool, np.int64))

    def kth(self) -> int:
        return int(self.score[-1]) if len(self.score) == self.k else 1

    def add(self, score: np.ndarray, none: np.ndarray, doc_id: np.ndarray) -> None:
        score, none, doc_id = (np.concatenate(x) for x in ((self.score, score), (self.none, none), (self.doc_id, doc_id)))
        order = np.lexsort((doc_id, none, -score))[: self.k]
        self.score, self.none, self.doc_id = score[order], none[order], doc_id[order]


def best_positions(lists: Lists, wanted: np.ndarray, none: np.ndarray, doc_id: np.ndarray, best: Best) -> int:
    """Bring the block's documents for one item into `best`; the number of documents that were scored."""
    used = wanted[lists.starts[wanted] < lists.starts[wanted + 1]]
    lists.wanted[used] = True
    at, ends = lists.starts[used].copy(), lists.starts[used + 1]  # best position of each list, and its end
    step, scored = STEP, 0
    while True:
        open_ = at < ends
        if not open_.any() or int(lists.impact[at[open_]].sum()) < best.kth():
            break
        read = np.concatenate([np.arange(a, min(a + step, e)) for a, e in zip(at[open_], ends[open_])])
        docs = np.unique(lists.doc[read[~lists.seen[read]]])
        score = lists.scored(docs)
        scored += len(docs)
        enough = score >= best.kth()
        best.add(score[enough], none[docs[enough]], doc_id[docs[enough]])
        for i in np.flatnonzero(open_):  # past everything that is seen by now
            rest = lists.seen[at[i] : ends[i]]
            gap = int(rest.argmin())
            at[i] = at[i] + gap if not rest[gap] else ends[i]
        step *= 2
    for start, end in zip(lists.starts[used], ends):
        lists.seen[start:end] = False
    lists.wanted[used] = False
    return scored


def postings(docs: DataFrame, ids: dict[bytes, int]) -> DataFrame:
    """doc_id, n, term numbers and frequencies of every document that has a term."""
    small_batches(docs.sparkSession)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text"))):
                said = terms(text or b"")
                if said:
                    found = Counter(map(ids.get, said))
                    found.pop(None, None)
                    term = np.fromiter(found, np.uint32, len(found))
                    tf = np.fromiter(found.values(), np.uint32, len(found))
                    rows.append((doc_id, len(said), term.tobytes(), tf.tobytes()))
            columns = [pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 4, (pa.int64(), pa.int64(), pa.binary(), pa.binary()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "term", "tf"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return materialise(rows.mapInArrow(counted, "doc_id long, n long, term binary, tf binary"), "postings")


def document_frequencies(rows: DataFrame, n_terms: int) -> np.ndarray:
    """Documents that hold each term, summed per task and then over all; `n_terms` numbers in all."""

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(n_terms, np.int64)
        for batch in batches:
            df += np.bincount(np.frombuffer(b"".join(batch.column("term").to_pylist()), np.uint32), minlength=n_terms)
        used = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(df[used])], ["term", "df"])

    df = np.zeros(n_terms, np.int64)
    for r in rows.select("term").mapInArrow(held, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        df[r["term"]] = r["df"]
    return df


def search_block(docs: DataFrame, items: dict[int | None, set[bytes]], k: int) -> DataFrame:
    """item_id, rank, doc_id, score for a bounded number of items."""
    ids = {t: i for i, t in enumerate(sorted(set().union(*items.values())))}
    rows = postings(docs, ids)
    total = rows.agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    n_docs, n_said = total["docs"], total["terms"]
    df = document_frequencies(rows, len(ids))
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
    wanted = [(i, np.sort(np.fromiter(map(ids.__getitem__, said), np.int64, len(said)))) for i, said in items.items()]

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k) for _ in wanted]

        def block(doc_ids: list, said: list, term: list, tf: list) -> None:
            sizes = [len(t) // 4 for t in term]
            doc = np.repeat(np.arange(len(said)), sizes)
            number = np.frombuffer(b"".join(term), np.uint32).astype(np.int64)
            often = np.frombuffer(b"".join(tf), np.uint32).astype(np.int64)
            # Python numbers do not overflow before the division.
            m = np.array([100 - 50 + (50 * n * n_docs) // n_said for n in said], np.int64)
            impact = weight[number] * ((1_000_000_000 * often) // (1000 * often + 20 * m[doc]))
            counts = impact > 0
            lists = Lists(doc[counts], number[counts], impact[counts], len(said), len(ids))
            none = np.array([d is None for d in doc_ids], bool)
            known = np.array([0 if d is None else d for d in doc_ids], np.int64)
            for (_, numbers), found in zip(wanted, best):
                best_positions(lists, numbers, none, known, found)

        held: tuple[list, list, list, list] = ([], [], [], [])
        size = 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n", "term", "tf"))):
                if row[2]:
                    for column, value in zip(held, row):
                        column.append(value)
                    size += len(row[2]) // 4
                    if size >= POSTINGS:
                        block(*held)
                        held, size = ([], [], [], []), 0
        if size:
            block(*held)
        for (item, _), found in zip(wanted, best):
            n = len(found.score)
            doc_id = pa.array(found.doc_id, pa.int64(), mask=found.none)
            yield pa.RecordBatch.from_arrays([pa.array([item] * n, pa.int64()), doc_id, pa.array(found.score)], ["item_id", "doc_id", "score"])

    found = rows.mapInArrow(searched, "item_id long, doc_id long, score long").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    for keys in (["item_id", "salt"], ["item_id"]):
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)
    return found.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def ranked_search(docs: DataFrame, queries: DataFrame, k: int = TOP, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: the `k` best documents of every item, score above 0."""
    asked = queries.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").cast("binary").alias("text"))
    size = asked.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()["bytes"]
    blocks = max(1, -(-size // item_bytes))
    done = []
    for block in range(blocks):
        items: dict[int | None, set[bytes]] = {}
        for r in asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).toLocalIterator():
            items.setdefault(r["item_id"], set()).update(terms(bytes(r["text"] or b"")))
        items = {i: said for i, said in items.items() if said}
        if items:
            done.append(search_block(docs, items, k))
    if not done:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return reduce(DataFrame.unionByName, done)


RANKED_SQL = r"""
WITH doc AS (
  SELECT doc_id, row_number() OVER () AS r,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS said
  FROM documents),
total AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(len(said)) AS BIGINT) AS terms FROM doc WHERE len(said) > 0),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
held AS (
  SELECT r, doc_id, n, term, CAST(count(*) AS BIGINT) AS tf
  FROM (SELECT r, doc_id, CAST(len(said) AS BIGINT) AS n, unnest(said) AS term FROM doc)
  WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weight AS (
  SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM held, total GROUP BY term, docs),
impact AS (
  SELECT r, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // terms))) AS i
  FROM held JOIN weight USING (term), total),
scored AS (
  SELECT item_id, doc_id, CAST(sum(i) AS BIGINT) AS score FROM asked JOIN impact USING (term) GROUP BY item_id, r, doc_id),
ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score
  FROM scored WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 50
"""

"""Fill-in-the-middle by in-place block rotation, and its exact inverse.

A text lies in a bytearray as prefix, middle, suffix. Its two cuts are found by scanning the line ends;
then the three marks are inserted in front of their segments, and two neighbouring blocks change places
by three reversals (each block, then both together), within the array and with one bounded scrap of
`SCRAP` bytes. Suffix before prefix rotates [prefix middle][suffix]; prefix, suffix, middle rotates
[middle][suffix]. `restore` finds the marks, turns the same blocks back and takes the marks out.

Everything runs on UTF-8 bytes: lines end at one byte and marks are searched as bytes, so a text of any
content, ill-formed UTF-8 included, comes back byte by byte. Marks must not overlap each other or
themselves; only then can no mark arise where a text and a mark meet.

The draws of a document come from a hash of the seed and its id alone, so equal ids draw alike and
reruns agree. One pass over whole texts without a shuffle; a task holds one bounded batch of rows.

Edge cases: a null text counts as empty; an empty text, or one that holds a mark, stays as it is with
form `plain` and null lengths; a null id draws as the empty id; repeated rows give repeated rows; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonegauge.llm.common import small_batches

PLAIN, PSM, SPM = "plain", "psm", "spm"
SCRAP = 1 << 16
LINE_END = 0x0A
MADE = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output binary"


@dataclass(frozen=True)
class Settings:
    seed: int = 7
    rate: int = 100  # per hundred documents, how many are rearranged
    spm_rate: int = 50  # per hundred of these, how many put the suffix first
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self):
        marks = [self.prefix, self.suffix, self.middle]
        for a in marks:
            for b in marks:
                # What may overlap: the end of one with the beginning of another, or one inside another.
                meets = any(a.endswith(b[:k]) for k in range(1, len(b)))
                if not a or meets or (a is not b and b in a):
                    raise ValueError(f"marks overlap: {a!r} and {b!r}")

    @property
    def marks(self) -> tuple[bytes, bytes, bytes]:
        """Prefix, suffix and middle mark as bytes."""
        return self.prefix.encode(), self.suffix.encode(), self.middle.encode()


def reverse(view: np.ndarray, start: int, end: int) -> None:
    """Reverse view[start:end] in place, block by block from both ends."""
    while end - start > 1:
        size = min(SCRAP, (end - start) // 2)
        low = view[start : start + size][::-1].copy()
        view[start : start + size] = view[end - size : end][::-1]
        view[end - size : end] = low
        start, end = start + size, end - size


def rotate(buffer: bytearray, start: int, cut: int, end: int) -> None:
    """Let buffer[start:cut] and buffer[cut:end] change places."""
    view = np.frombuffer(buffer, np.uint8)
    reverse(view, start, cut)
    reverse(view, cut, end)
    reverse(view, start, end)


def draws(doc_id: int | None, seed: int) -> list[int]:
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[at : at + 4], "big") for at in (0, 4, 8, 12)]


def chars(view: np.ndarray) -> int:
    """Code points of UTF-8 bytes: all bytes but the continuing ones."""
    return int(np.count_nonzero((view & 0xC0) != 0x80))


def arrange(text: bytes, doc_id: int | None, settings: Settings) -> tuple[int, str, int | None, int | None, bytes]:
    """Lines, form, code points of prefix and middle, and the output of one text."""
    view = np.frombuffer(text, np.uint8)
    ends = np.flatnonzero(view == LINE_END) + 1
    if len(text) and (not len(ends) or ends[-1] != len(text)):
        ends = np.append(ends, len(text))
    n = len(ends)
    marks = settings.marks
    h1, h2, h3, h4 = draws(doc_id, settings.seed)
    if not text or h3 % 100 >= settings.rate or any(m in text for m in marks):
        return n, PLAIN, None, None, text
    form = SPM if h4 % 100 < settings.spm_rate else PSM
    first, last = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = (int(ends[k - 1]) if k else 0 for k in (first, last))
    prefix_mark, suffix_mark, middle_mark = marks
    buffer = bytearray(text)
    buffer[b:b] = suffix_mark  # from the back, so that the cuts in front stay where they are
    buffer[a:a] = middle_mark
    buffer[0:0] = prefix_mark
    a += len(prefix_mark)
    b += len(prefix_mark) + len(middle_mark)
    rotate(buffer, 0 if form == SPM else a, b, len(buffer))
    return n, form, chars(view[: int(ends[first - 1]) if first else 0]), chars(view[int(ends[first - 1]) if first else 0 : int(ends[last - 1]) if last else 0]), bytes(buffer)


def rearranged_back(output: bytes, form: str, settings: Settings) -> bytes:
    """The text behind an output."""
    if form == PLAIN:
        return output
    prefix_mark, suffix_mark, middle_mark = settings.marks
    buffer = bytearray(output)
    if form == SPM:  # suffix, prefix, middle: the suffix goes back behind the others
        cut = buffer.index(prefix_mark)
        rotate(buffer, 0, cut, len(buffer))
    else:  # prefix, suffix, middle
        start, cut = buffer.index(suffix_mark), buffer.index(middle_mark)
        rotate(buffer, start, cut, len(buffer))
    for mark in (suffix_mark, middle_mark, prefix_mark):
        at = buffer.index(mark)
        del buffer[at : at + len(mark)]
    return bytes(buffer)


def fill_in_middle(docs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output (text) of every row."""
    settings = settings or Settings()
    small_batches(docs.sparkSession)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary())
        names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
        for batch in batches:
            ids, texts = (batch.column(c).to_pylist() for c in ("doc_id", "text"))
            rows = [(i, *arrange(t or b"", i, settings)) for i, t in zip(ids, texts)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 6, kinds)], names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(made, MADE).withColumn("output", F.col("output").cast("string"))


def restore(made: DataFrame, settings: Settings | None = None) -> DataFrame:
    """`made` (with `output` and `form`) and the text it came from as `restored`."""
    settings = settings or Settings()
    small_batches(made.sparkSession)
    names, at_output, at_form = made.columns, made.columns.index("output"), made.columns.index("form")

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            outputs, forms = (batch.column(at).to_pylist() for at in (at_output, at_form))
            texts = pa.array([rearranged_back(o, f, settings) for o, f in zip(outputs, forms)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], [*names, "restored"])

    kinds = ", ".join(f"`{f.name}` {'binary' if f.name == 'output' else f.dataType.simpleString()}" for f in made.schema)
    return (
        made.withColumn("output", F.col("output").cast("binary"))
        .mapInArrow(back, f"{kinds}, restored binary")
        .withColumns({c: F.col(c).cast("string") for c in ("output", "restored")})
    )


def digests(docs: DataFrame) -> DataFrame:
    """The digest columns of the operator's query: hashes of the output and of the text rebuilt from it."""
    made = restore(fill_in_middle(docs))
    return made.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2("restored", 256).alias("restored_sha256"),
    )


# The same digests in DuckDB: lines by a pattern, slices of the list of lines, joined again.
DIGESTS_SQL = r"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS lines,
         sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS hex
  FROM documents),
drawn AS (
  SELECT *, len(lines) AS n,
         CAST('0x' || substr(hex, 1, 8) AS UBIGINT) % (len(lines) + 1) AS c1,
         CAST('0x' || substr(hex, 9, 8) AS UBIGINT) % (len(lines) + 1) AS c2,
         CAST('0x' || substr(hex, 25, 8) AS UBIGINT) % 100 AS side
  FROM cut),
parts AS (
  SELECT doc_id, text, CAST(n AS BIGINT) AS n,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') THEN 'plain'
              WHEN side < 50 THEN 'spm' ELSE 'psm' END AS form,
         array_to_string(lines[1:least(c1, c2)], '') AS prefix,
         array_to_string(lines[least(c1, c2) + 1:greatest(c1, c2)], '') AS middle,
         array_to_string(lines[greatest(c1, c2) + 1:], '') AS suffix
  FROM drawn)
SELECT doc_id, n, form,
       CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text
                        WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
"""

"""Sum-of-squares packing of tokenised documents into sequences of at most `CAPACITY` tokens.

With N(g) open sequences that have g tokens left, a piece goes where the sum of N(g)^2 becomes smallest:
an open sequence that fits or a new one. The rule keeps the numbers of open sequences per gap even, so
that a partner for every length stays at hand.

The pieces (24 bytes each, no text) are packed in groups of about `GROUP`, by hash, each group by one
task in order of falling length. What a group could not fill - sequences with more than `SLACK` tokens
left - is opened again and meets the open pieces of other groups in the next of `ROUNDS` rounds, so the
rest that stays unfilled shrinks with every round. Groups, not the table, are what a task holds.

Tokenising is one pass over whole texts. The ids are those of the tokenizer file. Where the file is a
byte-level model whose merges stand in the order of their ids, its own vocabulary runs as ranks in
tiktoken, which gives the same ids (compared over the code points up to U+1FFFF, a part of the ideographs
and syllables left out) at several times the speed; a text with a special token, and a file of any other
shape, go to the tokenizer.

Edge cases: a null or empty text is one piece with the end token alone; repeated rows with one id and
text give equal rows of pieces, each with a place of its own; null ids are packed like others; an empty
table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonegauge.llm.common import kept_in_worker, small_batches
from tonegauge.session import materialise

CAPACITY, END = 2048, 0
GROUP, ROUNDS, SLACK = 4000, 3, 8
# Fixed value: how byte-level models of this kind cut a text before they merge.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_chars() -> dict[int, int]:
    """The byte-level alphabet, code point of each byte: printable bytes stand for themselves, the others for 256 and up in order."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in printable]
    return {b: b for b in printable} | {b: 256 + n for n, b in enumerate(rest)}


BYTE_CHARS = _byte_chars()
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, row long"


class Ids:
    """Text to its ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        self.tokenizer = load(path)
        with open(path, encoding="utf-8") as f:
            described = json.load(f)
        self.special = [t["content"] for t in described["added_tokens"]]
        self.ranks = ranked(described)

    def text(self, text: str) -> bytes:
        if self.ranks is None or any(s in text for s in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return np.array(self.ranks.encode_ordinary(text), "<u4").tobytes()


def ranked(described: dict):
    """The model of a tokenizer file as tiktoken ranks, None where these need not give the same ids."""
    import tiktoken

    model, cut = described["model"], described["pre_tokenizer"] or {}
    plain = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space")
    if not plain or model.get("type") != "BPE" or described["normalizer"] or described["truncation"]:
        return None
    vocab, chars = model["vocab"], {chr(c): b for b, c in BYTE_CHARS.items()}
    merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
    if [vocab.get(m) for m in merged] != list(range(256, len(vocab))) or any(c not in chars for token in vocab for c in token):
        return None
    ranks = {bytes(map(chars.__getitem__, token)): rank for token, rank in vocab.items()}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def load(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and a row mark; the first piece of a long document is the short one."""
    small_batches(docs.sparkSession, 200)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = kept_in_worker("ids", tokenizer, lambda: Ids(tokenizer))
        end = np.array([END], "<u4").tobytes()
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for doc, row, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "row", "text"))):
                got = ids.text(text or "") + end
                n = len(got) // 4
                at, length = 0, n % capacity or capacity
                for piece in range(-(-n // capacity)):
                    for column, value in zip(out, (doc, piece, at, length, zlib.crc32(got[4 * at : 4 * (at + length)]), row)):
                        column.append(value)
                    at, length = at + length, capacity
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32", "row"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.monotonically_increasing_id().alias("row"))
    return rows.mapInArrow(cut, PIECES)


def sum_of_squares(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Bin of each length, in the given order, and the tokens left in each bin."""
    count = np.zeros(capacity + 1, np.int64)  # open bins by the tokens left in them
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, left = np.zeros(len(lengths), np.int64), []
    for k, size in enumerate(lengths.tolist()):
        if size < capacity:
            # Change of the sum of squares for every gap that fits; leaving nothing open costs least.
            now, then = count[size:capacity], count[0 : capacity - size]
            cost = 2 * (then - now) + 2
            cost[0] = 1 - 2 * now[0]
            cost[now == 0] = np.iinfo(np.int64).max
            at = int(cost.argmin())
            if now[at] and cost[at] <= 2 * count[capacity - size] + 1:
                gap = size + at
                b = open_bins[gap].pop()
                count[gap] -= 1
                left[b] = at
            else:
                b, at = len(left), capacity - size
                left.append(at)
            if at:
                open_bins[at].append(b)
                count[at] += 1
        else:
            b = len(left)
            left.append(0)
        bins[k] = b
    return bins, np.array(left, np.int64)


def _packer(capacity: int, round_: int, last: bool):
    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "doc_id", "piece", "row"], ascending=[False, True, True, True], kind="stable", ignore_index=True)
        bins, left = sum_of_squares(group["length"].to_numpy(), capacity)
        group["sequence_id"] = (int(group["grp"].iloc[0]) * ROUNDS + round_) * (GROUP * 64) + bins
        group["offset"] = (group["length"].groupby(bins).cumsum() - group["length"]).astype("int64")
        group["open"] = (left[bins] > SLACK) & (not last)
        return group.drop(columns="grp")

    return pack


def packed(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """`rows` (pieces with `length`) with sequence_id and offset; written once per round."""
    open_rows, closed = rows, []
    columns = rows.columns
    for round_ in range(ROUNDS):
        n = open_rows.count()
        groups = max(1, -(-n // GROUP))
        # Rows of one round meet others in the next: the round is part of the hash.
        spread = F.pmod(F.xxhash64("doc_id", "piece", "row", F.lit(round_)), F.lit(groups))
        last = round_ == ROUNDS - 1
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*columns).schema)
        done = materialise(
            open_rows.withColumn("grp", spread).groupBy("grp").applyInPandas(_packer(capacity, round_, last), f"{schema}, sequence_id long, offset long, open boolean"),
            "packed",
        )
        closed.append(done.where("not open").drop("open"))
        open_rows = done.where("open").select(*columns)
    out = closed[0]
    for more in closed[1:]:
        out = out.unionByName(more)
    return out


def best_fit_packing(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    return packed(materialise(pieces(docs, tokenizer), "pieces")).drop("row")

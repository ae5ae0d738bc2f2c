"""Brown class-based bigrams: exchange clustering, class transitions, word emissions, smoothed scores.

    P(w | v) = P(class(w) | class(v)) * P(w | class(w))

Learning, over all training documents and the whole vocabulary:
1. Texts are encoded once, in blocks of `BLOCK_BYTES`: a block holds its distinct words and its tokens as
   numbers of them. All later passes read blocks, never texts, where they are: the table is bucketed by block.
2. Words are dealt over parts by hash. A part adds up the counts of its words over all blocks, and keeps for
   each block which of its words that block holds (`Vocabulary`). From here on words travel as places: a part
   sends a block one class for each of its words, a block sends a part the neighbours of its words by class.
3. The `ANCHORS` most frequent words are clustered by exchange: a word moves to the class where the
   likelihood of the anchors' bigrams rises most, word by word until no word moves. Their bigrams are summed
   over all blocks; the table has ANCHORS ** 2 numbers at most, so the exchange itself runs on the driver.
   Every other word makes the same move against these classes. This is where the exchange starts from.
4. The exchange goes on over the whole vocabulary. In a round every word, anchor or not, meets all its
   neighbours in all training text, whatever words they are, and moves to the class where the likelihood
   rises most at the round's class bigrams. Rounds follow until the likelihood of all training bigrams, counted
   anew after each, rises by less than `RISE` a token and all words have a class; a round that only lowers it is taken back.
5. Each block gets classes and counts of its own words and turns its documents into class sequences and sums
   of emissions (written once). Transitions are counted on the sequences of training documents.

Smoothing. Transitions: additive, `PRIOR` observations by the frequency of the class. Emissions: additive,
`UNSEEN` for each word of a class and once for all words never seen; an unknown word therefore has the
summed probability of that share over the classes, and behind it the class frequencies stand for the
transition. The end of a text is a token in a class of its own, which also precedes the first word, so
every text has a probability and the probabilities of what may follow sum to 1.

Edge cases: a null or empty text is the end token alone; a document without an id is not held out and is
learnt from; repeated rows count each time and score alike; without any training document every token
is unknown; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonegauge.llm.common import fold, small_batches
from tonegauge.session import materialise, run_dir

CLASSES = 16  # classes that words are clustered into
ANCHORS = 512  # most frequent words, clustered one by one; the rest follows them
BLOCK_BYTES = 4 << 20  # the JVM and a Python worker hold a few copies of a block for each task
ROUNDS = 30  # of an exchange, at most
RISE = 0.01  # log-likelihood a token that a round over the whole vocabulary must add for another one
PRIOR, UNSEEN, BASE = 5.0, 0.5, 0.1
PARTS, HELD_OUT = 10, 0
# No word holds a space, so the end of a text cannot be taken for one.
END = b" "
BLOCKS = "block long, doc_ids array<long>, held array<boolean>, lengths array<long>, tokens binary, words binary, marks binary, counts binary"
OPEN = 255  # a word without a class yet


def planes(numbers: np.ndarray, size: int = 4) -> bytes:
    """Numbers byte by byte: all low bytes first. Word numbers follow first use, so most are small and
    the higher bytes, mostly zeros, compress to little wherever a block is written or shuffled."""
    return numbers.astype(f"<u{size}", copy=False).view(np.uint8).reshape(-1, size).T.tobytes()


def numbers(data, size: int = 4) -> np.ndarray:
    """The numbers behind `planes`."""
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(f"<u{size}").ravel()


def bucketed(df: DataFrame, key: str, buckets: int, purpose: str) -> DataFrame:
    """Write once, laid out by the hash that Spark shuffles with: groups of `key` are read without a shuffle."""
    name = f"{purpose}_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, key).option("path", run_dir(df.sparkSession, purpose)).format("parquet").saveAsTable(name)
    return df.sparkSession.table(name)


def encoded(docs: DataFrame) -> DataFrame:
    """Blocks of documents: distinct words with their training counts, tokens as numbers of these words.

    Word 0 of a block is the end. `marks` are 16 bits of the words' hashes, which deal them over parts.
    """
    small_batches(docs.sparkSession)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        part, number = TaskContext.get().partitionId(), 0
        ids, held, lengths, tokens, size = [], [], [], [], 0
        words: defaultdict[bytes, int] = defaultdict()
        words.default_factory = words.__len__
        words[END]

        def closed() -> pa.RecordBatch:
            said = np.concatenate(tokens)
            learnt = np.repeat(~np.array(held), lengths)
            counts = np.bincount(said[learnt], minlength=len(words))
            marks = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)).astype("<u2")
            values = ((part << 32) + number, ids, held, lengths, planes(said), b"\n".join(words), marks.tobytes(), planes(counts))
            kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), *[pa.binary()] * 4)
            names = ["block", "doc_ids", "held", "lengths", "tokens", "words", "marks", "counts"]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names)

        for batch in batches:
            for doc_id, out, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "held", "text"))):
                said = (text or b"").lower().split()  # bytes: A-Z and the six kinds of white space only
                said.append(END)
                tokens.append(np.fromiter(map(words.__getitem__, said), np.uint32, len(said)))
                ids.append(doc_id)
                held.append(out)
                lengths.append(len(said))
                size += len(text or b"") + 64
                if size >= BLOCK_BYTES:
                    yield closed()
                    number += 1
                    ids, held, lengths, tokens, size = [], [], [], [], 0
                    words.clear()
                    words[END]
        if ids:
            yield closed()

    out = F.coalesce(fold(F.col("doc_id"), PARTS) == HELD_OUT, F.lit(False)).alias("held")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text")).select("doc_id", out, "text")
    total = rows.agg(F.sum(F.octet_length("text") + 64).alias("n")).first()["n"] or 0
    return bucketed(rows.mapInArrow(blocks, BLOCKS), "block", buckets_of(total / BLOCK_BYTES), "encoded")


def buckets_of(groups: float) -> int:
    """Buckets for so many groups: a few groups each, and no fewer than a small cluster has cores."""
    return min(max(int(groups / 2), 16), 50_000)


def lean() -> None:
    """Let a worker give the memory of its large Arrow buffers back once they are freed, not keep it for later."""
    pa.set_memory_pool(pa.system_memory_pool())


def dealt(marks, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of a block's words in the order of their parts, the end left out, and where each part starts."""
    part = np.frombuffer(marks, "<u2")[1:] % parts
    return np.argsort(part, kind="stable") + 1, np.concatenate([[0], np.cumsum(np.bincount(part, minlength=parts))])


@dataclass(frozen=True)
class Vocabulary:
    """All words of all blocks, dealt over parts.

    `rows` has part and block. The row of block -1 has the part's words and their training counts `n`; that
    of a block has `places`, those of the block's words of this part among the part's words, in the order of `dealt`.
    """

    rows: DataFrame
    parts: int
    ends: int  # training documents: how often the end occurs

    def words(self) -> DataFrame:
        return self.rows.where("block = -1").select("part", "words", "n")


def vocabulary(blocks: DataFrame, classes: int = CLASSES) -> Vocabulary:
    total, ends = blocks.select(F.count(F.lit(1)), F.sum(F.size(F.filter("held", lambda h: ~h)))).first()
    parts = min(max(total * classes // 96, 1), 1 << 16)  # a part holds a vector of neighbours for each of its words

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for batch in batches:
            for block, words, marks, counts in zip(*(batch.column(c) for c in ("block", "words", "marks", "counts"))):
                order, starts = dealt(marks.as_buffer(), parts)
                every, n = words.as_py().split(b"\n"), numbers(counts.as_buffer())
                used = np.flatnonzero(np.diff(starts))
                each = [order[starts[p] : starts[p + 1]] for p in used]
                columns = [used.astype(np.int32), np.full(len(used), block.as_py()), [b"\n".join([every[i] for i in ids]) for ids in each], [planes(n[ids]) for ids in each]]
                kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["part", "block", "words", "counts"])

    def gathered(rows: pa.Table) -> pa.Table:
        lean()
        known: defaultdict[bytes, int] = defaultdict()
        known.default_factory = known.__len__
        places, counts = [], []
        for words, n in zip(rows.column("words"), rows.column("counts")):
            said = words.as_py().split(b"\n")
            places.append(np.fromiter(map(known.__getitem__, said), np.uint32, len(said)))
            counts.append(numbers(n.as_buffer()))
        n = np.bincount(np.concatenate(places), weights=np.concatenate(counts), minlength=len(known))  # exact below 2 ** 53
        part = rows.column("part")[0].as_py()
        columns = [[part] * (len(places) + 1), [-1, *rows.column("block").to_pylist()], [b"\n".join(known)], [planes(n, 8)], [None, *map(planes, places)]]
        columns[2] += [None] * len(places)
        columns[3] += [None] * len(places)
        kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], ["part", "block", "words", "n", "places"])

    small_batches(blocks.sparkSession)
    each = blocks.select("block", "words", "marks", "counts").mapInArrow(slices, "part int, block long, words binary, counts binary")
    rows = each.groupBy("part").applyInArrow(gathered, "part int, block long, words binary, n binary, places binary")
    return Vocabulary(bucketed(rows, "part", buckets_of(parts), "vocabulary"), parts, ends or 0)


def most_frequent(known: Vocabulary, size: int) -> list[bytes]:
    """The `size` most frequent training words, the end left out; each part names its own at first."""

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words, n in zip(batch.column("words"), batch.column("n")):
                every, n = np.array(words.as_py().split(b"\n"), object), numbers(n.as_buffer(), 8).astype(np.int64)
                # All words as frequent as the last one: equal counts are told apart by the words.
                least = max(int(np.partition(n, -size)[-size]) if len(n) > size > 0 else 1, 1)
                found = np.flatnonzero(n >= least)
                if least == 1 and len(found) > size:
                    found = np.array(sorted(found, key=lambda i: (-n[i], every[i]))[:size])
                yield pa.RecordBatch.from_arrays([pa.array(every[found].tolist(), pa.binary()), pa.array(n[found])], ["word", "n"])

    each = known.words().select("words", "n").mapInArrow(named, "word binary, n long")
    return [bytes(r["word"]) for r in each.orderBy(F.desc("n"), "word").limit(size).collect()]


def before(tokens: np.ndarray, classes: np.ndarray, end: int) -> np.ndarray:
    """Class in front of each token; the end's in front of the first one, as behind every text."""
    out = np.empty(len(tokens), classes.dtype)
    out[:1], out[1:] = end, classes[tokens[:-1]]
    return out


def unpacked(batch: pa.RecordBatch | pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Tokens and training mark per token of each block."""
    for tokens, held, lengths in zip(*(batch.column(c) for c in ("tokens", "held", "lengths"))):
        yield numbers(tokens.as_buffer()), np.repeat(~np.array(held.as_py(), bool), lengths.as_py())


def anchor_bigrams(blocks: DataFrame, anchors: list[bytes]) -> np.ndarray:
    """Counts of anchors beside anchors, and beside the end (the last row and column), in training text."""
    known, size = {w: i for i, w in enumerate([*anchors, END])}, len(anchors) + 1

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        total = np.zeros((size, size), np.int64)
        for batch in batches:
            for words, (tokens, learnt) in zip(batch.column("words"), unpacked(batch)):
                at = np.array([known.get(w, size) for w in words.as_py().split(b"\n")], np.int32)
                left, right = before(tokens, at, size - 1), at[tokens]
                used = learnt & (left < size) & (right < size)
                total += np.bincount(left[used] * size + right[used], minlength=size * size).reshape(size, size)
        a, b = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(total[a, b])], ["a", "b", "n"])

    small = blocks.select("words", "tokens", "held", "lengths").mapInArrow(counted, "a long, b long, n long")
    total = np.zeros((size, size))
    for r in small.groupBy("a", "b").agg(F.sum("n").alias("n")).toLocalIterator():  # (ANCHORS + 1) ** 2 rows at most
        total[r["a"], r["b"]] = r["n"]
    return total


def xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def likelihood(n: np.ndarray) -> float:
    """Log-likelihood of class bigrams `n`, without what no exchange changes."""
    return float(xlogx(n).sum() - xlogx(n.sum(0)).sum() - xlogx(n.sum(1)).sum())


def gains(n: np.ndarray, right: np.ndarray, left: np.ndarray, own: float, classes: int) -> np.ndarray:
    """Change of the likelihood of class bigrams `n` if a word joins class k, for every k.

    `right` and `left` are its bigrams with the words of each class behind and in front of it, `own`
    those with itself.
    """
    k = np.arange(classes)
    row, column = n[:classes], n[:, :classes].T
    by_row, by_column = xlogx(row + right) - xlogx(row), xlogx(column + left) - xlogx(column)
    crossing = xlogx(n[k, k] + right[k] + left[k] + own) - xlogx(n[k, k])
    cells = by_row.sum(1) - by_row[k, k] + by_column.sum(1) - by_column[k, k] + crossing
    # Sums of rows and columns: what the neighbours add to their own classes is the same for every k.
    rows, columns = (n.sum(1) + left)[:classes], (n.sum(0) + right)[:classes]
    sums = xlogx(rows + right.sum() + own) - xlogx(rows) + xlogx(columns + left.sum() + own) - xlogx(columns)
    return cells - sums


def exchange(bigrams: np.ndarray, classes: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Class of each word of a table of bigrams, and the bigrams of the classes.

    The last word is the end, which stays in a class of its own. Words come by falling frequency; each leaves
    its class and joins the one where the likelihood is largest, staying where nothing is gained.
    The classes start from the frequencies, dealt out in turn.
    """
    words = len(bigrams) - 1
    of = np.concatenate([np.arange(words) % classes, [classes]])
    n = np.zeros((classes + 1, classes + 1))
    np.add.at(n, (of[:, None], of[None, :]), bigrams)
    order = np.argsort(-(bigrams.sum(0) + bigrams.sum(1))[:words], kind="stable")
    for _ in range(rounds):
        moved = 0
        for w in order:
            own, old = bigrams[w, w], int(of[w])
            right = np.bincount(of, weights=bigrams[w], minlength=classes + 1)
            left = np.bincount(of, weights=bigrams[:, w], minlength=classes + 1)
            right[old] -= own
            left[old] -= own
            for new, sign in ((old, -1), (None, 1)):
                if new is None:
                    gain = gains(n, right, left, own, classes)
                    new = int(gain.argmax())
                    if gain[new] <= gain[old] + 1e-9:
                        new = old
                    of[w] = new
                    moved += new != old
                n[new] += sign * right
                n[:, new] += sign * left
                n[new, new] += sign * own
        if not moved:
            break
    return of, n


def anchored(known: Vocabulary, of: dict[bytes, int]) -> DataFrame:
    """part, classes (a byte a word, in the order of the part): those of `of`, `OPEN` for all other words."""

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            classes = [bytes([of.get(w, OPEN) for w in words.as_py().split(b"\n")]) for words in batch.column("words")]
            yield pa.RecordBatch.from_arrays([batch.column("part"), pa.array(classes, pa.binary())], ["part", "classes"])

    return materialise(known.words().select("part", "words").mapInArrow(named, "part int, classes binary"), "classed")


def answers(known: Vocabulary, state: DataFrame, counts: bool = False) -> DataFrame:
    """block, part and the classes (on demand also the training counts) of the block's words of this part."""

    def looked_up(rows: pa.Table, own: pa.Table) -> pa.Table:
        lean()
        of = np.frombuffer(own.column("classes")[0].as_py(), np.uint8)
        blocks, parts, found, said = [], [], [], []
        n = None
        if counts:
            (n,) = (numbers(x.as_buffer(), 8) for x, b in zip(rows.column("n"), rows.column("block")) if b.as_py() == -1)
        for block, part, places in zip(*(rows.column(c) for c in ("block", "part", "places"))):
            if block.as_py() >= 0:
                at = numbers(places.as_buffer())
                blocks.append(block.as_py())
                parts.append(part.as_py())
                found.append(of[at].tobytes())
                said.append(planes(n[at], 8) if counts else None)
        kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary())
        return pa.table([pa.array(c, k) for c, k in zip((blocks, parts, found, said), kinds)], ["block", "part", "classes", "n"])

    rows = known.rows.select("part", "block", "places", "n" if counts else F.lit(None).cast("binary").alias("n"))
    return rows.groupBy("part").cogroup(state.groupBy("part")).applyInArrow(looked_up, "block long, part int, classes binary, n binary")


def in_order(own: pa.Table, column: str) -> bytes:
    """One column of a block's answers, part after part."""
    return b"".join(own.column(column)[int(i)].as_py() for i in np.argsort(own.column("part").to_numpy()))


def contexts(blocks: DataFrame, known: Vocabulary, state: DataFrame, classes: int) -> tuple[DataFrame, np.ndarray]:
    """Neighbours by class of all words in training text, for the parts; and the bigrams of the classes.

    For part and block: `sizes`, how many of its `width` cells a word fills (in the order of `dealt`), `cells`
    and `counts`. Cells are the classes in front (`classes` is that of words without evidence, the next one the
    end's), those behind, and the word itself behind it. Neighbours without a class yet are not counted.
    """
    parts, end = known.parts, classes + 1
    side = end + 1
    width = 2 * side + 1
    names = ["part", "block", "sizes", "cells", "counts", "steps"]

    def counted(block: pa.Table, own: pa.Table) -> pa.Table:
        lean()
        columns = [[], [], [], [], [], []]
        for number, marks, (said, learnt) in zip(block.column("block"), block.column("marks"), unpacked(block)):
            order, starts = dealt(marks.as_buffer(), parts)
            at = np.full(len(order) + 1, end, np.uint8)
            at[order] = np.frombuffer(in_order(own, "classes"), np.uint8) if own.num_rows else OPEN
            place = np.zeros(len(at), np.int32 if len(at) * width < 1 << 31 else np.int64)
            place[order] = np.arange(len(order))
            left, here = before(said, at, end), at[said]
            used = learnt & (left < side) & (here < side)
            steps = np.bincount(left[used].astype(np.int64) * side + here[used], minlength=side * side)
            right = np.append(here[1:], np.uint8(end))
            word = place[said] * width
            open_ = learnt & (said > 0)
            again = np.zeros(len(said), bool)
            again[1:] = (said[1:] == said[:-1]) & open_[1:]
            followed = np.append(again[1:], False)
            l, r = open_ & (left < side) & ~again, open_ & (right < side) & ~followed
            keys = np.concatenate([word[l] + left[l], word[r] + side + right[r], word[again] + 2 * side])
            cells, n = tallied(keys, len(order) * width)
            sizes = np.bincount(cells // width, minlength=len(order))
            bounds = np.searchsorted(cells, starts * width)
            for p in np.flatnonzero(np.diff(bounds)):
                a, b = bounds[p], bounds[p + 1]
                for c, v in zip(columns, (p, number.as_py(), planes(sizes[starts[p] : starts[p + 1]]), planes(cells[a:b] % width), planes(n[a:b]), None)):
                    c.append(v)
            for c, v in zip(columns, (-1, number.as_py(), None, None, None, steps.astype("<i8").tobytes())):
                c.append(v)
        kinds = (pa.int32(), pa.int64(), *[pa.binary()] * 4)
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    texts = blocks.select("block", "held", "lengths", "tokens", "marks")
    spec = "part int, block long, sizes binary, cells binary, counts binary, steps binary"
    each = texts.groupBy("block").cogroup(answers(known, state).groupBy("block")).applyInArrow(counted, spec)
    found = materialise(each, "contexts")

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(side * side, np.int64)
        for batch in batches:
            for steps in batch.column("steps"):
                total += np.frombuffer(steps.as_buffer(), "<i8")
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["cell", "n"])

    n = np.zeros(side * side)
    small = found.where("steps is not null").select("steps").mapInArrow(summed, "cell long, n long")
    for row in small.groupBy("cell").agg(F.sum("n").alias("n")).collect():  # (K + 2) ** 2 rows
        n[row["cell"]] = row["n"]
    return found.where("part >= 0").drop("steps"), n.reshape(side, side)


def tallied(keys: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys below `size`, sorted, and their counts."""
    if size > 1 << 24:
        return np.unique(keys, return_counts=True)
    n = np.bincount(keys, minlength=size)
    found = np.flatnonzero(n)
    return found, n[found]


def moved(known: Vocabulary, state: DataFrame, beside: DataFrame, n: np.ndarray, classes: int, all_words: bool) -> DataFrame:
    """part, classes after each word (or each without a class yet) moved to its likeliest class.

    An occurrence in class k behind class a has P(k | a) / tokens(k), in front of class b P(b | k), beside
    itself both; they come from the class bigrams `n`. To first order this is how the likelihood rises. A word
    stays where it is if no class is better. One whose neighbours have no class either goes to the class
    `classes`, that of words without evidence; with `all_words` that class is a neighbour like any other, and is left.
    """
    smooth = n + 0.5
    behind = np.log(smooth / smooth.sum(1, keepdims=True))
    left = behind[:, :classes] - np.log(smooth.sum(0)[:classes])
    weights = np.vstack([left, behind[:classes].T, np.diag(left)])  # (K + 2 in front, K + 2 behind, itself) x K
    width = len(weights)
    apart = np.ones((width, 1))
    apart[[classes, len(n) + classes, width - 1]] = 0.0  # neighbours with a class come first for words without one

    def placed(rows: pa.Table, own: pa.Table) -> pa.Table:
        lean()
        place = {b.as_py(): p for b, p in zip(rows.column("block"), rows.column("places")) if b.as_py() >= 0}
        (old,) = (np.frombuffer(of.as_py(), np.uint8) for block, of in zip(own.column("block"), own.column("classes")) if block.as_py() == -1)
        beside = np.zeros(len(old) * width)
        for block, sizes, cells, said in zip(*(own.column(c) for c in ("block", "sizes", "cells", "counts"))):
            if block.as_py() >= 0:
                at = numbers(place[block.as_py()].as_buffer()).astype(np.int64) * width
                # A block names each cell of a word once.
                beside[np.repeat(at, numbers(sizes.as_buffer())) + numbers(cells.as_buffer())] += numbers(said.as_buffer())
        beside = beside.reshape(-1, width)
        score, evident = beside @ weights, beside.any(1)
        every, settled = np.arange(len(old)), old < classes
        near = ~settled & (beside * apart.T).any(1)
        score[near] = beside[near] @ (weights * apart)
        if not all_words:
            evident &= near
        best = score.argmax(1)
        stays = np.full(len(old), -np.inf)
        stays[settled] = score[every[settled], old[settled]] + 1e-9
        new = np.where(evident & (score[every, best] > stays), best, old)
        new[new == OPEN] = classes
        if not all_words:
            new = np.where(old == OPEN, new, old)
        return pa.table([pa.array([rows.column("part")[0].as_py()], pa.int32()), pa.array([new.astype(np.uint8).tobytes()], pa.binary())], ["part", "classes"])

    none = F.lit(None).cast("binary")
    data = beside.withColumn("classes", none).unionByName(
        state.select("part", F.lit(-1).cast("long").alias("block"), none.alias("sizes"), none.alias("cells"), none.alias("counts"), "classes")
    )
    rows = known.rows.select("part", "block", "places")
    return materialise(rows.groupBy("part").cogroup(data.groupBy("part")).applyInArrow(placed, "part int, classes binary"), "classed")


def exchanged(blocks: DataFrame, known: Vocabulary, state: DataFrame, classes: int, rounds: int = ROUNDS) -> DataFrame:
    """The state after rounds of exchange over the whole vocabulary, from that of the anchors."""
    beside, n = contexts(blocks, known, state, classes)
    state = moved(known, state, beside, n, classes, all_words=False)
    beside, n = contexts(blocks, known, state, classes)
    for _ in range(rounds):
        new = moved(known, state, beside, n, classes, all_words=True)
        found, then = contexts(blocks, known, new, classes)
        gain, settled = likelihood(then) - likelihood(n), n[classes].sum() - then[classes].sum()
        total = n.sum()
        # Whoever leaves the class of words without evidence must join one of the others.
        if gain > 0 or settled > 0:
            state, n, beside = new, then, found
        if gain <= RISE * total and not (settled > 0 and n[classes].sum() > 0):
            break
    return state


@dataclass(frozen=True)
class Model:
    """`words` (word, n, class) is distributed; all else is bounded by the number of classes.

    Classes 0 to K-1 are those of the exchange, `rest` that of words without evidence (no training text
    leaves one there that has a neighbour with a class), `end` that of the end;
    `none` stands for unknown words.
    """

    words: DataFrame
    classes: int
    tokens: np.ndarray  # training tokens by class
    distinct: np.ndarray  # distinct training words by class
    known: Vocabulary
    state: DataFrame  # part, classes

    @property
    def rest(self) -> int:
        return self.classes

    @property
    def end(self) -> int:
        return self.classes + 1

    @property
    def none(self) -> int:
        return self.classes + 2

    @property
    def train_tokens(self) -> int:
        return int(self.tokens.sum())

    def emissions(self) -> np.ndarray:
        """By class: the number under the additive share of a word, and so of the unknown ones."""
        return self.tokens + UNSEEN * (self.distinct + 1)

    def transitions(self, n: np.ndarray) -> np.ndarray:
        """P(class | class before) from counted class bigrams; the row of `none` holds the frequencies."""
        known = self.none
        share = (self.tokens + 1.0) / (self.tokens.sum() + known)
        return (n[: known + 1, :known] + PRIOR * share) / (n[: known + 1, :known].sum(1, keepdims=True) + PRIOR)


def learn(blocks: DataFrame, classes: int = CLASSES, anchors: int = ANCHORS) -> Model:
    """Cluster the vocabulary of the blocks' training documents."""
    if not 1 <= classes <= 250:
        raise ValueError("a class is kept in one byte: 1 to 250 classes")
    known = vocabulary(blocks, classes)
    top = most_frequent(known, anchors)
    of, _ = exchange(anchor_bigrams(blocks, top), classes)
    state = exchanged(blocks, known, anchored(known, {w: int(c) for w, c in zip(top, of)}), classes)
    return described(known, state, classes)


def described(known: Vocabulary, state: DataFrame, classes: int) -> Model:
    """The model of the words' classes."""
    every = known.words().join(state, "part")
    end = classes + 1

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words, n, of in zip(*(batch.column(c) for c in ("words", "n", "classes"))):
                n, of = numbers(n.as_buffer(), 8).astype(np.int64), np.frombuffer(of.as_buffer(), np.uint8).astype(np.int32)
                said, found = words.as_py().split(b"\n"), np.flatnonzero(n)
                for start in range(0, len(found), 20_000):
                    rows = found[start : start + 20_000]
                    yield pa.RecordBatch.from_arrays([pa.array([said[i] for i in rows], pa.binary()), pa.array(n[rows]), pa.array(of[rows])], ["word", "n", "class"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, end + 1), np.int64)
        for batch in batches:
            for n, of in zip(batch.column("n"), batch.column("classes")):
                n, of = numbers(n.as_buffer(), 8), np.frombuffer(of.as_buffer(), np.uint8)
                found = n > 0
                total += np.stack([np.bincount(of[found], weights=w, minlength=end + 1) for w in (n[found], None)]).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(end + 1, dtype=np.int32)), *map(pa.array, total)], ["class", "n", "w"])

    tokens, distinct = np.zeros(end + 1), np.zeros(end + 1)
    small = every.select("n", "classes").mapInArrow(summed, "class int, n long, w long")
    for r in small.groupBy("class").agg(F.sum("n").alias("n"), F.sum("w").alias("w")).collect():
        tokens[r["class"]], distinct[r["class"]] = r["n"], r["w"]
    tokens[end], distinct[end] = known.ends, known.ends > 0
    words = every.select("words", "n", "classes").mapInArrow(listed, "word binary, n long, class int")
    if known.ends:
        words = words.unionByName(state.sparkSession.createDataFrame([(bytearray(END), known.ends, end)], "word binary, n long, class int"))
    return Model(words, classes, tokens, distinct, known, state)


SEQUENCES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, emission double, classes binary"


def sequences(blocks: DataFrame, model: Model) -> DataFrame:
    """Each document's class sequence, sum of emissions (log10) and base score; written once."""
    under, end, none, ends, parts = model.emissions(), model.end, model.none, model.known.ends, model.known.parts
    base_under = model.train_tokens + BASE * (model.distinct.sum() + 1)

    def met(block: pa.Table, own: pa.Table) -> pa.Table:
        lean()
        rows = []
        for doc_ids, held, lengths, tokens, marks in zip(*(block.column(c) for c in ("doc_ids", "held", "lengths", "tokens", "marks"))):
            order, _ = dealt(marks.as_buffer(), parts)
            of, n = np.full(len(order) + 1, end, np.uint8), np.full(len(order) + 1, float(ends))
            if own.num_rows:
                of[order] = np.frombuffer(in_order(own, "classes"), np.uint8)
                n[order] = np.concatenate([numbers(own.column("n")[int(i)].as_buffer(), 8) for i in np.argsort(own.column("part").to_numpy())])
            seen = n > 0
            of[~seen] = none
            emission = np.zeros(len(of))
            emission[seen] = np.log10((n[seen] + UNSEEN) / under[of[seen]])
            base = np.log10((n + BASE) / base_under)
            said, at = numbers(tokens.as_buffer()), 0
            for doc_id, out, length in zip(doc_ids.as_py(), held.as_py(), lengths.as_py()):
                t = said[at : at + length]
                at += length
                rows.append((doc_id, out, length, int(seen[t].sum()), float(base[t].sum()), float(emission[t].sum()), of[t].tobytes()))
        kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary())
        names = ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "emission", "classes"]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 7, kinds)], names)

    texts = blocks.select("block", "doc_ids", "held", "lengths", "tokens", "marks")
    own = answers(model.known, model.state, counts=True)
    return materialise(texts.groupBy("block").cogroup(own.groupBy("block")).applyInArrow(met, SEQUENCES), "class-sequences")


def class_bigrams(said: DataFrame, end: int, none: int) -> np.ndarray:
    """Counts of neighbouring classes in training documents."""
    size = none + 1

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size * size, np.int64)
        for batch in batches:
            # Documents end with the end's class, which precedes the next one's first word: they may be read as one.
            c = np.frombuffer(b"".join(batch.column("classes").to_pylist()), np.uint8).astype(np.int64)
            if len(c):
                total += np.bincount(np.concatenate([[end], c[:-1]]) * size + c, minlength=size * size)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["cell", "n"])

    total = np.zeros(size * size)
    counts = said.where(~F.col("held_out")).select("classes").mapInArrow(counted, "cell long, n long")
    for r in counts.groupBy("cell").agg(F.sum("n").alias("n")).collect():  # (K + 3) ** 2 rows at most
        total[r["cell"]] = r["n"]
    return total.reshape(size, size)


def log_steps(model: Model, n: np.ndarray) -> np.ndarray:
    """log10 of the step from class to class; into `none`, of the step to any class and an unknown word of it."""
    steps = model.transitions(n)
    unknown = steps @ (UNSEEN / model.emissions())
    return np.log10(np.column_stack([steps, unknown]))


def class_bigram_scores(docs: DataFrame, classes: int = CLASSES, anchors: int = ANCHORS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10), perplexity of every document."""
    blocks = encoded(docs)
    model = learn(blocks, classes, anchors)
    said = sequences(blocks, model)
    steps, end = log_steps(model, class_bigrams(said, model.end, model.none)), model.end

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = []
            for c, emission in zip(batch.column("classes").to_pylist(), batch.column("emission").to_pylist()):
                of = np.frombuffer(c, np.uint8)
                score.append(emission + float(steps[np.concatenate([[end], of[:-1]]), of].sum()))
            kept = [batch.column(c) for c in ("doc_id", "held_out", "n_tokens", "n_known", "base_score")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(score, pa.float64())], ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    small_batches(docs.sparkSession)
    out = said.mapInArrow(scored, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(model.train_tokens).cast("long").alias("train_tokens"),
        "base_score",
        "score",
        F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"),
    )

"""Compression-distance toxicity: zstandard dictionaries, window lengths, calibrated thresholds.

Training (on a bounded sample of labelled rows, `ROWS_PER_CLASS` of either class):
1. One half of the rows gives the dictionary texts: windows of ordinary documents, and the windows of
   toxic documents whose words occur in toxic documents far above their rate in ordinary ones. One
   dictionary is trained on each; the strongest of the toxic words also stand verbatim at the end of theirs,
   all others that chance does not explain in further toxic dictionaries, each of a size that zstandard
   can reach.
2. The other half calibrates. A window (a word, lower-cased, in UTF-16, behind a frame that all
   dictionaries hold, so that the fixed cost of a block cancels) is compressed with every dictionary;
   its toxic length is the least over the toxic ones.
   The pair of lengths has a log-likelihood ratio, toxic against ordinary, counted over that half.
   A logistic curve over the document's strongest and summed ratios turns them into a probability.

UTF-16 doubles what a matched word saves against the constant cost of a match: with one byte a letter a
five-letter word saves too little to be told from chance.

Edge cases: a null or empty text has no windows and gets the score of zero ratios; a label that is null
or not 0/1 and a null id are left out of training; repeated ids in `labels` count once; without rows of
both classes every score is 0.5 below the threshold (0.0). Extra columns of `docs` are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tonegauge.llm.common import fold, kept_in_worker, small_batches, training_rows

ROWS_PER_CLASS = 6000  # bound of the labelled rows that are looked at
TRAINED_WORDS = 400  # strongest words that the first toxic dictionary is trained on
FALSE_SHARE = 0.05  # of the words in further dictionaries, by the false-discovery rule
# Dictionary sizes: above about 8 KB zstandard no longer finds what these short windows share with them.
ORDINARY_BYTES, TOXIC_BYTES, VERBATIM_BYTES = 4096, 4096, 2048
MIN_DOCS, MIN_LOG_ODDS = 4, 2.5
LEVEL, FRAME, CELLS = 9, 32, 64
ENCODING = "utf-16-le"
CACHED = 200_000  # words whose lengths a worker remembers
TOKENS = re.compile(r"[^ \t-\r]+")
LETTERS = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class Model:
    ordinary: bytes
    toxic: tuple[bytes, ...]
    ratios: np.ndarray  # by the pair of lengths
    weights: np.ndarray | None  # logistic, the constant last


class Lengths(dict):
    """Word to pair of window lengths, as one cell number; computed once per word and worker."""

    def __init__(self, model: Model):
        super().__init__()
        self.frame = model.ordinary[-FRAME:]
        self.by = [self._compressor(model.ordinary), *(self._compressor(t + self.frame) for t in model.toxic)]
        self.base = [len(c.compress(self.frame + " ".encode(ENCODING))) for c in self.by]

    @staticmethod
    def _compressor(content: bytes) -> zstandard.ZstdCompressor:
        words = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        words.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(
            level=LEVEL, dict_data=words, write_content_size=False, write_checksum=False, write_dict_id=False
        )

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHED:
            self.clear()
        cell = 0
        # A long token is measured in pieces; the piece with the largest saving stands for it.
        best = None
        for start in range(0, len(word), 24):
            window = self.frame + f" {word[start : start + 24]} ".encode(ENCODING, "surrogatepass")
            plain, *shards = (
                min(max(len(c.compress(window)) - base, 0), CELLS - 1) for c, base in zip(self.by, self.base)
            )
            toxic = min(shards)
            if best is None or plain - toxic > best:
                best, cell = plain - toxic, plain * CELLS + toxic
        self[word] = cell
        return cell


def kept_lengths(model: Model) -> Lengths:
    return kept_in_worker("lengths", (model.ordinary, model.toxic), lambda: Lengths(model))


def cells(lengths: Lengths, text: str) -> np.ndarray:
    return np.fromiter(map(lengths.__getitem__, TOKENS.findall(text.lower())), np.int64)


def features(ratios: np.ndarray) -> list[float]:
    """Strongest windows and their share of the text; zeros for a text without windows."""
    n = len(ratios)
    if not n:
        return [0.0, 0.0, 0.0, 0.0]
    top = np.sort(ratios)[::-1][:8]
    strong = ratios[ratios >= 2.0]
    return [float(top[0]), float(top[:3].sum() / 3), float(np.log1p(len(strong))), float(strong.sum() / (n + 20.0) * 10.0)]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the constant last, not penalised."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, keep = np.zeros(x.shape[1]), np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    for _ in range(50):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + keep, x.T @ (y - p) - keep @ w)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", parts: int = 5, held_out: int = 0) -> Model | None:
    """Fit on at most `ROWS_PER_CLASS` rows a class outside the held-out fold; None without both classes."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = training_rows(docs, labels, label, parts, held_out, ROWS_PER_CLASS, "toxicity")
    counts = {(r["half"], r["y"]): r["n"] for r in rows.groupBy("half", "y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if any(counts.get((half, y), 0) == 0 for half in (0, 1) for y in (0, 1)):
        return None

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Words of a document, each once, and some runs of eight words for the ordinary dictionary."""
        for batch in batches:
            word, y, run, source = [], [], [], []
            for text, label_ in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist()):
                text = text.lower()
                said = TOKENS.findall(text)
                # Near copies mostly share their least hash of three words; they speak once for a word.
                least = min((zlib.crc32(" ".join(said[at : at + 3]).encode("utf-8", "surrogatepass")) for at in range(max(1, len(said) - 2))))
                for w in sorted(set(LETTERS.findall(text))):
                    word.append(w[:64])
                    y.append(label_)
                    run.append(False)
                source += [least] * (len(word) - len(source))
                tokens = said if not label_ else []
                for at in range(0, len(tokens), max(8, len(tokens) // 10)):
                    word.append(" ".join(tokens[at : at + 8])[:256])
                    y.append(0)
                    run.append(True)
                source += [0] * (len(word) - len(source))
            columns = [pa.array(word, pa.string()), pa.array(y, pa.int32()), pa.array(run, pa.bool_()), pa.array(source, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["word", "y", "run", "source"])

    seen = (
        rows.where("half = 0")
        .mapInArrow(windows, "word string, y int, run boolean, source long")
        .groupBy("word", "run", "y", "source")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("word", "run")
        .agg(
            F.sum(F.col("y") * F.col("n")).alias("toxic"),
            F.sum((1 - F.col("y")) * F.col("n")).alias("ordinary"),
            F.count_if(F.col("y") == 1).alias("toxic_sources"),
            F.count_if(F.col("y") == 0).alias("ordinary_sources"),
        )
    )
    n0, n1 = counts[0, 0], counts[0, 1]
    odds = F.log((F.col("toxic") + 0.5) / (n1 + 1.0)) - F.log((F.col("ordinary") + 0.5) / (n0 + 1.0))
    tested = Observation()
    often = ~F.col("run") & (F.col("toxic_sources") + F.col("ordinary_sources") >= MIN_DOCS)
    marked = (
        seen.observe(tested, F.count_if(often).alias("n"))
        .where(~F.col("run") & (F.col("toxic") >= MIN_DOCS) & (odds >= MIN_LOG_ODDS))
        .orderBy(odds.desc(), "word")
        .select("word", "toxic", "toxic_sources", "ordinary_sources")
        .collect()  # at least MIN_DOCS of the drawn documents hold each
    )
    runs = [r["word"] for r in seen.where("run").select("word").orderBy(F.xxhash64("word"), "word").limit(20_000).collect()]
    ordinary = _dictionary([f" {x} ".encode(ENCODING, "surrogatepass") for x in runs], ORDINARY_BYTES, 64)
    # zstandard's trainer weighs by frequency and leaves marked words out at random once there are many of
    # them (held-out recall 0.11 to 0.81 with its dictionary alone, 0.98 with the words behind it), so words
    # follow verbatim, in as many dictionaries as they need, the strongest of each last, where a match costs
    # least. Words that copies of few documents bring by chance would fill most of the further dictionaries.
    words = [f" {r['word']} ".encode(ENCODING, "surrogatepass") for r in marked]
    trained = _dictionary(
        [w for w, r in reversed([*zip(words, marked)][:TRAINED_WORDS]) for _ in range(min(r["toxic"], 500))], TOXIC_BYTES - VERBATIM_BYTES, 16
    )
    # Without a marked word the observed plan may be cut away whole, and there is nothing to test.
    n_tested = tested.get["n"] if marked else 0
    toxic = shards(trained, words, beyond_chance([(r["toxic_sources"], r["ordinary_sources"]) for r in marked], n1 / (n0 + n1), n_tested))
    model = Model(ordinary, toxic, np.zeros(CELLS * CELLS), None)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, total = kept_lengths(model), np.zeros((2, CELLS * CELLS), np.int64)
        for batch in batches:
            for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist()):
                total[y] += np.bincount(cells(lengths, text), minlength=CELLS * CELLS)
        used = np.flatnonzero(total.sum(0))
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[0][used]), pa.array(total[1][used])], ["cell", "n0", "n1"])

    second = rows.where("half = 1")
    total = np.zeros((2, CELLS * CELLS))
    got = second.mapInArrow(counted, "cell long, n0 long, n1 long").groupBy("cell").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    for r in got.collect():  # one row per cell, CELLS ** 2 at most
        total[:, r["cell"]] = r["n0"], r["n1"]
    share = (total.sum(1) / max(total.sum(), 1.0))[:, None]
    smooth = total + 5.0 * share
    ratios = np.log(smooth[1] / smooth[0]) - np.log(share[1, 0] / share[0, 0])
    model = Model(ordinary, toxic, np.where(total.sum(0) > 0, ratios, 0.0), None)
    spec = "doc_id long, y int, f array<double>"

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = kept_lengths(model)
        for batch in batches:
            f = [features(model.ratios[cells(lengths, text)]) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array(f, pa.list_(pa.float64()))], ["doc_id", "y", "f"])

    sample = second.mapInArrow(described, spec).orderBy("doc_id").collect()  # ROWS_PER_CLASS bounds it
    x, y = np.array([r["f"] for r in sample]), np.array([r["y"] for r in sample], float)
    # Classes were drawn at equal bounds; rows are weighed back to even odds by the constant.
    return Model(ordinary, toxic, model.ratios, logistic(x, y))


def beyond_chance(counts: list[tuple[int, int]], share: float, tested: int) -> np.ndarray:
    """Which (toxic, ordinary) counts a rate of `share` does not explain: Chernoff bounds, false-discovery rule."""
    toxic, ordinary = np.array(counts, float).reshape(-1, 2).T
    n = toxic + ordinary
    log_p = toxic * np.log(n * share / np.maximum(toxic, 1)) + ordinary * np.log(n * (1 - share) / np.maximum(ordinary, 1))
    order = np.argsort(log_p)
    passed = np.flatnonzero(log_p[order] <= np.log(FALSE_SHARE * np.arange(1, len(n) + 1) / max(tested, 1)))
    found = np.zeros(len(n), bool)
    found[order[: passed[-1] + 1 if len(passed) else 0]] = True
    return found


def shards(trained: bytes, words: list[bytes], found: np.ndarray) -> tuple[bytes, ...]:
    """Toxic dictionaries, every word whole, strongest first: one behind `trained`, then the `found` words left."""
    ends = np.cumsum([len(w) for w in words])
    first = int(np.searchsorted(ends, VERBATIM_BYTES, "right"))
    held, room = [words[:first]], 0
    for w, f in zip(words[first:], found[first:]):
        if f:
            if len(w) > room:
                held.append([])
                room = TOXIC_BYTES
            held[-1].append(w)
            room -= len(w)
    joined = [b"".join(reversed(h)) for h in held]
    return (trained + joined[0], *joined[1:])


def _dictionary(samples: list[bytes], size: int, segment: int) -> bytes:
    """A trained zstandard dictionary; where too little text is given to train one, the text itself."""
    if len(samples) >= 16:
        try:
            return zstandard.train_dictionary(size, samples, k=segment, d=8).as_bytes()
        except zstandard.ZstdError:
            pass
    return b"".join(dict.fromkeys(samples))[-size:] or " ".encode(ENCODING) * FRAME


def score(docs: DataFrame, model: Model | None, threshold: float = 0.5) -> DataFrame:
    """doc_id, score, predicted for every row; one pass over the whole texts, no shuffle."""
    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    if model is None or model.weights is None:
        return rows.select("doc_id", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = kept_lengths(model)
        for batch in batches:
            x = np.array([[*features(model.ratios[cells(lengths, t or "")]), 1.0] for t in batch.column("text").to_pylist()]).reshape(-1, len(model.weights))
            s = 1.0 / (1.0 + np.exp(-np.clip(x @ model.weights, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return rows.mapInArrow(scored, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    scored = score(docs, train(docs, labels))
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of `docs` that are not rejected, all columns kept; scored in place, so nothing is joined."""
    small_batches(docs.sparkSession)
    model = train(docs, labels)
    if model is None:
        return docs
    at = docs.columns.index("text")

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = kept_lengths(model)
        for batch in batches:
            x = np.array([[*features(model.ratios[cells(lengths, t or "")]), 1.0] for t in batch.column(at).to_pylist()]).reshape(-1, len(model.weights))
            s = 1.0 / (1.0 + np.exp(-np.clip(x @ model.weights, -30, 30)))
            yield batch.filter(pa.array(s < threshold))

    return docs.mapInArrow(kept, docs.schema)

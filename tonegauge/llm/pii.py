"""Personal data by a semi-Markov conditional random field over candidate segments.

The four base kinds are matched first and always stay. The field adds what it finds beside them:

* A region is a stretch of neighbouring white-space tokens that hold a digit or an at sign. It is cut
  into atoms: runs of digits, runs of letters, single other characters.
* A candidate is a segment of at most `MAX_ATOMS` atoms with a type (the entity length is bounded), that
  has what the type cannot do without. Features look at the whole span: how many digits, how they are
  grouped and separated, checksum, octet range, host parts, what stands before and behind.
* Weights are fitted by the gradient of the conditional likelihood (forward and backward sums over all
  segmentations of a region) on regions of at most `FIT_DOCS` documents, at most `FIT_REGIONS` of them,
  drawn by hash. The base matches are the labels; each phone or card also counts in a spelling that the
  base pattern does not know (no country code, other separators), so that the field generalises.
* Decoding is dynamic programming over positions: it chooses boundaries and types jointly. Found
  segments that touch no base span are added.

Edge cases: null and empty texts have no spans; offsets count code points; long runs of one character
class are linear in every matcher; a corpus without matches gives a field without weights, which adds
nothing; repeated rows are independent; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonegauge.llm.common import small_batches

KINDS = ("email", "ip", "card", "phone")
FIT_DOCS, FIT_REGIONS, EPOCHS, MAX_ATOMS = 4000, 3000, 6, 18

HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]+")
HOT = re.compile(r"[0-9@][^\x20\x09-\x0D]*")
ATOM = re.compile(r"[0-9]+|[^\W\d_]+|[\s\S]")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
SPACES = frozenset(" \t\n\x0b\x0c\r")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for at, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if at % 2:
            n = n * 2 - 9 if n > 4 else n * 2
        total += n
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind that pass its test, by kind, then start."""
    spans: list[Span] = []
    at, end = text.find("@"), 0
    while at >= 0:  # every match holds one at sign and starts as far left as the last match allows
        start = at
        while start > end and text[start - 1] in LOCAL_CHARS:
            start -= 1
        host = HOST.match(text, at + 1) if start < at else None
        if host:
            end = host.end()
            spans.append(("email", start, end))
        at = text.find("@", max(at + 1, end))
    if DIGIT.search(text):
        for m in DOTTED.finditer(text):  # a dotted run holds matches side by side, four numbers each
            if m.group().count(".") >= 3:
                parts, start = m.group().split("."), m.start()
                for i in range(0, len(parts) - 3, 4):
                    four = parts[i : i + 4]
                    stop = start + sum(map(len, four)) + 3
                    if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                        spans.append(("ip", start, stop))
                    start = stop + 1
        for m in CARD.finditer(text):
            if 13 <= m.end() - m.start() <= 37:  # 19 digits with a separator between any two
                digits = NOT_DIGIT.sub("", m.group())
                if 13 <= len(digits) <= 19 and luhn(digits):
                    spans.append(("card", m.start(), m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= len(NOT_DIGIT.sub("", m.group())) <= 15:
                    spans.append(("phone", m.start(), m.end()))
    return spans


def regions(text: str) -> Iterator[tuple[int, int]]:
    """Stretches of tokens with a digit or an at sign, with single spaces between them."""
    start = stop = -1
    for m in HOT.finditer(text):
        left = m.start()
        while left > max(stop, 0) and text[left - 1] not in SPACES:
            left -= 1
        if start < 0:
            start = left
        elif left - stop != 1 or text[stop] != " ":
            yield start, stop
            start = left
        stop = m.end()
    if start >= 0:
        yield start, stop


def candidates(text: str, atoms: list[tuple[int, int]]) -> Iterator[tuple[int, int, str, list[str]]]:
    """First and last atom (exclusive), type and features of every segment worth a score."""
    for i in range(len(atoms)):
        first = text[atoms[i][0]]
        if first == " ":
            continue
        for j in range(i + 1, min(i + MAX_ATOMS, len(atoms)) + 1):
            last = text[atoms[j - 1][1] - 1]
            if not (last.isalnum() or last == ")"):
                continue
            start, stop = atoms[i][0], atoms[j - 1][1]
            span = text[start:stop]
            if len(span) > 80:
                break
            before = text[start - 1] if start else " "
            behind = text[stop] if stop < len(text) else " "
            edge = [f"<{_shape(before)}", f">{_shape(behind)}"]
            if "@" in span:
                name, _, host = span.partition("@")
                if name and "." in host and "@" not in host and " " not in span:
                    yield i, j, "email", [*edge, f"host{min(host.count('.'), 3)}", f"tld{min(len(host.rsplit('.', 1)[1]), 5)}", f"first{_shape(name[0])}"]
                continue
            digits = NOT_DIGIT.sub("", span)
            if not span[0].isdigit() and span[0] not in "+(" or not span[-1].isdigit():
                continue
            if span.count(".") == 3 and first.isdigit() and len(digits) + 3 == len(span) and all(span.split(".")):
                octets = span.split(".")
                yield i, j, "ip", [*edge, f"octets{all(len(o) <= 3 and int(o) <= 255 for o in octets)}", f"zero{any(len(o) > 1 and o[0] == '0' for o in octets)}"]
            rest = set(span) - set("0123456789")
            if 12 <= len(digits) <= 20 and first.isdigit() and rest <= set(" -./"):
                groups = tuple(map(len, re.findall("[0-9]+", span)))
                even = "one" if len(groups) == 1 else "fours" if set(groups[:-1]) == {4} else "other"
                yield i, j, "card", [*edge, f"n{len(digits)}", f"luhn{luhn(digits)}", f"groups-{even}", f"sep{len(rest)}"]
            if 7 <= len(digits) <= 15 and rest <= set(" -.()+"):
                groups = [len(x) for x in re.findall("[0-9]+", span)]
                yield i, j, "phone", [*edge, f"n{len(digits)}", f"plus{first == '+'}", f"paren{'(' in span and ')' in span}", f"groups{min(len(groups), 5)}", f"tail{min(groups[-1], 5)}", f"sep{bool(rest - set('+'))}"]


def _shape(c: str) -> str:
    return "0" if c.isdigit() else "a" if c.isalpha() else "_" if c.isspace() else c if c in ".,;:+-@()/" else "#"


def lattice(text: str, span: tuple[int, int]) -> tuple[list[tuple[int, int]], list[tuple[int, int, str, list[str]]]]:
    atoms = [(span[0] + m.start(), span[0] + m.end()) for m in ATOM.finditer(text[span[0] : span[1]])]
    return atoms, [(i, j, kind, [kind, *(f"{kind}:{f}" for f in features)]) for i, j, kind, features in candidates(text, atoms)]


def decode(weights: dict[str, float], text: str, span: tuple[int, int]) -> list[Span]:
    """The best segmentation of a region; an atom outside an entity scores zero."""
    atoms, segments = lattice(text, span)
    ending = defaultdict(list)
    for i, j, kind, features in segments:
        score = sum(weights.get(f, 0.0) for f in features)
        if score > 0:
            ending[j].append((i, kind, score))
    best, back = [0.0] * (len(atoms) + 1), [None] * (len(atoms) + 1)
    for j in range(1, len(atoms) + 1):
        best[j] = best[j - 1]
        for i, kind, score in ending[j]:
            if best[i] + score > best[j]:
                best[j], back[j] = best[i] + score, (i, kind)
    found, j = [], len(atoms)
    while j > 0:
        if back[j] is None:
            j -= 1
        else:
            i, kind = back[j]
            found.append((kind, atoms[i][0], atoms[j - 1][1]))
            j = i
    return found[::-1]


def fit(examples: list[tuple[str, list[Span]]]) -> dict[str, float]:
    """Stochastic gradient of the conditional log-likelihood; sums over segmentations in log space."""
    data = []
    for text, spans in examples:
        atoms, segments = lattice(text, (0, len(text)))
        at = {a: k for k, (a, _) in enumerate(atoms)}
        to = {b: k + 1 for k, (_, b) in enumerate(atoms)}
        gold = {(at[s], to[e], kind) for kind, s, e in spans if s in at and e in to}
        if segments:
            data.append((len(atoms), segments, gold))
    weights: dict[str, float] = defaultdict(float)
    for epoch in range(EPOCHS):
        rate = 0.5 / (1 + epoch)
        for n, segments, gold in data:
            scores = [sum(weights[f] for f in s[3]) for s in segments]
            ending, starting = defaultdict(list), defaultdict(list)
            for k, (i, j, _, _) in enumerate(segments):
                ending[j].append(k)
                starting[i].append(k)
            forward, backward = [0.0] * (n + 1), [0.0] * (n + 1)
            for j in range(1, n + 1):
                forward[j] = _logsum([forward[j - 1], *(forward[segments[k][0]] + scores[k] for k in ending[j])])
            for i in range(n - 1, -1, -1):
                backward[i] = _logsum([backward[i + 1], *(backward[segments[k][1]] + scores[k] for k in starting[i])])
            for k, (i, j, kind, features) in enumerate(segments):
                p = math.exp(min(0.0, forward[i] + scores[k] + backward[j] - forward[n]))
                step = rate * (((i, j, kind) in gold) - p)
                if abs(step) > 1e-6:
                    for f in features:
                        weights[f] = weights[f] * (1 - 1e-4) + step
    return dict(weights)


def _logsum(x: list[float]) -> float:
    top = max(x)
    return top + math.log(sum(math.exp(v - top) for v in x))


def train(docs: DataFrame) -> dict[str, float]:
    """Weights from a bounded draw of documents and regions."""
    spark = docs.sparkSession
    small_batches(spark)
    drawn = docs.select("doc_id").where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_DOCS)
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).where("text is not null").join(F.broadcast(drawn), "doc_id")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            snippet, spans = [], []
            for text in batch.column("text").to_pylist():
                base = base_spans(text)
                for start, stop in regions(text):
                    if stop - start <= 200:
                        inside = [(k, a, b) for k, a, b in base if start <= a and b <= stop]
                        snippet.append(f" {text[start:stop]} ")
                        spans.append(",".join(f"{k}:{a - start + 1}:{b - start + 1}" for k, a, b in inside))
            yield pa.RecordBatch.from_arrays([pa.array(snippet, pa.string()), pa.array(spans, pa.string())], ["snippet", "spans"])

    rows = texts.mapInArrow(cut, "snippet string, spans string").orderBy(F.xxhash64("snippet"), "snippet").limit(FIT_REGIONS).collect()
    examples = []
    for r in rows:
        spans = [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in r["spans"].split(",") if x)]
        examples.append((r["snippet"], spans))
        examples.extend(_respelled(r["snippet"], spans))
    return fit(examples) if any(s for _, s in examples) else {}


def _respelled(snippet: str, spans: list[Span]) -> Iterator[tuple[str, list[Span]]]:
    """Spellings of the same number that the base patterns do not match."""
    for kind, a, b in spans:
        span = snippet[a:b]
        if kind == "phone" and (m := re.search(r"\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}\Z", span)):
            yield f" {m.group()} ", [("phone", 1, 1 + len(m.group()))]
        elif kind == "card" and span.isdigit():
            for sep in "./":
                spaced = sep.join(span[i : i + 4] for i in range(0, len(span), 4))
                yield f" {spaced} ", [("card", 1, 1 + len(spaced))]


def all_spans(weights: dict[str, float], text: str) -> tuple[list[Span], list[Span]]:
    """Base spans, and base and added spans together, both by kind and start."""
    base = base_spans(text)
    if not weights:
        return base, base
    taken = sorted((a, b) for _, a, b in base)
    added, k = [], 0
    for region in regions(text):
        while k < len(taken) and taken[k][1] <= region[0]:
            k += 1
        inside = []
        n = k
        while n < len(taken) and taken[n][0] < region[1]:
            inside.append(taken[n])
            n += 1
        if not inside or region[1] - region[0] > sum(b - a for a, b in inside):
            for kind, a, b in decode(weights, text, region):
                if all(b <= x or a >= y for x, y in inside):
                    added.append((kind, a, b))
    return base, sorted([*base, *added], key=lambda s: (KINDS.index(s[0]), s[1]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find(docs: DataFrame, weights: dict[str, float]) -> DataFrame:
    """doc_id, counts of the base kinds, digest of the base spans, all spans; one pass, no shuffle."""
    small_batches(docs.sparkSession)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digest, spans = [[], [], [], []], [], []
            for text in batch.column("text").to_pylist():
                base, every = all_spans(weights, text or "")
                kinds = [k for k, _, _ in base]
                for n, kind in enumerate(KINDS):
                    counts[n].append(kinds.count(kind))
                digest.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append(joined(every))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(digest, pa.string()), pa.array(spans, pa.string())],
                ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"],
            )

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(found, f"doc_id {kind}, {', '.join(f'n_{k} long' for k in KINDS)}, base_sha256 string, spans string")


def personal_data(docs: DataFrame) -> DataFrame:
    return find(docs, train(docs))


def masked(text: str, spans: list[Span]) -> str:
    """The text with every span replaced by its kind; overlapping spans become one mark."""
    out, end = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= end:
            out += [text[end:a], f"[{kind.upper()}]"]
        end = max(end, b)
    return "".join([*out, text[end:]])


def mask(docs: DataFrame) -> DataFrame:
    """`docs` with personal data masked in `text` and `n_chars` counted anew; all columns kept."""
    small_batches(docs.sparkSession)
    weights = train(docs)
    at = docs.columns.index("text")
    length = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def replaced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t if t is None else masked(t, all_spans(weights, t)[1]) for t in batch.column(at).to_pylist()]
            columns = list(batch.columns)
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            if length is not None:
                columns[length] = pa.array([None if t is None else len(t) for t in texts], batch.schema.field(length).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(replaced, docs.schema)

"""Fill-in-the-middle, class bigrams and ranked search against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_operators import SCHEMA, prose
from tonegauge.llm import class_bigrams, fill_middle, ranked_search
from tonegauge.llm.fill_middle import Settings

HARD = [None, "", "\n", "\n\n\n", "one line", "a\nb", "a\nb\n", "é\nß\nñ\n x", "has <P> inside\nx", "<S", "x <M", "tail <\nM>", "A-B_c 1é2 \x00 z", "z" * 70_000 + "\n" + "y" * 70_001, " \t\n "]


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 0, "x", "x", "x", "x") for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(11)
    texts = [*HARD, *["\n".join(prose(r, r.randint(0, 12)) for _ in range(r.randint(1, 9))) for _ in range(60)]]
    numbered = list(enumerate(texts, 3))
    return [*numbered, numbered[20], (numbered[20][0], "same id\nother text"), (None, "no id\nat all"), (None, "nor here"), (-4, "minus\nfour\n")]


# --- fill in the middle -----------------------------------------------------------------------


def plain_fim(doc_id, text, seed=7):
    lines = re.findall(r"[^\n]*\n|[^\n]+", text or "")
    hexed = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(hexed[k : k + 8], 16) for k in (0, 8, 16, 24)]
    n = len(lines)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = ("".join(x) for x in (lines[:a], lines[a:b], lines[b:]))
    if not text or re.search("<[PSM]>", text):
        return n, "plain", None, None, text or ""
    if h[3] % 100 < 50:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_fill_in_middle_against_brute_force(spark, rows):
    made = fill_middle.restore(fill_middle.fill_in_middle(documents(spark, rows))).collect()
    key = lambda row: repr(row)
    got = sorted(((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"], r["restored"]) for r in made), key=key)
    assert got == sorted(((i, *plain_fim(i, t), t or "") for i, t in rows), key=key)
    assert {r["form"] for r in made} == {"plain", "psm", "spm"}
    digests = fill_middle.digests(documents(spark, rows)).collect()
    of = lambda text: hashlib.sha256(text.encode()).hexdigest()
    assert sorted((r["output_sha256"], r["restored_sha256"]) for r in digests) == sorted((of(plain_fim(i, t)[4]), of(t or "")) for i, t in rows)


def test_fill_in_middle_of_nothing(spark):
    assert fill_middle.digests(documents(spark, [])).collect() == []


def test_rotation_is_exact_and_marks_do_not_overlap(monkeypatch):
    monkeypatch.setattr(fill_middle, "SCRAP", 3)
    r = random.Random(2)
    for _ in range(300):
        data = bytes(r.randrange(256) for _ in range(r.randint(0, 40)))
        start, cut, end = sorted(r.randint(0, len(data)) for _ in range(3))
        buffer = bytearray(data)
        fill_middle.rotate(buffer, start, cut, end)
        assert bytes(buffer) == data[:start] + data[cut:end] + data[start:cut] + data[end:]
        text = re.sub(rb"<[PSM]>", b"", data)
        for form_rate in (0, 100):
            settings = Settings(spm_rate=form_rate)
            _, form, _, _, output = fill_middle.arrange(text, 5, settings)
            assert fill_middle.rearranged_back(output, form, settings) == text
    assert fill_middle.arrange(b"a\nb", 1, Settings(rate=0))[1] == "plain"
    for wrong in (Settings, lambda **k: Settings(**k)):
        with pytest.raises(ValueError):
            wrong(prefix="<P<", suffix="<P>")
    with pytest.raises(ValueError):
        Settings(middle="")


# --- class bigrams ----------------------------------------------------------------------------


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 10 == 0


def test_gains_are_those_of_the_likelihood():
    r = np.random.default_rng(3)
    bigrams = r.poisson(1.5, (9, 9)).astype(float)
    for w in range(8):
        of = np.concatenate([r.integers(0, 3, 8), [3]])

        def table(cls):
            n = np.zeros((4, 4))
            now = of.copy()
            now[w] = cls
            for a in range(9):
                for b in range(9):
                    if cls is not None or w not in (a, b):
                        n[now[a], now[b]] += bigrams[a, b]
            return n

        without = np.zeros((4, 4))
        for a in range(9):
            for b in range(9):
                if w not in (a, b):
                    without[of[a], of[b]] += bigrams[a, b]
        right = np.array([sum(bigrams[w, b] for b in range(9) if b != w and of[b] == c) for c in range(4)])
        left = np.array([sum(bigrams[a, w] for a in range(9) if a != w and of[a] == c) for c in range(4)])
        gain = class_bigrams.gains(without, right, left, bigrams[w, w], 3)
        full = [class_bigrams.likelihood(table(k)) for k in range(3)]
        assert np.allclose(gain - gain[0], np.array(full) - full[0])


def test_exchange_ends_where_no_single_move_gains():
    r = np.random.default_rng(5)
    halves = np.kron(np.array([[9.0, 1.0], [1.0, 9.0]]), np.ones((6, 6)))
    bigrams = np.zeros((13, 13))
    bigrams[:12, :12] = r.poisson(halves)
    of, n = class_bigrams.exchange(bigrams, 2)
    assert len(set(of[:6])) == 1 and len(set(of[6:12])) == 1 and of[0] != of[6] and of[12] == 2
    again = np.zeros((3, 3))
    np.add.at(again, (of[:, None], of[None, :]), bigrams)
    assert np.allclose(n, again)


def test_scores_against_brute_force(spark, rows, monkeypatch):
    monkeypatch.setattr(class_bigrams, "BLOCK_BYTES", 2000)
    docs = documents(spark, rows)
    got = class_bigrams.class_bigram_scores(docs, classes=3, anchors=12).collect()
    assert len(got) == len(rows)
    blocks = class_bigrams.encoded(docs)
    model = class_bigrams.learn(blocks, 3, 12)
    of = {bytes(r["word"]): (r["class"], r["n"]) for r in model.words.collect()}
    tokens = {True: [], False: []}
    for i, t in rows:
        tokens[held(i)].append([*(w.encode() for w in words_of(t)), b" "])
    count = Counter(w for doc in tokens[False] for w in doc)
    assert {w: n for w, (_, n) in of.items()} == count
    n, v = sum(count.values()), len(count)
    none, end = model.none, model.end
    steps = np.zeros((none + 1, none + 1))
    for doc in tokens[False]:
        for a, b in zip([b" ", *doc], doc):
            steps[of[a][0], of[b][0]] += 1
    logs = class_bigrams.log_steps(model, steps)
    under = model.emissions()
    expected = []
    for i, t in rows:
        doc = [*(w.encode() for w in words_of(t)), b" "]
        base = sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in doc)
        score, before = 0.0, end
        for w in doc:
            c, seen = of.get(w, (none, 0))
            score += logs[before, c] + (math.log10((seen + class_bigrams.UNSEEN) / under[c]) if seen else 0.0)
            before = c
        expected.append((i, held(i), len(doc), sum(w in count for w in doc), n, base, score))
    key = lambda row: (repr(row[0]), row[2], row[5])
    found = sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in got), key=key)
    for a, b in zip(found, sorted(expected, key=key)):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-9)
    # After every class, known words and the unknown ones together have probability 1.
    step = 10.0**logs
    for before in range(none + 1):
        total = step[before, none]
        for c, seen in of.values():
            total += step[before, c] * (seen + class_bigrams.UNSEEN) / under[c]
        assert total == pytest.approx(1.0)


def test_a_block_is_a_small_share_of_an_executors_memory(spark):
    text = "".join(f"w{i % 4000} " for i in range(40_000))
    docs = spark.range(50).select(F.col("id").alias("doc_id"), F.lit(text).alias("text")).coalesce(1)
    blocks = class_bigrams.encoded(docs).select("block", F.size("doc_ids").alias("n"), F.length("tokens").alias("size")).collect()
    assert sum(r["n"] for r in blocks) == 50 and len({r["block"] for r in blocks}) == len(blocks) > 1
    assert max(r["n"] for r in blocks) * len(text) <= (4 << 20) + len(text)
    assert sum(r["size"] for r in blocks) == 50 * 40_001 * 4


def test_exchange_meets_every_neighbour_of_every_word(spark, rows, monkeypatch):
    monkeypatch.setattr(class_bigrams, "BLOCK_BYTES", 2000)
    blocks = class_bigrams.encoded(documents(spark, rows))
    known = class_bigrams.vocabulary(blocks, 24)
    assert known.parts > 1
    top = class_bigrams.most_frequent(known, 12)
    train = [[*(w.encode() for w in words_of(t)), b" "] for i, t in rows if not held(i)]
    count = Counter(w for doc in train for w in doc if w != b" ")
    assert top == sorted(count, key=lambda w: (-count[w], w))[:12]
    state = class_bigrams.anchored(known, {w: k % 3 for k, w in enumerate(top)})
    state = class_bigrams.moved(known, state, *class_bigrams.contexts(blocks, known, state, 3), 3, all_words=False)
    of = {bytes(r["word"]): r["class"] for r in class_bigrams.described(known, state, 3).words.collect()}
    assert len(set(of.values())) > 3
    beside, n = class_bigrams.contexts(blocks, known, state, 3)
    expected, steps = Counter(), np.zeros((5, 5))
    for doc in train:
        for a, b in zip([b" ", *doc], doc):
            steps[of[a], of[b]] += 1
            if a == b != b" ":
                expected[a, 10] += 1
            else:
                expected[b, of[a]] += 1
                expected[a, 5 + of[b]] += 1
    assert np.array_equal(n, steps)
    got, own, places = Counter(), {}, {}
    for r in known.rows.collect():
        if r["block"] < 0:
            own[r["part"]] = bytes(r["words"]).split(b"\n")
        else:
            places[r["part"], r["block"]] = class_bigrams.numbers(r["places"])
    for r in beside.collect():
        at = np.repeat(places[r["part"], r["block"]], class_bigrams.numbers(r["sizes"]))
        for i, cell, m in zip(at, class_bigrams.numbers(r["cells"]), class_bigrams.numbers(r["counts"])):
            got[own[r["part"]][i], int(cell)] += int(m)
    assert got == Counter({key: m for key, m in expected.items() if key[0] != b" "})


def test_words_away_from_anchors_find_their_classes(spark):
    r = random.Random(4)
    xs, ys = [f"x{k}" for k in range(15)], [f"y{k}" for k in range(15)]
    texts = [" ".join(["x0", *(r.choice((ys, xs)[k % 2]) for k in range(40)), "y0"]) for _ in range(150)]
    texts += ["p q " * 100] * 100
    model = class_bigrams.learn(class_bigrams.encoded(documents(spark, list(enumerate(texts)))), 4, 2)
    assert len(xs + ys) + 3 == model.words.count()
    assert model.distinct[model.rest] == 0 and model.tokens[model.rest] == 0


def test_classes_beat_word_counts_on_held_out_text(spark):
    r = random.Random(1)
    tongues = [[f"{x}{k}" for k in range(120)] for x in "abcd"]
    texts = [" ".join(r.choices(t, weights=[1 / (k + 1) for k in range(120)], k=40)) for t in (r.choice(tongues) for _ in range(900))]
    got = class_bigrams.class_bigram_scores(documents(spark, list(enumerate(texts))), classes=4, anchors=60)
    sums = got.where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b"), F.min(F.col("perplexity")).alias("p")).first()
    assert sums["s"] > 0.8 * sums["b"] and sums["p"] > 1


def test_class_bigrams_without_training_text(spark):
    assert class_bigrams.class_bigram_scores(documents(spark, [])).collect() == []
    only = next(i for i in range(100) if held(i))
    (r,) = class_bigrams.class_bigram_scores(documents(spark, [(only, "a b")])).collect()
    assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (3, 0, 0) and math.isfinite(r["score"])
    with pytest.raises(ValueError):
        class_bigrams.learn(class_bigrams.encoded(documents(spark, [])), 251)


# --- ranked search ----------------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def plain_search(rows, items, k):
    docs = [(i, terms(t)) for i, t in rows if terms(t)]
    n_docs, n_said = len(docs), sum(len(s) for _, s in docs)
    df = Counter(t for _, s in docs for t in set(s))
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for item, wanted in asked.items():
        scored = []
        for doc_id, said in docs:
            m = 50 + 50 * len(said) * n_docs // n_said
            tf = Counter(said)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 20 * m)) for t in wanted if tf[t])
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0))
        out += [(item, rank, None if none else doc_id, -score) for rank, (score, none, doc_id) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def items_of(rows):
    return [(1, rows[30][1]), (2, "the The THE er"), (2, "ou"), (None, rows[25][1]), (4, ""), (5, None), (6, "nowhere-found"), (7, "é2 a b z"), (8, rows[40][1])]


@pytest.mark.parametrize("k, item_bytes, postings, step", [(50, 1 << 22, 1 << 20, 64), (3, 60, 40, 1), (1, 1 << 22, 200, 2)])
def test_ranked_search_against_brute_force(spark, rows, monkeypatch, k, item_bytes, postings, step):
    monkeypatch.setattr(ranked_search, "POSTINGS", postings)
    monkeypatch.setattr(ranked_search, "STEP", step)
    items = items_of(rows)
    queries = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    got = ranked_search.ranked_search(documents(spark, rows), queries, k, item_bytes).collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain_search(rows, items, k)


def test_ranked_search_of_nothing(spark, rows):
    queries = spark.createDataFrame([(1, "the")], "item_id long, text string")
    assert ranked_search.ranked_search(documents(spark, []), queries).collect() == []
    assert ranked_search.ranked_search(documents(spark, rows), queries.limit(0)).collect() == []


def test_best_positions_stop_early_and_never_too_early():
    r = np.random.default_rng(8)
    stopped = 0
    for turn in range(60):
        docs, n_terms = 400, 12
        held = r.random((docs, n_terms)) < r.choice([0.05, 0.3, 0.9])
        value = np.where(held, r.zipf(1.6, (docs, n_terms)).clip(1, 50 if turn % 2 else 10**6), 0)
        doc, term = np.nonzero(value)
        lists = ranked_search.Lists(doc, term, value[doc, term].astype(np.int64), docs, n_terms)
        for _ in range(3):
            wanted = np.sort(r.choice(n_terms, 3, replace=False))
            best = ranked_search.Best(5)
            scored = ranked_search.best_positions(lists, wanted, np.zeros(docs, bool), np.arange(docs), best)
            totals = value[:, wanted].sum(1)
            expected = sorted((-s, d) for d, s in enumerate(totals.tolist()) if s)[:5]
            assert [(-s, d) for s, d in zip(best.score.tolist(), best.doc_id.tolist())] == expected
            assert not lists.seen.any() and not lists.wanted.any()
            stopped += scored < np.count_nonzero(totals)
    assert stopped > 60

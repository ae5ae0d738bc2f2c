"""Quality rules as a short-circuit cascade, in column expressions only.

The counts of the contract are computed for every document. The verdict adds `RULES`, each a condition
that rejects. On a drawn sample of at most `SAMPLE_ROWS` documents every rule is timed and its rejection
rate counted; the cascade asks the rules in falling order of rejections per second and stops at the
first that rejects (a CASE, so later conditions are not evaluated). Order changes cost, never verdicts.

Edge cases: null text is a text without words and fails; a text without lines with words has no repeated
line; rows repeated are judged alike; an empty table gives no rows and keeps the rules' given order.
Extra columns are ignored.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonegauge.llm.common import SPACE, WORD
from tonegauge.session import materialise

SAMPLE_ROWS = 2000
WINDOW = 5
SYMBOLS = "[#*$%&|<>]"


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Column


def rules() -> list[Rule]:
    """Conditions over the counted columns and the text; true rejects."""
    n, chars = F.col("n_words"), F.col("word_chars")
    count = lambda pattern: F.size(F.regexp_extract_all("__text", F.lit(pattern), F.lit(0)))
    return [
        Rule("symbols", F.col("n_symbols") > 0.1 * chars),
        Rule("repeated_lines", F.col("n_dup_lines") > 0.5 * F.size("__lines")),
        Rule("word_length", (chars > 20 * n) | (chars < 2 * n)),
        Rule("capitals", count("\\p{Lu}") > 0.6 * chars),
        Rule("exclamations", count("!") > 0.5 * n),
        Rule("letters", count("\\p{L}") < 0.5 * chars),
    ]


def counted(docs: DataFrame) -> DataFrame:
    """doc_id, the counts and base_failed, with working columns whose names start with two underscores."""
    has_word = lambda line: line.rlike(f"[^{SPACE[1:-1]}]")
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("__text"))
    rows = rows.select("*", F.regexp_extract_all("__text", F.lit(WORD), F.lit(0)).alias("__words"), F.filter(F.split("__text", "\n"), has_word).alias("__lines"))
    rows = rows.select("doc_id", "__text", "__lines", F.size("__words").cast("long").alias("n_words"), F.length(F.array_join("__words", "")).cast("long").alias("word_chars"), F.transform("__words", lambda w: F.xxhash64(w)).alias("__h"))
    window = lambda i: F.xxhash64(*(F.get("__h", i + k) for k in range(WINDOW)))
    starts = F.sequence(F.lit(0), F.col("n_words").cast("int") - WINDOW)
    rows = rows.select("*", F.when(F.col("n_words") >= WINDOW, F.transform(starts, window)).otherwise(F.array().cast("array<bigint>")).alias("__g")).drop("__h")
    # Most texts repeat no window; only the others are sorted.
    repeats = F.size(F.array_distinct("__g")) < F.size("__g")
    rows = rows.select("*", F.when(repeats, F.array_sort(F.transform("__g", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))).alias("__s")).drop("__g")
    other = lambda x, k: F.coalesce(x["g"] == F.get("__s", k)["g"], F.lit(False))
    shared = F.filter("__s", lambda x, k: other(x, k - 1) | other(x, k + 1))
    at = F.array_sort(F.transform(shared, lambda x: x["i"]))
    zero = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n"))
    step = lambda s, p: F.struct(p.alias("last"), (s["n"] + F.least(F.lit(WINDOW), p - s["last"])).alias("n"))
    rows = rows.select(
        "*",
        F.size(F.regexp_extract_all("__text", F.lit(SYMBOLS), F.lit(0))).cast("long").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(F.when(F.col("__s").isNotNull(), F.aggregate(at, zero, step, lambda s: s["n"])), F.lit(0)).cast("long").alias("n_repeat_words"),
    ).drop("__s")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return rows.withColumn("base_failed", failed)


def cascade_order(docs: DataFrame, candidates: list[Rule]) -> list[Rule]:
    """Rules by rejections per second on the sample; a rule that rejects nothing comes last, the cheaper first."""
    drawn = docs.select("doc_id").where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS)
    sample = materialise(counted(docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id")), "rule-sample").where("not base_failed")
    measured = []
    for rule in candidates:
        began = time.perf_counter()
        rejected = sample.agg(F.sum(rule.rejects.cast("long")).alias("n")).first()["n"] or 0
        seconds = time.perf_counter() - began
        measured.append((-rejected / max(seconds, 1e-6), seconds, rule))
    return [rule for _, _, rule in sorted(measured, key=lambda x: x[:2])]


def quality_rules(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept."""
    verdict = F.when(F.col("base_failed"), False)
    for rule in cascade_order(docs, rules()):
        verdict = verdict.when(rule.rejects, False)
    return counted(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", verdict.otherwise(True).alias("kept")
    )

"""Naming the entity a text is about by dictionary containment."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonegauge.operators.filters import require_columns

# Entities and the keywords that name them; earlier entries win.
ENTITY_KEYWORDS: dict[str, list[str]] = {
    "HDFC Bank": ["hdfc bank", "hdfc", "housing development finance"],
    "ICICI Bank": ["icici bank", "icici"],
    "Yes Bank": ["yes bank", "yesbank"],
    "Infosys": ["infosys", "infy"],
    "Tata Motors": ["tata motors", "tata motor", "jaguar", "land rover", "jlr"],
    "Reliance Industries": ["reliance industries", "reliance", "ril", "jio"],
    "Paytm": ["paytm", "one97", "one97 communications"],
    "Zomato": ["zomato"],
    "Adani Group": ["adani", "gautam adani"],
    "Wipro": ["wipro"],
    "Goldman Sachs": ["goldman", "goldman sachs"],
    "JPMorgan Chase": ["jpmorgan", "jp morgan", "jpm"],
    "Morgan Stanley": ["morgan stanley"],
    "Apple": ["apple inc", "apple", "aapl", "iphone"],
    "Microsoft": ["microsoft", "msft", "azure"],
    "Amazon": ["amazon", "aws"],
    "Tesla": ["tesla", "elon musk"],
    "Nvidia": ["nvidia", "nvda", "gpu"],
}

# The names looked for when a table has no entity column.
KNOWN_ENTITIES = (
    "Goldman Sachs",
    "HDFC Bank",
    "Reliance Industries",
    "Adani Group",
    "Infosys",
    "Tata Motors",
    "Yes Bank",
    "Paytm",
    "Zomato",
    "ICICI Bank",
)
GENERAL_MARKET = "General Market"
UNKNOWN_ENTITY = "Unknown"

Rule = tuple[str, str]


def keyword_rules(keywords: dict[str, Sequence[str]]) -> list[Rule]:
    """(keyword, entity) pairs in priority order."""
    return [(word.lower(), entity) for entity, words in keywords.items() for word in words]


def _is_word(c: str) -> bool:
    return c.isalnum() or c in "\u200c\u200d" or unicodedata.category(c) in ("Mn", "Me", "Mc", "Pc")


def _trie_pattern(node: dict) -> str:
    """Regular expression of the words below a node; the longest word that fits is tried first."""
    ways = [
        (c if c.isalnum() else f"\\{c}") + _trie_pattern(below)
        for c, below in sorted(node.items())
        if c
    ]
    if not ways:
        return ""
    joined = ways[0] if len(ways) == 1 and "" not in node else f"(?:{'|'.join(ways)})"
    return f"{joined}?" if "" in node else joined


def keyword_pattern(words: Sequence[str]) -> str:
    """One pattern for all words: what it tries at a place depends on their letters, not their number."""
    root: dict = {}
    for word in words:
        node = root
        for c in word:
            node = node.setdefault(c, {})
        node[""] = {}
    return _trie_pattern(root)


def _listed(values: Sequence[str]) -> Column:
    """A constant array from one literal, which Spark folds once; quick to build at any length."""
    return F.split(F.lit("\0".join(values)), "\0", -1)


def matched_entity(text: Column, rules: Sequence[Rule], word_boundary: bool = False) -> Column:
    """Entity of the first rule whose keyword occurs in the text, NULL if none does.

    Map-side only: the dictionary is configuration and travels inside the expression, so neither
    the text nor the dictionary is shuffled or joined. Matching is by substring unless
    `word_boundary` is set.
    """
    if not rules:
        return F.lit(None).cast("string")
    rank: dict[str, int] = {}
    for at, (word, _) in enumerate(rules):
        rank.setdefault(word, at)
    # The pattern finds the longest word at each place; the shorter ones that start there are known from it.
    best = {}
    for word in rank:
        starts = [n for n in range(len(word)) if not (word_boundary and _is_word(word[n]))]
        best[word] = min(rank.get(word[:n], rank[word]) for n in [*starts, len(word)])
    pattern = f"({keyword_pattern(list(rank))})"
    pattern = rf"(?U)(?<!\w)(?={pattern}(?!\w))" if word_boundary else f"(?={pattern})"
    hits = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(1)))
    # The words by rank: the first of them that was hit counts, found by one walk over them for each text.
    ordered = sorted(best, key=lambda word: best[word])
    words = _listed(ordered)
    place = F.array_position(words, F.get(F.array_intersect(words, hits), F.lit(0)))
    return F.get(_listed([rules[best[word]][1] for word in ordered]), (place - 1).cast("int"))


def infer_entity(
    df: DataFrame,
    text: str = "headline",
    keywords: dict[str, Sequence[str]] | None = None,
    default: str | None = GENERAL_MARKET,
    into: str = "entity",
    word_boundary: bool = False,
) -> DataFrame:
    """Attach the entity named by the keyword dictionary, or `default`."""
    found = matched_entity(F.col(text), keyword_rules(keywords or ENTITY_KEYWORDS), word_boundary)
    return df.withColumn(into, found if default is None else F.coalesce(found, F.lit(default)))


def enrich_entities(
    df: DataFrame, text: str = "headline", known: Sequence[str] = KNOWN_ENTITIES
) -> DataFrame:
    """Add `entity` from the known names when the table has none; otherwise leave it alone."""
    require_columns(df, [text])
    if "entity" in df.columns:
        return df
    found = matched_entity(F.col(text), [(name.lower(), name) for name in known])
    return df.withColumn("entity", F.coalesce(found, F.lit(UNKNOWN_ENTITY)))

"""Entities by a keyword dictionary that is a table of any size.

A dictionary of up to `PATTERN` keywords becomes one prefix-tree pattern and is matched in one pass over each
text (`operators.entities`); its cost follows the text. For a larger one a q-gram filter turns "the text contains the keyword" into an equality join: a keyword is filed under the rarest of
its q-grams, a text is looked up with each of its distinct q-grams, and what meets is verified. Texts do not
travel with their q-grams; they are met again by row id, once, for the verification.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonegauge.operators.entities import GENERAL_MARKET, matched_entity
from tonegauge.session import materialise

GRAM = 5  # letters of a q-gram; shorter keywords are their own
PATTERN, LONGEST = 10_000, 200  # keywords, and letters of each, that one pattern takes


def _grams(text: Column, size: Column | int) -> Column:
    """All overlapping pieces of `size` letters, in one walk over the text."""
    pattern = F.concat(F.lit("(?s)(?=(.{"), F.lit(size).cast("string") if isinstance(size, int) else size.cast("string"), F.lit("}))"))
    return F.regexp_extract_all(text, pattern, F.lit(1))


def keyword_index(rules: DataFrame, gram: int = GRAM) -> DataFrame:
    """gram, size, keyword, entity, priority: each keyword once, under its rarest q-gram in the dictionary.

    `rules` has keyword, entity and priority (any type that sorts; the least one counts). Keywords are
    lower-cased; empty and missing ones are left out.
    """
    lowered = rules.select(F.lower("keyword").alias("keyword"), "entity", "priority").filter(F.col("keyword") != "")
    once = lowered.groupBy("keyword").agg(F.min(F.struct("priority", "entity")).alias("rule"))
    sized = once.withColumn("size", F.least(F.char_length("keyword"), F.lit(gram)))
    each = sized.withColumn("gram", F.explode(F.array_distinct(_grams(F.col("keyword"), F.col("size")))))
    counts = each.groupBy("gram").agg(F.count("*").alias("n"))
    rarest = each.join(counts, "gram").groupBy("keyword").agg(
        F.min(F.struct("n", "gram", "size", "rule")).alias("best")
    )
    return rarest.select(
        "best.gram", "best.size", "keyword", F.col("best.rule.entity").alias("entity"), F.col("best.rule.priority").alias("priority")
    )


def listed_rules(index: DataFrame) -> list[tuple[str, str]] | None:
    """(keyword, entity) in order of priority if one pattern can take them all, else None."""
    if dict(index.dtypes)["entity"] != "string":
        return None
    rows = index.orderBy("priority", "entity", "keyword").select("keyword", "entity").limit(PATTERN + 1).collect()
    plain = all(r["entity"] is not None and "\0" not in r["keyword"] + r["entity"] and len(r["keyword"]) <= LONGEST for r in rows)
    return [(r["keyword"], r["entity"]) for r in rows] if plain and len(rows) <= PATTERN else None


def infer_entity_joined(
    df: DataFrame,
    rules: DataFrame,
    row_id: str,
    text: str = "headline",
    default: str | None = GENERAL_MARKET,
    into: str = "entity",
    word_boundary: bool = False,
    gram: int = GRAM,
) -> DataFrame:
    """Attach the entity of the least-priority keyword that the text contains, or `default`.

    `row_id` must be unique. The index of the keywords is written once; which of the few q-gram sizes
    occur in it decides what is taken from the texts.
    """
    index = materialise(keyword_index(rules, gram), "keyword-index")
    few = listed_rules(index)
    if few is not None:
        found = matched_entity(F.col(text), few, word_boundary)
        return df.withColumn(into, found if default is None else F.coalesce(found, F.lit(default)))
    sizes = sorted(r["size"] for r in index.select("size").distinct().collect())  # `gram` numbers at most
    lowered = F.lower(F.col(text))
    pieces = F.flatten(F.array(*[_grams(lowered, size) for size in sizes])) if sizes else F.array().cast("array<string>")
    asked = df.select(row_id, F.explode(F.array_distinct(pieces)).alias("gram"))
    met = asked.join(index, "gram").groupBy(row_id).agg(F.collect_list(F.struct("priority", "entity", "keyword")).alias("__met"))

    def holds(read: Column, rule: Column) -> Column:
        if not word_boundary:
            return F.contains(read, rule["keyword"])
        quoted = F.concat(F.lit(r"(?U)(?<!\w)\Q"), F.replace(rule["keyword"], F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E(?!\w)"))
        return F.regexp_like(read, quoted)

    def first(read: Column) -> Column:
        """Entity of the first rule in order that holds; those behind it are not looked at."""
        none = F.struct(F.lit(False).alias("met"), F.lit(None).cast(index.schema["entity"].dataType).alias("entity"))
        hit = lambda rule: F.struct(F.lit(True).alias("met"), rule["entity"].alias("entity"))
        step = lambda best, rule: F.when(best["met"], best).when(holds(read, rule), hit(rule)).otherwise(best)
        return F.aggregate(F.sort_array("__met"), none, step)["entity"]

    # As a lambda's variable a text is lower-cased once, not once for each of its keywords.
    found = F.transform(F.array(lowered), first)[0]
    joined = df.join(met, row_id, "left")
    return joined.withColumn(into, found if default is None else F.coalesce(found, F.lit(default))).drop("__met")

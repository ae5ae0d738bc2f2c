"""Mixing sources to target weights by entropy balancing.

Every document d of a source s gets a rate r_d, of all rates that meet one token constraint per source, sum of
size_d * r_d = target_s, those closest to one in relative entropy (sum over documents of r log r - r). They tilt
the documents exponentially, r_d = exp(lambda_s * size_d), bounded by `CEILING`, and the multipliers are
the minimum of the convex dual

    sum over documents of exp(lambda_s * size_d) - sum over sources of target_s * lambda_s.

Its gradient and (diagonal) Hessian are sums over documents by source. They are taken over a table of
(source, size, documents), since documents of one size share a rate; each Newton step is one distributed
aggregate of it and leaves one row per source. A step that leaves the interval in which the solution is
known to lie, as the bound on the rates can cause, is replaced by halving the interval. Steps end when every
target is met to `CLOSE`.

Rates become copies: the whole part for every document, and one more for those whose draw, a hash of id and content,
lies furthest below the fraction of their rate. That order is cut where the target is reached: by
sums over `BUCKETS` ranges per source and an exact order inside one range only. The document whose size is
nearest to what is then missing is taken once more.

Only DataFrame functions are used. Aggregates are partial before they shuffle; tables of one row per source are
written, so their size is known when they are joined, and the source is no shuffle key of all rows.

Edge cases: null text or a text without words has size 0 and is taken 0 times; sources order by code
point with null last (null is a source of its own); a single source's target is its own size; rows with null or repeated ids
are rows of their own, and of rows equal in every way any may be taken, as many as the mix needs;
an empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from tonegauge.llm.common import WORD
from tonegauge.session import materialise

WEIGHTS = (5.0, 2.0, 1.0)
CEILING = 3.0  # no target and no document above this multiple
BUCKETS = 1024
STEPS, CLOSE = 80, 1e-7  # Newton steps at most, and the relative distance to the targets that ends them
ROW = "__row"


def numbered(docs: DataFrame) -> DataFrame:
    """The rows with a number of their own, written once, so that it stays."""
    return materialise(docs.withColumn(ROW, F.monotonically_increasing_id()), "mix-rows")


def sized(rows: DataFrame) -> DataFrame:
    """Row number, doc_id, source, size (the words of each text, counted without building them), draw in [0, 1)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    draw = F.pmod(F.xxhash64("doc_id", text, F.lit("mix")), F.lit(1 << 52)) / F.lit(float(1 << 52))
    return rows.select(
        ROW, "doc_id", F.col("source").cast("string").alias("source"), F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))).cast("long").alias("size"), draw.alias("draw")
    )


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, target: one row per source.

    Weighted shares of all words under a ceiling: with sources in order of ceiling / weight the full ones
    are a prefix, and the level of the rest follows from running sums.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything = Window.partitionBy(F.lit(0))
    named = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    weights = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.row_number().over(named) - 1) % len(WEIGHTS) + 1).cast("int"))
    full = F.col("source_size") * CEILING
    rows = by_source.withColumns({"weight": weights, "full": full})
    rows = rows.withColumn("at", F.col("full") / F.col("weight"))
    up = Window.partitionBy(F.lit(0)).orderBy("at", F.col("source").asc_nulls_last())
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns(
        {
            "total": F.sum("source_size").over(everything).cast("double"),
            "full_before": F.coalesce(F.sum("full").over(before), F.lit(0.0)),
            "weight_left": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
        }
    )
    # Level if exactly the sources before this one are full; the first that stays below it sets the level.
    rows = rows.withColumn("level", (F.col("total") - F.col("full_before")) / F.col("weight_left"))
    first = F.min(F.when(F.col("at") >= F.col("level"), F.struct("at", (-F.col("level")).alias("minus")))).over(everything)
    return rows.select("source", "source_size", F.least("full", -first["minus"] * F.col("weight")).alias("target"))


def rate(multiplier: Column, size: Column) -> Column:
    """exp(multiplier * size), bounded; the exponent is bounded first, so nothing overflows."""
    return F.exp(F.least(multiplier * size, F.lit(math.log(CEILING))))


def multipliers(sizes: DataFrame, by_source: DataFrame) -> DataFrame:
    """`by_source` (source, source_size, target) with `multiplier`, the dual solution by Newton steps."""
    counts = materialise(sizes.where("size > 0").groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "mix-sizes-counted")
    # A multiplier of this order changes rates by a factor of e where the tokens are.
    scales = counts.groupBy("source").agg((F.sum(F.col("n") * F.col("size")) / F.sum(F.col("n") * F.col("size") * F.col("size").cast("double"))).alias("scale"))
    # A source that needs every document at the bound has its solution: no document is smaller than one word.
    start = F.when(F.col("target") >= F.col("source_size") * CEILING * (1 - CLOSE), F.lit(math.log(CEILING))).otherwise(F.lit(0.0))
    one = by_source.join(scales.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    unknown = F.lit(None).cast("double")
    one = materialise(one.withColumns({"scale": F.coalesce("scale", F.lit(1.0)), "multiplier": start, "low": unknown, "high": unknown}), "mix-step")
    for _ in range(STEPS):
        now = one.select(F.col("source").alias("s"), "multiplier")
        r = rate(F.col("multiplier"), F.col("size"))
        moving = F.when(r < CEILING, r).otherwise(0.0)  # at the bound a rate no longer answers
        tokens, size = F.col("n") * F.col("size"), F.col("size").cast("double")
        sums = counts.join(now, F.col("source").eqNullSafe(F.col("s"))).groupBy("s").agg(F.sum(tokens * r).alias("met"), F.sum(tokens * size * moving).alias("slope"))
        joined = one.join(sums, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
        gap = F.coalesce("met", F.lit(0.0)) - F.col("target")
        m, low, high = F.col("multiplier"), F.when(gap <= 0, F.col("multiplier")).otherwise(F.col("low")), F.when(gap >= 0, F.col("multiplier")).otherwise(F.col("high"))
        step = m - F.try_divide(gap, F.col("slope"))
        # Without a bound on one side yet, a step is at most twice as far out, the first one of the scale.
        outward = F.when(gap > 0, F.least(m * 2, -F.col("scale"))).otherwise(F.greatest(m * 2, F.col("scale")))
        halved = F.when(low.isNotNull() & high.isNotNull(), (low + high) / 2).otherwise(outward)
        inside = step.isNotNull() & (low.isNull() | (step > low)) & (high.isNull() | (step < high)) & (F.abs(step) <= F.greatest(F.abs(m) * 2, F.col("scale")))
        done = (F.abs(gap) <= F.col("target") * CLOSE) | (F.col("target") <= 0)
        furthest = Observation()
        one = materialise(
            joined.select("source", "source_size", "target", "scale", F.when(done, m).when(inside, step).otherwise(halved).alias("multiplier"), low.alias("low"), high.alias("high"), done.alias("done"))
            .observe(furthest, F.count_if(~F.col("done")).alias("open"))
            .drop("done"),
            "mix-step",
        )
        if not furthest.get["open"]:
            break
    return one.select("source", "source_size", "target", "multiplier")


def mixed(rows: DataFrame) -> DataFrame:
    """Row number, doc_id, source, size, source_size, target, rate, copies of every row of `numbered`."""
    sizes = materialise(sized(rows), "mix-sizes")
    plan = multipliers(sizes, materialise(targets(sizes), "mix-sources"))
    few = plan.select(F.col("source").alias("s"), "source_size", "target", "multiplier")
    same_source = F.col("source").eqNullSafe(F.col("s"))
    r = F.when((F.col("size") > 0) & (F.col("target") > 0), rate(F.col("multiplier"), F.col("size"))).otherwise(F.lit(0.0))
    tilted = sizes.join(few, same_source).drop("s").withColumn("rate", r)
    # Just below a whole number counts as that number.
    whole = F.least(F.floor(F.col("rate") + 1e-9), F.lit(int(CEILING))).cast("long")
    tilted = tilted.withColumn("whole", whole)
    # Furthest below its fraction first; between -1 and 1. Rows that may not or need not be taken again have no key.
    key = F.when((F.col("size") > 0) & (F.col("whole") < int(CEILING)) & (F.col("rate") > 0), F.col("draw") - (F.col("rate") - F.col("whole")))
    tilted = materialise(tilted.select(ROW, "doc_id", "source", "size", "source_size", "target", "rate", "whole", key.alias("key")), "mix-tilted")

    bucket = F.floor((F.col("key") + 1) * (BUCKETS / 2))
    more = tilted.groupBy("source").agg((F.first("target") - F.sum(F.col("size") * F.col("whole"))).alias("more"))
    more = materialise(more.withColumnRenamed("source", "s"), "mix-more")
    ranges = tilted.where("key is not null").groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("words"))
    running = Window.partitionBy("source").orderBy("bucket")
    ranges = ranges.withColumn("upto", F.sum("words").over(running)).join(more, same_source)
    cuts = ranges.where("upto - words <= more and upto > more").groupBy("s").agg(
        F.min("bucket").alias("cut"), F.min(F.col("more") - (F.col("upto") - F.col("words"))).alias("room")
    )
    cuts = materialise(more.join(cuts.withColumnRenamed("s", "c"), F.col("s").eqNullSafe(F.col("c")), "left").drop("c"), "mix-cuts")

    order = ["key", ROW]
    here = F.struct(*order)
    inside = Window.partitionBy("source").orderBy(*order)
    # Only the rows of one range per source are ordered, and taken while they fit.
    edge = tilted.where("key is not null").join(cuts, same_source).where(bucket == F.col("cut")).withColumn("done", F.sum("size").over(inside)).where("done <= room")
    edge = materialise(edge.groupBy("s").agg(F.max(here).alias("last")), "mix-edge").withColumnRenamed("s", "e")
    ends = materialise(cuts.join(edge, F.col("s").eqNullSafe(F.col("e")), "left").drop("e"), "mix-ends")
    extra = (
        F.when(F.col("key").isNull() | (F.col("more") <= 0), 0)
        .when(F.col("cut").isNull() | (bucket < F.col("cut")), 1)
        .when((bucket == F.col("cut")) & F.col("last").isNotNull() & (here <= F.col("last")), 1)
        .otherwise(0)
    )
    drawn = tilted.join(ends, same_source).withColumn("extra", extra).drop("s", "cut", "room", "last")
    # What is still missing goes to the one document, of those not drawn, whose size is nearest to it.
    missing = materialise(drawn.groupBy("source").agg((F.first("more") - F.sum(F.col("size") * F.col("extra"))).alias("missing")).withColumnRenamed("source", "m"), "mix-missing")
    spare = drawn.where("extra = 0 and key is not null").join(missing, F.col("source").eqNullSafe(F.col("m"))).where("missing > 0")
    nearest = spare.groupBy("m").agg(F.min(F.struct(F.abs(F.col("size") - F.col("missing")).alias("gap"), F.col(ROW).alias("filler"))).alias("f"), F.first("missing").alias("missing"))
    nearest = materialise(nearest.where("f.gap < missing").select(F.col("m").alias("f_source"), "f.filler"), "mix-filler")
    filled = F.when(F.col(ROW) == F.col("filler"), 1).otherwise(F.col("extra"))
    return drawn.join(nearest, F.col("source").eqNullSafe(F.col("f_source")), "left").select(
        ROW, "doc_id", "source", "size", "source_size", "target", "rate", (F.col("whole") + filled).cast("long").alias("copies")
    )


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken, rate."""
    rows = numbered(docs.select("doc_id", "text", "source"))
    return mixed(rows).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "rate")


def repeat_documents(docs: DataFrame) -> DataFrame:
    """The mix as documents: each row of `docs` as often as it is taken, all columns kept."""
    rows = numbered(docs)
    plan = mixed(rows.select(ROW, "doc_id", "text", "source")).where("copies > 0").select(ROW, "copies")
    taken = rows.join(plan.withColumnRenamed(ROW, "__taken").withColumnRenamed("copies", "__copies"), F.col(ROW) == F.col("__taken"))
    return taken.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int")))).select(*docs.columns)

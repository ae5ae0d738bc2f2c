"""Secret scan: base patterns, and a battery of randomness tests over long tokens, in column expressions only.

Base kinds are matched exactly as given. Positions come without per-character work: the lengths of what
lies between the matches (the text split at the pattern) and of the matches themselves add up.

Battery. A candidate is a run of at least `MIN_LENGTH` characters of the base-64 alphabets with a digit
and a letter. Its encoding is the smallest known alphabet that holds it. Three tests ask whether it could
be uniform noise over that alphabet: chi-squared uniformity (Wilson-Hilferty), runs of digits and other
characters (Wald-Wolfowitz), correlation of neighbouring characters. Bonferroni's bound combines them; a
candidate that noise explains with probability below `RANDOM_LEVEL` is no secret.

What remains is held against ordinary text. There, neighbouring characters change class (digit, lower,
upper) at a rate counted over the whole corpus; a token with t changes in its n - 1 steps has at most the
Chernoff probability exp(-(n - 1) KL(t / (n - 1), rate)). That bound is a p-value and falls with length.
Benjamini and Hochberg's rule at `DISCOVERY_RATE`, by band of length over all candidates of the corpus,
decides. The rule needs counts per band and whole unit of -ln p only, a table of bounded size.

Edge cases: null and empty texts have no spans; matches of different base kinds may overlap and all stay;
added spans touch no base span; repeated rows are independent; an empty table gives no rows. Extra columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonegauge.session import materialise

# The base patterns. The key words match letters in either case.
ASSIGN = "((?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]{16,}"  # a run shorter than 20 holds no match inside, so the length may stand here
HEX = "[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex")

MIN_LENGTH = 20
TOKEN = f"[A-Za-z0-9+/_=-]{{{MIN_LENGTH},}}"
CHANGE = "(?:[0-9](?=[A-Za-z])|[A-Za-z](?=[0-9])|[a-z](?=[A-Z]))"
RANDOM_LEVEL, DISCOVERY_RATE = 0.001, 0.01
LEAST_RATE = 0.002
BANDS = (32, 64)  # lengths at which a new band begins
MOST = 700  # -ln p is counted up to here
SPAN = "array<struct<start:int,stop:int,m:string>>"


def spans(text: Column, pattern: str, present: Column) -> Column:
    """Start, stop and string of all matches; nothing is split where `present` is false."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))
    pairs = F.zip_with(F.slice(gaps, 1, F.size(matches)), matches, lambda g, m: F.struct(g.alias("g"), m.alias("m")))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

    def step(s: Column, x: Column) -> Column:
        start = s["at"] + x["g"]
        stop = start + F.length(x["m"])
        return F.struct(stop.alias("at"), F.concat(s["out"], F.array(F.struct(start.alias("start"), stop.alias("stop"), x["m"].alias("m")))).alias("out"))

    return F.when(present, F.aggregate(pairs, zero, step, lambda s: s["out"])).otherwise(F.array().cast(SPAN))


def normal_tail(z: Column) -> Column:
    """Upper tail of the normal distribution by a logistic approximation."""
    return 1.0 / (1.0 + F.exp(1.5976 * z + 0.07056 * z * z * z))


def measured(s: Column) -> Column:
    """Sums over the characters of one token: what the three tests need."""
    token = s["m"]
    n = F.length(token)
    size = (
        F.when(token.rlike("^([0-9a-f]+|[0-9A-F]+)$"), 16.0)
        .when(token.rlike("^[A-Z2-7]+=*$"), 32.0)
        .when(token.rlike("^([0-9a-z]+|[0-9A-Z]+)$"), 36.0)
        .when(token.rlike("^[0-9A-Za-z]+$"), 62.0)
        .otherwise(64.0)
    )
    same = lambda total, c: total + F.pow((n - F.length(F.replace(token, c, F.lit("")))).cast("double"), F.lit(2.0))
    return F.struct(
        s["start"].alias("start"),
        s["stop"].alias("stop"),
        n.cast("double").alias("n"),
        size.alias("size"),
        F.aggregate(F.array_distinct(F.split(token, "")), F.lit(0.0), same).alias("squares"),
        F.length(F.regexp_replace(token, "[^0-9]", "")).cast("double").alias("digits"),
        F.size(F.regexp_extract_all(token, F.lit("[0-9]+|[^0-9]+"), F.lit(0))).cast("double").alias("runs"),
        F.size(F.regexp_extract_all(token, F.lit(CHANGE), F.lit(0))).alias("t"),
        F.transform(F.split(token, ""), lambda c: F.ascii(c).cast("double")).alias("x"),
    )


def summed(s: Column) -> Column:
    """First and second moments of the character codes and their product with the next one, in a ring."""
    ring = F.zip_with(s["x"], F.concat(F.slice(s["x"], 2, F.size(s["x"])), F.slice(s["x"], 1, 1)), lambda a, b: a * b)
    add = lambda total, v: total + v
    kept = [s[c].alias(c) for c in ("start", "stop", "n", "size", "squares", "digits", "runs", "t")]
    return F.struct(
        *kept,
        F.aggregate(s["x"], F.lit(0.0), add).alias("sx"),
        F.aggregate(s["x"], F.lit(0.0), lambda total, v: total + v * v).alias("sxx"),
        F.aggregate(ring, F.lit(0.0), add).alias("lag"),
    )


def deviations(s: Column) -> Column:
    """Normal deviates of uniformity (one side), runs and serial correlation (either side)."""
    n, free = s["n"], s["size"] - 1.0
    chi = F.greatest(s["squares"] * s["size"] / n - n, F.lit(0.0))
    wilson = (F.pow(chi / free, F.lit(1 / 3)) - (1 - 2 / (9 * free))) / F.sqrt(2 / (9 * free))
    mean = 2 * s["digits"] * (n - s["digits"]) / n + 1
    spread = F.sqrt(F.greatest((mean - 1) * (mean - 2) / (n - 1), F.lit(1e-6)))
    below = n * s["sxx"] - s["sx"] * s["sx"]
    serial = F.when(below > 0, F.abs((n * s["lag"] - s["sx"] * s["sx"]) / below) * F.sqrt(n)).otherwise(8.0)
    clip = lambda z: F.greatest(F.least(z, F.lit(8.0)), F.lit(-8.0))
    kept = [s[c].alias(c) for c in ("start", "stop", "t")]
    return F.struct(*kept, clip(wilson).alias("z1"), clip(F.abs(s["runs"] - mean) / spread).alias("z2"), clip(serial).alias("z3"))


def combined(s: Column) -> Column:
    """Probability under uniform noise over the token's encoding, at most (Bonferroni)."""
    least = F.least(normal_tail(s["z1"]), 2 * normal_tail(s["z2"]), 2 * normal_tail(s["z3"]))
    kept = [s[c].alias(c) for c in ("start", "stop", "t")]
    return F.struct(*kept, F.least(F.lit(1.0), 3 * least).alias("p"))


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, base (sorted structs), candidates (with their battery), changes and chars of each text."""
    text = F.col("__text")
    named = text.rlike("(?i)passw|secret|token|api_?key")
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("__text"))
    long_ = text.rlike(f"[A-Za-z0-9+/_=-]{{{MIN_LENGTH}}}")
    rows = rows.select(
        "doc_id",
        spans(text, ASSIGN, named).alias("assign"),
        spans(text, ACCESS, F.contains(text, F.lit("AKIA"))).alias("access"),
        spans(text, HEX, text.rlike("[0-9a-f]{24}")).alias("hex"),
        spans(text, TOKEN, long_).alias("token"),
        F.size(F.regexp_extract_all(text, F.lit(CHANGE), F.lit(0))).cast("long").alias("changes"),
        F.length(text).cast("long").alias("chars"),
    )
    found = lambda name, k, good: F.transform(
        F.filter(F.col(name), good), lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("k"), s["stop"].alias("stop"))
    )
    value = lambda s: F.length(F.regexp_extract(s["m"], ASSIGN, 2)) >= 6
    every = lambda s: F.lit(True)
    base = F.array_sort(F.concat(found("assign", 0, value), found("access", 1, every), found("hex", 2, every)))
    rows = rows.select("doc_id", base.alias("base"), "token", "changes", "chars")
    mixed = lambda s: s["m"].rlike("[0-9]") & s["m"].rlike("[A-Za-z]")
    free = lambda s: ~F.exists("base", lambda b: (b["start"] < s["stop"]) & (s["start"] < b["stop"]))
    tokens = F.filter("token", lambda s: mixed(s) & free(s))
    for step in (measured, summed, deviations, combined):
        tokens = F.transform(tokens, step)
    return rows.select("doc_id", "base", tokens.alias("tokens"), "changes", "chars")


def evidence(t: Column, n: Column, rate: float) -> Column:
    """-ln of the Chernoff bound for t or more changes in n - 1 steps; zero at or below the expected number."""
    share = F.least(t / (n - 1), F.lit(1.0))
    part = lambda a, b: F.when(a > 0, a * F.ln(a / b)).otherwise(0.0)
    return F.when(share > rate, (n - 1) * (part(share, F.lit(rate)) + part(1 - share, F.lit(1 - rate)))).otherwise(0.0)


def secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    rows = materialise(scanned(docs), "secrets")
    seen = rows.agg(F.sum("changes").alias("changes"), F.sum("chars").alias("chars")).first()
    rate = min(0.5, max(LEAST_RATE, (seen["changes"] or 0) / max(seen["chars"] or 0, 1)))
    n = lambda s: (s["stop"] - s["start"]).cast("double")
    band = lambda s: F.when(n(s) < BANDS[0], 0).when(n(s) < BANDS[1], 1).otherwise(2)
    weight = lambda s: F.least(F.floor(evidence(s["t"], n(s), rate)), F.lit(MOST)).cast("int")
    s = F.col("s")
    tokens = rows.select(F.explode("tokens").alias("s")).select(band(s).alias("band"), F.when(s["p"] >= RANDOM_LEVEL, weight(s)).otherwise(-1).alias("w"))
    counts = tokens.groupBy("band", "w").agg(F.count(F.lit(1)).alias("n"))  # 3 bands by MOST + 2 weights at most
    down = Window.partitionBy("band").orderBy(F.desc("w"))
    tested = counts.select("band", "w", F.sum("n").over(down).alias("k"), F.sum("n").over(Window.partitionBy("band")).alias("m"))
    # Largest p with p <= rate * k / m; p of a whole unit is taken at its upper end.
    passed = tested.where(F.col("w") >= 0).where(F.exp(-F.col("w").cast("double")) <= DISCOVERY_RATE * F.col("k") / F.col("m"))
    least = {r["band"]: r["w"] for r in passed.groupBy("band").agg(F.min("w").alias("w")).collect()}
    limit = lambda s: F.when(band(s) == 0, least.get(0, MOST + 1)).when(band(s) == 1, least.get(1, MOST + 1)).otherwise(least.get(2, MOST + 1))
    secret = lambda s: (s["p"] >= RANDOM_LEVEL) & (weight(s) >= limit(s))
    added = F.transform(F.filter("tokens", secret), lambda s: F.struct(s["start"].alias("start"), F.lit(len(KINDS)).alias("k"), s["stop"].alias("stop")))
    names = F.array(*map(F.lit, (*KINDS, "random")))
    written = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["start"].cast("string"), x["stop"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("base", lambda b: b["k"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return rows.select("doc_id", count(0), count(1), count(2), F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.array_sort(F.concat("base", added))).alias("spans"))

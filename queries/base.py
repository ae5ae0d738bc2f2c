"""Registry and the shared views, in Spark and in SQL.

EV  - events as scored headlines (one entity per user, or per event type)
DOC - documents as articles, labelled where a label row exists
PAGE - page titles as feed items
CONV - conversation turns as news payloads
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tonegauge.functions.probabilities import argmax_label
from tonegauge.functions.text import WHITESPACE
from tonegauge.functions.weights import half_life_weight

AS_OF = "2024-01-31"

Build = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    build: Build
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None) -> Callable[[Build], Build]:
    def register(build: Build) -> Build:
        if name in REGISTRY:
            raise ValueError(f"query {name} registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return build(spark, sf_dir)

        REGISTRY[name] = Query(run, sql)
        return build

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c: Column | str, name: str) -> Column:
    """Six digits, without negative zero: sums depend on their order in the last bits."""
    c = F.col(c) if isinstance(c, str) else c
    return (F.bround(c, 6) + F.lit(0.0)).alias(name)


def iso(c: Column | str, name: str = "date") -> Column:
    return F.date_format(c, "yyyy-MM-dd").alias(name)


def rounded(df: DataFrame, *names: str) -> DataFrame:
    """Six digits for the named columns, ISO text for `date`."""
    out = []
    for name in df.columns:
        if name in names:
            out.append(r6(name, name))
        elif name in ("date", "first_date", "last_date"):
            out.append(iso(name, name))
        else:
            out.append(F.col(name))
    return df.select(*out)


def R6(expr: str, name: str) -> str:
    return f"round_even({expr}, 6) + 0.0 AS {name}"


def ISO(expr: str = "date", name: str = "date") -> str:
    return f"strftime({expr}, '%Y-%m-%d') AS {name}"


def STRIP(expr: str) -> str:
    return f"trim({expr}, '{WHITESPACE}')"


# White space inside a regular expression class.
WS_CLASS = (
    r"\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)


def COLLAPSE(expr: str) -> str:
    return f"regexp_replace({expr}, '[{WS_CLASS}]+', ' ', 'g')"


def CLEAN(expr: str, loader: bool = False) -> str:
    suffix = (
        r"\s[-–]\s[A-Z][A-Za-z &]{2,35}$" if loader else r"\s[-–]\s[A-Za-z0-9.&\- ]{2,50}$"
    )
    plain = STRIP(COLLAPSE(f"regexp_replace({expr}, '<[^>]+>', '', 'g')"))
    return f"regexp_replace({plain}, '{suffix}', '')"


# --- EV ---------------------------------------------------------------------------------------


def ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    value = F.col("value")
    s = F.col("sentiment_score")
    return (
        rows.select(
            "event_id",
            F.col("user_id").cast("string").alias("entity"),
            F.to_date("ts").alias("date"),
            F.col("ts").cast("timestamp").alias("ts"),
            F.col("event_type").alias("source"),
            F.concat("event_type", F.lit(" "), "props").alias("headline"),
            (F.get_json_object("props", "$.k").cast("int") % 5).alias("sector"),
            "value",
            F.when(F.col("event_type") == "purchase", value / (value + 25.0))
            .when(F.col("event_type") == "error", -value / (value + 25.0))
            .otherwise(F.lit(0.0))
            .alias("sentiment_score"),
            F.when(F.col("event_type") == "purchase", "positive")
            .when(F.col("event_type") == "error", "negative")
            .otherwise("neutral")
            .alias("predicted_label"),
        )
        .withColumns(
            {
                "prob_positive": F.greatest(s, F.lit(0.0)),
                "prob_negative": F.greatest(-s, F.lit(0.0)),
                "prob_neutral": F.lit(1.0) - F.abs(s),
            }
        )
        .withColumn(
            "model_label",
            argmax_label(F.array("prob_positive", "prob_negative", "prob_neutral")),
        )
    )


def ev_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    weight = half_life_weight(F.col("date"), AS_OF)
    return ev(spark, sf_dir).withColumn("time_weight", weight)


def ev_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev(spark, sf_dir).withColumn("entity", F.col("source"))


EV = """
ev0 AS (
  SELECT event_id, CAST(user_id AS VARCHAR) AS entity, CAST(ts AS DATE) AS date, ts,
         event_type AS source, event_type || ' ' || props AS headline,
         CAST(regexp_extract(props, '[0-9]+') AS INTEGER) % 5 AS sector, value,
         CASE event_type WHEN 'purchase' THEN value / (value + 25)
                         WHEN 'error' THEN -value / (value + 25)
                         ELSE CAST(0 AS DOUBLE) END AS sentiment_score,
         CASE event_type WHEN 'purchase' THEN 'positive' WHEN 'error' THEN 'negative'
                         ELSE 'neutral' END AS predicted_label
  FROM events
),
ev1 AS (
  SELECT *, greatest(sentiment_score, 0.0) AS prob_positive,
         greatest(-sentiment_score, 0.0) AS prob_negative,
         1.0 - abs(sentiment_score) AS prob_neutral
  FROM ev0
),
ev AS (
  SELECT *,
         CASE WHEN prob_positive >= prob_negative AND prob_positive >= prob_neutral THEN 'positive'
              WHEN prob_negative >= prob_neutral THEN 'negative' ELSE 'neutral' END AS model_label,
         pow(CAST(0.5 AS DOUBLE),
             greatest(date_diff('day', date, DATE '2024-01-31'), 0) / 3.0) AS time_weight
  FROM ev1
)"""


def DAILY(value: str = "sentiment_score * time_weight", source: str = "ev", entity: str = "entity"):
    return f"""
daily AS (
  SELECT {entity} AS entity, date, avg({value}) AS d FROM {source} GROUP BY 1, 2
)"""


def ZSCORE(history: int = 3, frame: str = "7 PRECEDING AND 1 PRECEDING", cut: float = 2.0, fill=False):
    z = "(d - m) / nullif(sd, 0)"
    if fill:
        z = f"coalesce({z}, 0)"
    return f"""
hist AS (
  SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY entity) AS n_days FROM daily)
  WHERE n_days >= {history}
),
roll AS (
  SELECT entity, date, d,
         CASE WHEN count(d) OVER w >= 2 THEN avg(d) OVER w END AS m,
         CASE WHEN count(d) OVER w >= 2 THEN stddev_samp(d) OVER w END AS sd
  FROM hist WINDOW w AS (PARTITION BY entity ORDER BY date ROWS BETWEEN {frame})
),
temporal AS (
  SELECT *, {z} AS z, coalesce(abs({z}) > {cut}, FALSE) AS flag FROM roll
)"""


LEGACY_ZSCORE = ZSCORE(0, "6 PRECEDING AND CURRENT ROW", 1.5, fill=True)


def RISK(value="sentiment_score * time_weight", label="predicted_label", source="ev", entity="entity"):
    """CTE `risk`: the current composite score from CTEs `temporal` and the scored rows."""
    return f"""
stats AS (
  SELECT {entity} AS entity, count(*) AS n,
         CAST(count(*) FILTER (WHERE {label} = 'negative') AS DOUBLE) / count(*) AS neg,
         avg({value}) AS a
  FROM {source} GROUP BY 1
),
marks AS (
  SELECT entity, count(*) FILTER (WHERE flag) AS hits, count(*) AS total FROM temporal GROUP BY 1
),
raw AS (
  SELECT s.entity, n, neg, a, coalesce(hits, 0) AS hits,
         least((neg * 40.0 + greatest(0.0, -a) * 35.0
                + CAST(coalesce(hits, 0) AS DOUBLE) / coalesce(total, 1) * 25.0)
               * (0.2 + 0.8 * least(n / 25.0, 1.0)) * CASE WHEN n < 5 THEN 0.5 ELSE 1.0 END,
               100.0) AS score
  FROM stats s LEFT JOIN marks m ON s.entity = m.entity
),
risk AS (
  SELECT entity, n AS total_headlines, round_even(neg * 1000.0, 0) / 1000.0 AS negative_ratio,
         round_even(a, 3) + 0.0 AS avg_sentiment_score, hits AS anomaly_days,
         round_even(score * 100.0, 0) / 100.0 AS composite_risk_score,
         CASE WHEN score >= 60 THEN 'HIGH' WHEN score >= 30 THEN 'MEDIUM' ELSE 'LOW' END
           AS risk_tier
  FROM raw
)"""


LEGACY_RISK = """
stats AS (
  SELECT entity, count(*) AS n,
         CAST(count(*) FILTER (WHERE predicted_label = 'negative') AS DOUBLE) / count(*) AS neg,
         sum(sentiment_score * w) / sum(w) AS a, avg(w) AS mw
  FROM (SELECT *, exp(-date_diff('day', date, DATE '2024-01-31') / CAST(30 AS DOUBLE)) AS w
        FROM live)
  GROUP BY 1
),
marks AS (
  SELECT entity, count(*) FILTER (WHERE flag) AS hits, count(*) AS total FROM temporal GROUP BY 1
),
raw AS (
  SELECT s.entity, n, neg, a, hits,
         (neg * 35.0 + (1.0 - a) / 2.0 * 25.0 + CAST(hits AS DOUBLE) / total * 40.0)
         * (0.7 + 0.3 * mw) AS score
  FROM stats s LEFT JOIN marks m ON s.entity = m.entity
),
risk AS (
  SELECT entity, n AS total_headlines, round_even(neg * 1000.0, 0) / 1000.0 AS negative_ratio,
         round_even(a, 3) + 0.0 AS avg_sentiment_score, hits AS anomaly_days,
         round_even(score * 100.0, 0) / 100.0 AS composite_risk_score,
         CASE WHEN score > 30 THEN 'HIGH' WHEN score > 15 THEN 'MEDIUM' ELSE 'LOW' END AS risk_tier
  FROM raw
)"""

TEMPORAL_OUT = (
    f"{ISO()}, {R6('d', 'daily_avg_sentiment')}, {R6('m', 'rolling_mean')}, "
    f"{R6('sd', 'rolling_std')}, {R6('z', 'z_score')}, entity, flag AS anomaly_flag"
)
TEMPORAL_DOUBLES = ("daily_avg_sentiment", "rolling_mean", "rolling_std", "z_score")


def temporal_out(df: DataFrame) -> DataFrame:
    return rounded(df, *TEMPORAL_DOUBLES)


# --- DOC --------------------------------------------------------------------------------------


def plain_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as articles for queries that need no label."""
    offset = (F.col("n_chars") % 200).cast("int")
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.date_add(F.lit("2023-06-01").cast("date"), offset).alias("date"),
        F.col("lang").alias("entity"),
        F.col("text").alias("headline"),
        "source",
    )


def doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = (
        F.when(F.col("toxic") == 1, "negative")
        .when(F.col("quality") == 1, "positive")
        .when(F.col("quality").isNotNull(), "neutral")
        .otherwise("")
    )
    labels = table(spark, sf_dir, "labels")
    joined = plain_doc(spark, sf_dir).join(labels, "doc_id", "left")
    return joined.withColumn("true_label", label).drop("quality", "toxic")


def labelled_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a label: what is stored before the whole table arrives."""
    return doc(spark, sf_dir).filter(F.col("true_label") != "")


DOC = """
doc AS (
  SELECT d.doc_id, DATE '2023-06-01' + CAST(d.n_chars % 200 AS INTEGER) AS date, d.lang AS entity,
         d.text AS headline,
         CASE WHEN l.toxic = 1 THEN 'negative' WHEN l.quality = 1 THEN 'positive'
              WHEN l.quality IS NOT NULL THEN 'neutral' ELSE '' END AS true_label,
         d.source
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
),
stored AS (SELECT * FROM doc WHERE true_label <> '')"""


# --- PAGE and CONV ----------------------------------------------------------------------------

XML_ILLEGAL = r"[\x00-\x08\x0b\x0c\x0e-\x1f]"


def page(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    title = F.regexp_replace(
        F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1), XML_ILLEGAL, ""
    )
    return pages.select(
        "page_id",
        "url",
        F.regexp_extract("url", r"^https?://([^/]+)", 1).alias("host"),
        F.coalesce(F.nullif(F.regexp_extract("html", r'lang="([a-z]+)"', 1), F.lit("")), F.lit("xx")).alias("entity"),
        title.alias("title"),
        F.make_timestamp_ntz(
            F.lit(2024), F.lit(1), F.lit(31), F.lit(12), F.lit(0), F.lit(0)
        ).cast("timestamp").alias("__end"),
    ).select(
        "page_id",
        "url",
        "host",
        "entity",
        "title",
        (
            F.col("__end")
            - F.make_dt_interval(F.lit(0), (F.col("page_id") * 7 % 240).cast("int"))
        ).alias("published"),
    )


PAGE = r"""
page AS (
  SELECT page_id, url, regexp_extract(url, '^https?://([^/]+)', 1) AS host,
         coalesce(nullif(regexp_extract(html, 'lang="([a-z]+)"', 1), ''), 'xx') AS entity,
         regexp_replace(regexp_extract(html, '(?s)<title>(.*?)</title>', 1),
                        '[\x00-\x08\x0b\x0c\x0e-\x1f]', '', 'g') AS title,
         TIMESTAMP '2024-01-31 12:00:00' - to_hours(CAST(page_id * 7 % 240 AS INTEGER)) AS published
  FROM pages
)"""


def conv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations")

"""Typed headline tables and labelled sentence files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonegauge.functions.text import strip
from tonegauge.operators.cleaning import LABEL_NAMES
from tonegauge.operators.filters import require_columns
from tonegauge.schemas import REQUIRED_HEADLINE_COLUMNS

# Encoding, separators and smallest plausible size of the labelled files.
LABELLED_ENCODING = "ISO-8859-1"
LABELLED_SEPARATORS = (",", ";", "\t")
LABELLED_MIN_ROWS = 100


def scan_headlines(spark: SparkSession, path: str, file_format: str = "parquet") -> DataFrame:
    """Headline table from Parquet or CSV. The columns are checked before any job runs; a missing
    file is reported by name."""
    reader = spark.read
    if file_format == "csv":
        # Names come from the header; types are set below, so nothing is inferred from the data.
        reader = reader.option("header", True).option("multiLine", True).option("escape", '"')
    try:
        df = reader.format(file_format).load(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            raise FileNotFoundError(f"no headline table at {path}") from error
        raise
    require_columns(df, REQUIRED_HEADLINE_COLUMNS)
    if file_format == "csv":
        df = df.withColumn("date", F.try_to_timestamp("date"))
    return df


def parse_labelled_text(spark: SparkSession, path: str) -> DataFrame:
    """Lines `sentence@label`, split at the last @; lines without @ are skipped.

    The CSV reader is used with a separator that never occurs because it decodes the file; the
    text reader always assumes UTF-8.
    """
    lines = (
        spark.read.schema("line STRING")
        .option("sep", "\u0001")
        .option("quote", "")
        .option("encoding", LABELLED_ENCODING)
        .csv(path)
    )
    line = strip(F.col("line"))
    label = F.substring_index(line, "@", -1)
    sentence = F.substr(line, F.lit(1), F.char_length(line) - F.char_length(label) - F.lit(1))
    return lines.filter(F.contains(F.col("line"), F.lit("@"))).select(
        strip(sentence).alias("sentence"), strip(label).alias("label")
    )


def scan_labelled_csv(
    spark: SparkSession,
    path: str,
    separators: Sequence[str] = LABELLED_SEPARATORS,
    min_rows: int = LABELLED_MIN_ROWS,
) -> DataFrame:
    """Headerless `label<sep>sentence` file with an unknown separator.

    One pass counts, per candidate, the lines it can split and those whose first field is then a known
    label spelling. Labels decide, for a sentence may hold the other separators; where no candidate
    yields any, most split lines do; the earlier candidate wins a tie. Fewer than `min_rows` split lines are an error.
    """
    value = F.col("value")
    parts = []
    for i, sep in enumerate(separators):
        splits = F.contains(value, F.lit(sep))
        first = F.lower(strip(F.btrim(F.substring_index(value, sep, 1), F.lit('"'))))
        parts.append(F.count_if(splits).alias(f"split{i}"))
        parts.append(F.count_if(splits & first.isin(*LABEL_NAMES)).alias(f"known{i}"))
    counts = spark.read.text(path).agg(*parts).first()
    best = max(range(len(separators)), key=lambda i: (counts[f"known{i}"], counts[f"split{i}"], -i))
    if counts[f"split{best}"] <= min_rows:
        raise ValueError(f"{path} has no more than {min_rows} lines with a known separator")
    return (
        spark.read.schema("sentiment STRING, sentence STRING")
        .option("sep", separators[best])
        .option("escape", '"')
        .option("encoding", LABELLED_ENCODING)
        .csv(path)
    )

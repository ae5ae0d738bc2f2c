"""Queries of the package: each operator over its whole table, with SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tonegauge.llm.class_bigrams import class_bigram_scores
from tonegauge.llm.common import table
from tonegauge.llm.embeddings import near_duplicates
from tonegauge.llm.fill_middle import DIGESTS_SQL, digests
from tonegauge.llm.mixing import mix
from tonegauge.llm.packing import best_fit_packing
from tonegauge.llm.pii import personal_data
from tonegauge.llm.quality import quality
from tonegauge.llm.ranked_search import RANKED_SQL, ranked_search
from tonegauge.llm.rules import quality_rules
from tonegauge.llm.secret_scan import secrets
from tonegauge.llm.simhash import simhash_near_dedup
from tonegauge.llm.toxicity import toxicity
from tonegauge.llm.warc import derived_records


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(table(spark, sf_dir, "documents"), tokenizer_path())


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(table(spark, sf_dir, "documents"))


def op4_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_near_dedup(table(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived_records(table(spark, sf_dir, "pages"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))


def op8_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))


def op12_class_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_bigram_scores(table(spark, sf_dir, "documents"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_quality": op2_quality,
    "op3_secrets": op3_secrets,
    "op4_rules": op4_rules,
    "op5_simhash": op5_simhash,
    "op6_warc": op6_warc,
    "op7_pii": op7_pii,
    "op8_embeddings": op8_embeddings,
    "op9_toxicity": op9_toxicity,
    "op10_mixing": op10_mixing,
    "op11_fill_middle": op11_fill_middle,
    "op12_class_bigrams": op12_class_bigrams,
    "op13_ranked_search": op13_ranked_search,
}
SQL: dict[str, str] = {"op11_fill_middle": DIGESTS_SQL, "op13_ranked_search": RANKED_SQL}

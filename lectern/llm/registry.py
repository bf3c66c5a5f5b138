"""The queries of this subpackage, over the tables in a folder, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, fill_middle, jaccard_join, language_id, license_scan, lm_scoring, media_columns, mixing, periodic_runs, quality_classifier, quality_rules, secret_scan, simhash
from .common import documents, fold, table

RANKS = "byte_bpe_multi_50k.tiktoken"
NEAR = jaccard_join.Rule(3, 90, 100)


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.query(documents(spark, sf_dir))


def op2_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).withColumn("held_out", fold("doc_id", 7, 0) == 2)
    return lm_scoring.score(docs, ~F.col("held_out"), ["doc_id", "held_out"])


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(documents(spark, sf_dir), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality_rules.judged(docs, quality_rules.fit(docs, table(spark, sf_dir, "labels")), ["doc_id"])


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digests(documents(spark, sf_dir))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).withColumn("held_out", fold("doc_id", 4, 0) == 2)
    content = language_id.dictionaries(docs, ~F.col("held_out"))
    return language_id.identify(docs, content, ["doc_id", "held_out"])


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).withColumn("held_out", fold("doc_id", 5, 1) == 0)
    weights = quality_classifier.fit(docs, table(spark, sf_dir, "labels"), fold("doc_id", 5, 1) != 0)
    scored = quality_classifier.score(docs, weights, ["doc_id", "held_out"])
    return scored.withColumn("predicted", (F.col("score") >= quality_classifier.THRESHOLD).cast("int"))


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns.media_columns(documents(spark, sf_dir))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(documents(spark, sf_dir), ["doc_id"])


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.query(documents(spark, sf_dir), NEAR)


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.query(documents(spark, sf_dir))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digests(documents(spark, sf_dir))


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digests(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_mix_sources, op2_lm_scores, op3_byte_bpe, op4_quality_rules, op5_secret_scan, op6_language_id, op7_quality_classifier, op8_media_columns, op9_license_scan, op10_jaccard_join, op11_simhash, op12_periodic_runs, op13_fill_middle)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of the operators that SQL can express; the others are tested against brute force in tests/llm."""
    return {"op1_mix_sources": mixing.SQL}

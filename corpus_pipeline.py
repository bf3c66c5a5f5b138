"""From raw documents to tokens: quality rules, near-duplicates, secrets, mixing, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next stage's docs. All but the last return the columns of documents.

Defined cases, stage by stage: a null or empty text fails the quality rules; near copies: rows are judged one by one, also
those that share an id or have none, and of rows equal in id and text one stays; a null text has no secret; mix: a null
source is one of its own, and every row is kept; BPE: every row gives one row. Empty tables give empty results at each
stage, and further columns of documents, whatever their names, go along to the last stage, which has its own.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lectern.llm import byte_bpe, jaccard_join, mixing, quality_rules, secret_scan
from lectern.llm.common import documents, stored, table

#: Near-duplicates on word shingles: five words, similarity 0.8 or more.
NEAR = jaccard_join.Rule(5, 80, 100)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the quality rules reject."""
    return quality_rules.keep_documents(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of the smallest id."""
    return jaccard_join.first_of_each(docs, NEAR)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced."""
    return secret_scan.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, written in the order of the mix."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, digests of ids and of decoded bytes, and the ids, of each document, and its slot and
    row_in_block: in this order the rows are the mix, which that of rows in files doesn't promise."""
    placed = mixing.placed(docs.select("doc_id", "source", "text"))
    return byte_bpe.encoded(placed, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, ["slot", "row_in_block"])


STAGES = [("quality rules", keep_quality), ("near copies", drop_near_copies), ("secrets", hide_secrets), ("mix", mix_sources), ("byte-level BPE", encode)]

#: SQL can't express boosted trees or BPE; tests/llm/test_pipeline.py holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)

"""The corpus pipeline: documents through quality rules, exact and near deduplication, mixing and BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from relengine.llm.common import durable, table
from relengine.llm.op2_mix import by_length, mixed
from relengine.llm.op3_exact_dedup import exact_dedup
from relengine.llm.op5_quality_rules import quality_filter, trusted_keys
from relengine.llm.op6_bpe import bpe_round_trip
from relengine.llm.op9_jaccard_join import near_dedup

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules; the corpus statistics are those of docs, the trusted rows those that labels call good."""
    return quality_filter(docs, trusted_keys(table(spark, sf_dir, "labels")))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts the one with the least doc_id."""
    return exact_dedup(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of similarity 0.8 or more on five-word shingles connect, the one with the least doc_id."""
    return near_dedup(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them; short texts are preferred less."""
    return mixed(docs, preference=by_length)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the text decoded from them, for each row of the mix."""
    return bpe_round_trip(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("exact_copies", exact_copies),
    ("near_copies", near_copies),
    ("mixing", mixing),
    ("bpe", bpe),
]

#: Hashed n-grams, near copies and BPE are not expressible in SQL; tests/llm hold run() against a plain version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = durable(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs

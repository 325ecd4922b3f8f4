"""The corpus pipeline: documents that make clean training text, as token ids.

Each stage reads what its predecessor wrote, works on all of it, and its decisions take
effect: rejected documents are gone.  All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lakegrain.llm import bpe_codec, decontaminate, exact_dedup, language_id, near_dedup
from lakegrain.llm.common import staged, table

#: Share of a text's n-grams, corrected for false positives, that its language must know. Clean text has 0.9 and more.
LEAST_SCORE = 0.3
#: Percent of their five-word shingles that near copies share; op3 has a threshold of its own.
NEAR_PERCENT = 80


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without letters and those that no learned language explains."""
    return language_id.keep_known(docs, language_id.fit(docs), LEAST_SCORE)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.drop_near_copies(docs, NEAR_PERCENT)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that hold a window of a benchmark item."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, digests of the ids and of the decoded text, and the ids (little-endian uint32)."""
    return bpe_codec.encode_documents(docs, keep_ids=True).drop("decoded")


STAGES = [
    ("language_id", known_language),
    ("exact_dedup", exact_copies),
    ("near_dedup", near_copies),
    ("decontaminate", benchmark_leaks),
    ("byte_bpe", token_ids),
]

#: Tokenizers cannot be expressed in SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs

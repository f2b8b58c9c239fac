"""A corpus pipeline of five stages over ``documents``, each written as Parquet and read again by the next.

1. language ID: documents without a known language go.
2. SimHash near-dedup: of each group of documents linked by a Jaccard similarity of 0.8 or more of their five-word
   shingles, the one of the smallest id stays.
3. benchmark decontamination: documents that hold a benchmark item go.
4. secret scans: secrets are masked in the texts.
5. BPE encoding and decoding: one row a document, with ids, counts and decoded text.

All stages but the last return the columns of ``documents``. SQL can't express the stages (random vectors, a
transitive closure over fingerprints, a compressor), so ORACLE_SQL is None and tests hold the result against
brute force.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quern.llm import bpe, decontaminate, langid, nearcopies, secrets
from quern.llm.arrow import cut, read_table


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.accepted(docs, langid.prototypes(langid.training(docs)))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return nearcopies.deduplicated(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, read_table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode(docs, bpe.default_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", known_language),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontaminated),
    ("secret_scans", without_secrets),
    ("bpe", tokens),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut(docs)
    return docs

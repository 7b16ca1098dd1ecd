"""From raw documents to encoded training data: five stages, each written as Parquet and reread as the next one's docs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from captionforge.llm import bpe, exact_dedup, mixing, quality_rules, simhash
from captionforge.llm.common import cut, passing, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go, and documents that the rules reject, null and empty texts among them."""
    return quality_rules.keep_quality(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts stays, the one with the largest id."""
    return exact_dedup.keep_exact(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of linked fingerprints stays, the one with the least id."""
    return simhash.keep_near(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them."""
    return mixing.mixed_rows(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, checked against the text decoded from them, as digests."""
    return bpe.digests(docs)


STAGES = [("quality_rules", quality), ("exact_dedup", exact), ("simhash_near_dedup", near), ("source_mixing", mixed), ("bpe", encoded)]

#: Fingerprints (XXH64) and byte-pair merges are beyond SQL; tests/llm/test_pipeline.py holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over the documents of sf_dir.

    A stage's output takes the place of the one before, and what a stage writes for itself goes with it. Rows are told apart by where
    they lie and not by id: repeated rows, null ids and ids that name several texts are treated as every other row.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        with passing(spark) as keep:
            docs = before = keep(cut(stage(spark, docs, sf_dir), instead_of=before))
    return STAGES[-1][1](spark, docs, sf_dir)

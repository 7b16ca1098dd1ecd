"""Exact deduplication by skew-safe combining, in DataFrame operations only.

Three combining steps, each of which compares the full normalised text and not just its digest:

1. every task merges the equal texts that it reads (the partial side of the first aggregation);
2. the rows left are dealt by (digest, salt, text), so that a text with very many copies is merged by up to `salts` tasks;
3. the winners of the salts are combined per (digest, text): at most `salts` rows for any text.

What is kept is named by its row, so keep_exact needs no digest to find it. exact_dedup, which has a row for every document, takes the
verdict back to the documents over SHA-256 and a second fingerprint, 320 bits together: comparing texts there once more would move them
a third time. A text with a third of all rows makes that join skewed on the documents' side only, which adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keyed, lower_ascii, table


def winners(named: DataFrame, salts: int = 16) -> DataFrame:
    """(_sha, _text, _best, _n): of rows (_best, _text) the greatest _best of each text, and how many rows have it."""
    keyed_by = named.withColumn("_sha", F.sha2("_text", 256)).withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
    salted = keyed_by.groupBy("_sha", "_salt", "_text").agg(F.max("_best").alias("_best"), F.count(F.lit(1)).alias("_n"))
    return salted.groupBy("_sha", "_text").agg(F.max("_best").alias("_best"), F.sum("_n").alias("_n"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """One row per row of docs: id, keep_id (largest id of its group), group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z only; null counts as empty, so null and empty texts are one group.
    Null ids lose to any other id; a group of null ids only has keep_id null and keeps them. Repeated rows (same id and
    text) are one document and share the verdict. Columns other than the two named are ignored. No rows in, no rows out.
    """
    named = docs.select(F.col(id_col).alias("_best"), lower_ascii(F.coalesce(F.col(text_col), F.lit(""))).alias("_text"))
    found = winners(named, salts).select("_sha", F.xxhash64("_text").alias("_second"), F.col("_best").alias("keep_id"), F.col("_n").alias("group_size"))
    members = named.select(F.col("_best").alias("_id"), F.sha2("_text", 256).alias("_sha"), F.xxhash64("_text").alias("_second"))
    return members.join(found, ["_sha", "_second"]).select(
        F.col("_id").alias("doc_id"),
        "keep_id",
        "group_size",
        F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("_sha").alias("text_sha256"),
    )


def keep_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """One row of each group of equal texts, with the columns it came with.

    Equality is exact_dedup's: null texts are empty ones. Of a group the row with the largest id stays; null ids lose to any other.
    Rows are told apart by where they are read (common.keyed), so of rows that tie in id, repeated rows and rows of null ids too,
    exactly one stays, and an id that names several texts keeps each text once. Columns of any name pass through; no rows give none.
    """
    rows = keyed(docs)
    best = F.struct(F.col("row")[id_col].alias("id"), "key").alias("_best")
    kept = winners(rows.select(best, lower_ascii(F.coalesce(F.col("row")[text_col], F.lit(""))).alias("_text")), salts).select("_best.key")
    return rows.join(kept, "key", "left_semi").select("row.*")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


SQL = """
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents),
g AS (SELECT x, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY x)
SELECT t.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size, t.doc_id = g.keep_id AS kept, sha256(t.x) AS text_sha256
FROM t JOIN g ON t.x = g.x
"""

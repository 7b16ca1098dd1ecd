"""The subpackage's queries, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, exact_dedup, html_extract, kneser_ney_shards, licenses, lm_scoring, mixing, quality_rules, sharding, simhash


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    return {
        "op1_quality_rules": quality_rules.op1_quality_rules,
        "op2_bpe": bpe.op2_bpe,
        "op3_licenses": licenses.op3_licenses,
        "op4_simhash": simhash.op4_simhash,
        "op5_exact_dedup": exact_dedup.op5_exact_dedup,
        "op6_mixing": mixing.op6_mixing,
        "op7_html_extraction": html_extract.op7_html_extraction,
        "op8_lm_scoring": lm_scoring.op8_lm_scoring,
        "op9_quality_classifier": kneser_ney_shards.op9_quality_classifier,
        "op10_sharding": sharding.op10_sharding,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    out = {"op1_quality_rules": quality_rules.SQL, "op5_exact_dedup": exact_dedup.SQL}
    if corpus_pipeline.ORACLE_SQL:
        out["pipeline"] = corpus_pipeline.ORACLE_SQL
    return out

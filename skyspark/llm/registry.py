"""Queries of the corpus operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from skyspark.llm import bpe, conversations, exact_dedup, language_id, mixing, near_dedup, quality, resampling, sharding, substring_dedup, toxicity, url_filter, vp_ann


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline  # beside the package; the operators don't need it

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "pipeline": pipeline,
        "op1_substring_dedup": substring_dedup.query,
        "op2_url_filter": url_filter.query,
        "op3_language_id": language_id.query,
        "op4_vp_ann": vp_ann.query,
        "op5_mixing": mixing.query,
        "op6_bpe": bpe.query,
        "op7_sharding": sharding.query,
        "op8_toxicity": toxicity.query,
        "op9_exact_dedup": exact_dedup.query,
        "op10_near_dedup": near_dedup.query,
        "op11_quality": quality.query,
        "op12_resampling": resampling.query,
        "op13_conversations": conversations.query,
    }


def oracle_sql() -> dict[str, str]:
    with_sql = {"op2_url_filter": url_filter, "op4_vp_ann": vp_ann, "op5_mixing": mixing, "op7_sharding": sharding, "op9_exact_dedup": exact_dedup, "op10_near_dedup": near_dedup, "op12_resampling": resampling, "op13_conversations": conversations}
    return {name: module.SQL for name, module in with_sql.items()}

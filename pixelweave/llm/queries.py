"""Queries over the driver's tables, one per operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pixelweave.llm.secret_scan import secret_report

    return secret_report(_table(spark, sf_dir, "documents"))


def op2_vector_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pixelweave.llm.vector_neardup import vector_groups

    return vector_groups(_table(spark, sf_dir, "embeddings"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pixelweave.llm.token_counts import token_counts

    return token_counts(_table(spark, sf_dir, "documents"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pixelweave.llm.chat_format import chat_format

    return chat_format(_table(spark, sf_dir, "conversations"))


def op5_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pixelweave.llm.suffix_dedup import remove_repeats

    return remove_repeats(_table(spark, sf_dir, "documents"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pixelweave.llm.packing import pack

    return pack(_table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pixelweave.llm.mixing import mixture

    return mixture(_table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pixelweave.llm.quality import quality_verdicts

    return quality_verdicts(_table(spark, sf_dir, "documents"))


def op9_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pixelweave.llm.simhash import simhash_groups

    return simhash_groups(_table(spark, sf_dir, "documents"))


def op10_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pixelweave.llm.lm_score import lm_scores

    return lm_scores(_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_secret_scan, op2_vector_groups, op3_token_counts, op4_chat_format, op5_repeated_strings, op6_best_fit_packing, op7_mixing, op8_quality_rules, op9_simhash_groups, op10_lm_scores, pipeline)}


def oracle_sql() -> dict[str, str]:
    from pixelweave.llm import chat_format

    return {"op4_chat_format": chat_format.ORACLE_SQL}

"""Queries of the operators over whole tables, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import documents, tokenizer_path


def op1_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .shards import shard_report

    return shard_report(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"))


def op2_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_report

    return mix_report(documents(spark, sf_dir))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secret_scan import secret_report

    return secret_report(documents(spark, sf_dir))


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substrings import substring_report

    return substring_report(documents(spark, sf_dir))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"))


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .media import media_report

    return media_report(documents(spark, sf_dir))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import simhash_report

    return simhash_report(documents(spark, sf_dir))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import language_report

    return language_report(documents(spark, sf_dir))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality_report

    return quality_report(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import top_k

    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), lambda v: v % 50 == 0)


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .negatives import hard_negatives, shifted

    return hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), lambda v: v % 100 == 0, shifted(F.col("vec_id"), F.col("label")))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .whitening import whiten

    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_online_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .online_packing import pack_online

    return pack_online(documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op")}


def oracle_sql() -> dict[str, str]:
    from .mixing import MIX_SQL
    from .negatives import NEGATIVES_SQL
    from .topk import TOP_K_SQL

    return {"op2_mix": MIX_SQL, "op10_topk": TOP_K_SQL, "op11_negatives": NEGATIVES_SQL}

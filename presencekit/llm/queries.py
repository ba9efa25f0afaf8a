"""Driver queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import katz, linedup, minhash, mixing, packing, quality, rules, sql, substrings, topk, toxicity


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix_report(spark, _table(spark, sf, "documents"))


def op2_substrings(spark: SparkSession, sf: str) -> DataFrame:
    return substrings.dedup_substrings(spark, _table(spark, sf, "documents"))


def op3_lines(spark: SparkSession, sf: str) -> DataFrame:
    return linedup.dedup_lines(spark, _table(spark, sf, "documents"))


def op4_quality(spark: SparkSession, sf: str) -> DataFrame:
    return quality.quality_report(spark, _table(spark, sf, "documents"), _table(spark, sf, "labels"))


def op5_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(spark, _table(spark, sf, "documents"))


def op6_topk(spark: SparkSession, sf: str) -> DataFrame:
    return topk.top_k(spark, _table(spark, sf, "embeddings"))


def op7_minhash(spark: SparkSession, sf: str) -> DataFrame:
    return minhash.near_duplicates(spark, _table(spark, sf, "documents"), shingle=4)


def op8_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity.toxicity(spark, _table(spark, sf, "documents"), _table(spark, sf, "labels"))


def op9_katz(spark: SparkSession, sf: str) -> DataFrame:
    return katz.katz_scores(spark, _table(spark, sf, "documents"))


def op10_rules(spark: SparkSession, sf: str) -> DataFrame:
    return rules.rules_report(_table(spark, sf, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_mixing, op2_substrings, op3_lines, op4_quality, op5_packing, op6_topk, op7_minhash, op8_toxicity, op9_katz, op10_rules)}


def oracle_sql() -> dict[str, str]:
    return {"op1_mixing": sql.MIXING, "op6_topk": sql.TOPK, "op7_minhash": sql.MINHASH, "op10_rules": sql.rules(rules.BOILERPLATE, rules.MAX_LOST)}

"""Registered queries of the corpus operators, and SQL where it can state the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symloom.llm import (
    exact, langid, lm_score, mixing, negatives, pieces, pii, quality, sharding, simhash, spelling, suffixes, warc,
)
from symloom.llm.common import documents

Query = Callable[[SparkSession, str], DataFrame]


def op1_sharding(spark: SparkSession, sf: str) -> DataFrame:
    return sharding.minimax_shards(documents(spark, sf))


def op2_pseudonyms(spark: SparkSession, sf: str) -> DataFrame:
    return pii.pseudonymized(documents(spark, sf))


def op3_simhash(spark: SparkSession, sf: str) -> DataFrame:
    return simhash.simhash_components(documents(spark, sf))


def op4_host_rules(spark: SparkSession, sf: str) -> DataFrame:
    return quality.host_rules(documents(spark, sf))


def op5_lm_score(spark: SparkSession, sf: str) -> DataFrame:
    return lm_score.cross_entropy_difference(documents(spark, sf), spark.read.parquet(f"{sf}/labels.parquet"))


def op6_repeated_passages(spark: SparkSession, sf: str) -> DataFrame:
    return suffixes.remove_repeats(documents(spark, sf)).drop("spans")


def op7_mixing(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(documents(spark, sf)).select("doc_id", "size", "source_size", "target", "taken")


def op8_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return pieces.encode_documents(documents(spark, sf)).withColumn("n_pieces", F.size("ids").cast("long"))


def op9_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return exact.exact_dedup(documents(spark, sf)).drop("row_no")


def op10_language_id(spark: SparkSession, sf: str) -> DataFrame:
    return langid.language_id(documents(spark, sf))


def op11_warc(spark: SparkSession, sf: str) -> DataFrame:
    return warc.archived_pages(spark.read.parquet(f"{sf}/pages.parquet")).drop("target_uri")


def op12_spelling(spark: SparkSession, sf: str) -> DataFrame:
    return spelling.variants(documents(spark, sf))


def op13_hard_negatives(spark: SparkSession, sf: str) -> DataFrame:
    return negatives.hard_negatives(spark.read.parquet(f"{sf}/embeddings.parquet"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    op1_sharding, op2_pseudonyms, op3_simhash, op4_host_rules, op5_lm_score, op6_repeated_passages, op7_mixing, op8_pieces, op9_exact_dedup, op10_language_id,
    op11_warc, op12_spelling, op13_hard_negatives)}
ORACLES: dict[str, str] = {"op4_host_rules": quality.ORACLE, "op7_mixing": mixing.ORACLE, "op9_exact_dedup": exact.ORACLE,
                           "op11_warc": warc.ORACLE, "op13_hard_negatives": negatives.ORACLE}

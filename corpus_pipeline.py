"""A training corpus from ``documents``: language, exact and near copies, mixture, pieces.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run``
writes as Parquet to the shared folder and reads back as the next one's docs. All stages but
the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from symloom.llm import exact, langid, mixing, pieces, shingles
from symloom.llm.common import written


def _columns(docs: DataFrame) -> list[str]:
    return [c for c in ("doc_id", "text", "lang", "source", "n_chars") if c in docs.columns]


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known: those without letters, or too close between two languages to tell, go."""
    model = langid.train(langid.learned_rows(docs))
    return langid.known_language(docs, model).select(*_columns(docs))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest id."""
    return exact.kept_rows(docs).select(*_columns(docs))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every component of documents whose five-word shingles have a Jaccard similarity of 0.8 or more, that with the smallest id.

    SimHash and its Golay keys propose near copies, which are verified on the
    shingles; the prefixes of the shingle sets find those that it does not see.
    """
    return shingles.similar_heads(docs).select(*_columns(docs))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mixture takes it."""
    return mixing.repeated_rows(docs).select(*_columns(docs))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document, with the scores of its best segmentations."""
    return pieces.encode_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identified), ("exact_dedup", without_copies), ("near_dedup", without_near_copies),
    ("mixing", mixed), ("pieces", encoded)]

# Language models, fingerprints and segmentations cannot be stated in SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over the whole table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs

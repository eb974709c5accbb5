"""Helpers shared by the corpus operators: written tables, word rules, Arrow settings."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from symloom.session import new_folder

# A word is a run of bytes other than space and the five ASCII control blanks.
WORD = "[^\\x20\\x09-\\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the folder all executors share.

    Later steps read it back, so they neither recompute it nor depend on an
    executor that may be gone, and row numbers taken from places stay fixed.
    """
    folder = new_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(col, UPPER, LOWER)


def word_count(col: Column) -> Column:
    return F.regexp_count(F.coalesce(col, F.lit("")), F.lit(WORD)).cast("long")


def arrow_batches(spark: SparkSession, records: int = 4000, megabytes: int = 8) -> None:
    """Bound the Arrow batches by bytes too, since single texts can be very long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(records))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(megabytes << 20))


@contextlib.contextmanager
def arrow_limits(spark: SparkSession, records: int, megabytes: int) -> Iterator[None]:
    """Bound the Arrow batches of what is written inside; the session's own bounds hold again afterwards."""
    names = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")
    before = [spark.conf.get(n) for n in names]
    arrow_batches(spark, records, megabytes)
    try:
        yield
    finally:
        for name, value in zip(names, before, strict=True):
            spark.conf.set(name, value)


def checked_broadcast(df: DataFrame, row_bytes: int, limit_bytes: int = 64 << 20) -> DataFrame:
    """``df`` with a broadcast hint if its counted rows fit the limit, else as it is for a shuffle join."""
    return F.broadcast(df) if df.count() * row_bytes <= limit_bytes else df


def fresh(df: DataFrame, name: str) -> str:
    """``name``, made longer until no column of ``df`` is called so, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name

"""Writers. Each writes in parallel from where the rows are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_splits(df: DataFrame, path: str, split: Column, spread: int = 0) -> None:
    """Partitioned by split. ``spread`` > 0 fixes the number of files per split,
    so that one dominant split is still written by many tasks."""
    rows = df.withColumn("split", split)
    if spread:
        salt = F.pmod(F.xxhash64(*df.columns), F.lit(spread))
        rows = rows.repartition("split", salt)
    rows.write.mode("overwrite").partitionBy("split").parquet(path)


def write_payloads(df: DataFrame, path: str, key: str = "identifier", spread: int = 4) -> None:
    """One folder of JSON per identifier, in at most ``spread`` files each."""
    salt = F.pmod(F.xxhash64(*df.columns), F.lit(spread))
    df.repartition(key, salt).write.mode("overwrite").partitionBy(key).json(path)


def log_decisions(df: DataFrame, path: str, kind: str, basis: str) -> None:
    """Append (name, status) rows with time and basis."""
    (df.select("name", "status", F.lit(basis).alias("basis"), F.current_timestamp().alias("decided_at"), F.lit(kind).alias("kind"))
     .write.mode("append").partitionBy("kind").json(path))

"""Running values over long groups.

A plain window sends a whole group to one task. These split every group into
blocks of its order column, scan the blocks in parallel, and add what earlier
blocks contribute, so a group may be larger than one task can hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from symloom.session import cut_lineage

BLOCK = 65536


def _blocks(df: DataFrame, order: str, block: Column | None) -> DataFrame:
    return df.withColumn("_block", F.floor(F.col(order) / BLOCK) if block is None else block)


def running_sum(df: DataFrame, keys: list[str], order: str, value: Column, out: str,
                block: Column | None = None) -> DataFrame:
    """Inclusive running sum of ``value``; ``order`` must be unique per group."""
    rows = _blocks(df, order, block).withColumn("_v", value)
    inside = Window.partitionBy(*keys, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (rows.groupBy(*keys, "_block").agg(F.sum("_v").alias("_t"))
               .select(*keys, "_block", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_before")))
    return (rows.withColumn(out, F.sum("_v").over(inside))
            .join(offsets, [*keys, "_block"])
            .withColumn(out, F.col(out) + F.col("_before")).drop("_block", "_v", "_before"))


def carry_last(df: DataFrame, keys: list[str], order: str, value: Column, out: str,
               block: Column | None = None) -> DataFrame:
    """Last non-null ``value`` on the rows strictly before each row."""
    rows = _blocks(df, order, block).withColumn("_v", value)
    inside = Window.partitionBy(*keys, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    last = (rows.groupBy(*keys, "_block")
            .agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.col(order))).alias("_t"))
            .select(*keys, "_block", F.last("_t", ignorenulls=True).over(before).alias("_before")))
    return (rows.withColumn(out, F.last("_v", ignorenulls=True).over(inside))
            .join(last, [*keys, "_block"])
            .withColumn(out, F.coalesce(out, "_before")).drop("_block", "_v", "_before"))


def last_n(df: DataFrame, keys: list[str], order: list[Column], n: int, spread: Column,
           salts: int = 32) -> DataFrame:
    """The first ``n`` rows per group by ``order``: salted partial top-n, then the final one."""
    rows = df.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)))
    part = Window.partitionBy(*keys, "_salt").orderBy(*order)
    whole = Window.partitionBy(*keys).orderBy(*order)
    return (rows.withColumn("rn", F.row_number().over(part)).where(F.col("rn") <= n)
            .withColumn("rn", F.row_number().over(whole)).where(F.col("rn") <= n).drop("_salt"))


def dense_index(df: DataFrame, order: list[Column], out: str) -> DataFrame:
    """Number all rows 0, 1, 2, … in order without bringing them into one task.

    Rows are range-partitioned and sorted, written once so that their place is
    fixed, and numbered within their partition; only one count per partition
    goes through a window.
    """
    placed = cut_lineage(df.repartitionByRange(*order).sortWithinPartitions(*order)
                         .withColumn("_p", F.spark_partition_id())
                         .withColumn("_i", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (placed.groupBy("_p").agg(F.count("*").alias("_n"))
               .select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o")))
    return placed.join(offsets, "_p").withColumn(out, F.col("_i") + F.col("_o")).drop("_p", "_i", "_o")

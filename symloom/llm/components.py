"""Connected components of a link table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symloom.llm.common import written


def _star(links: DataFrame, name: str) -> DataFrame:
    """One large-star step on (a, b), a > b, then one small-star step; the result is again (a, b) with a > b.

    Large: every node hands its larger neighbours to the smallest node it
    touches. Small: it hands its smaller neighbours, and itself, to that node.
    Minima are taken with partial sums per task and written, so that a node
    with any number of links meets them in a plain join whose large partitions
    Spark may split.
    """
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = written(both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("low")), f"{name}-low")
    large = (both.where("b > a").join(low, F.col("a") == F.col("node"))
             .select(F.col("b").alias("a"), F.col("low").alias("b")).where("a > b").distinct())
    large = written(large, f"{name}-large")
    low = written(large.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), "low"), f"{name}-small-low")
    small = large.join(low, F.col("a") == F.col("node"))
    small = (small.select(F.col("b").alias("a"), F.col("low").alias("b")).where("a > b")
             .unionByName(low.select(F.col("node").alias("a"), F.col("low").alias("b"))).distinct())
    return written(small, f"{name}-small")


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) for every node of (a, b) links; the root is the smallest node of its component.

    Rounds go on until a round changes nothing, about the logarithm of the
    longest path; each is written to the shared folder. A component of any size
    is spread over all tasks. No links: no rows.
    """
    links = written(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-links")
    seen = None
    while True:
        # Stars are done when no larger node is itself a smaller one and every one has one smaller.
        state = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state == seen or not state["n"]:
            break
        seen = state
        links = _star(links, name)
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())

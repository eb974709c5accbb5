"""Minimax contiguous sharding of ordered atomic groups."""

from __future__ import annotations

import bisect
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from symloom.llm.common import written

SHARDS = 24
EDGES = 16384


@dataclass
class Cuts:
    """``alone``: groups that have a shard of their own; ``last``: the last group of every further shard but the final one."""

    alone: list[str]
    last: list[str]
    capacity: int


def prefix_sums(groups: DataFrame) -> DataFrame:
    """(key, bytes) to (key, end): bytes up to and with the group, in key order over all tasks."""
    placed = written(groups.repartitionByRange("key").sortWithinPartitions("key")
                     .withColumn("part", F.spark_partition_id()), "shard-groups")
    within = Window.partitionBy("part").orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (placed.groupBy("part").agg(F.sum("bytes").alias("here"))
               .select("part", F.coalesce(F.sum("here").over(before), F.lit(0)).alias("offset")))
    ends = placed.withColumn("end", F.sum("bytes").over(within)).join(F.broadcast(offsets), "part")
    return written(ends.select("key", (F.col("end") + F.col("offset")).alias("end"), "bytes"), "shard-ends")


class _Known:
    """Group ends seen so far: one per bin of ``width`` bytes inside the searched spans, with the ends per bin."""

    def __init__(self, total: int, width: int, bins: list[tuple[int, int]], older: list[int]):
        self.total, self.width = total, width
        self.many = {end for end, n in bins if n > 1}
        self.ends = sorted({0, total, *older, *(end for end, _ in bins)})

    def below(self, x: int) -> int:
        """A group end at or below x, the largest known."""
        return self.ends[bisect.bisect_right(self.ends, x) - 1]

    def above(self, x: int) -> int:
        """No group end at or below x is larger than this."""
        i = bisect.bisect_right(self.ends, x)
        if i < len(self.ends) and self.ends[i] in self.many and self.ends[i] // self.width == x // self.width:
            return x
        return self.ends[i - 1]

    def chain(self, capacity: int, shards: int, step) -> list[int]:
        """Where each of the shards ends when they are filled one after the other up to ``capacity``."""
        out, at = [], 0
        for _ in range(shards):
            at = self.total if at + capacity >= self.total else step(at + capacity)
            out.append(at)
        return out


def _smallest(low: int, high: int, fits) -> int:
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if fits(middle) else (middle + 1, high)
    return low


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def search_cuts(ends: DataFrame, total: int, largest: int, shards: int, edges: int = EDGES) -> tuple[list[int], int]:
    """Smallest capacity for which greedy filling needs at most ``shards`` shards, and the ends it cuts at.

    The driver asks for about ``edges`` group ends at a time, the last one in
    each bin of so many bytes. Greedy filling over known ends never reaches
    beyond the true one, and filling up to bin contents not yet known never
    falls short of it, so binary searches with both enclose the capacity, and
    the fillings at its bounds enclose every cut. The next round looks into
    these spans only, with narrower bins, until both bounds meet. Spans shrink
    by a large factor per round, so a few rounds do for any number of groups.
    """
    low, high = max(largest, -(-total // shards)), total
    spans, older, width = [(0, total)], [], 2 * total
    while True:
        width = max(1, min(width // 2, sum(b - a for a, b in spans) // edges))
        inside = F.lit(False)
        for a, b in spans:
            inside = inside | F.col("end").between(a, b)
        bins = (ends.where(inside).groupBy(F.floor(F.col("end") / F.lit(width)).alias("bin"))
                .agg(F.max("end").alias("end"), F.count("*").alias("n")).select("end", "n").collect())
        known = _Known(total, width, [(r["end"], r["n"]) for r in bins], older)
        high = _smallest(low, high, lambda c: known.chain(c, shards, known.below)[-1] >= total)
        low = _smallest(low, high, lambda c: known.chain(c, shards, known.above)[-1] >= total)
        if low == high:
            return known.chain(high, shards, known.below)[:-1], high
        first, last = known.chain(low, shards, known.below), known.chain(high, shards, known.above)
        spans, older = _merged(list(zip(first, last))[:-1]), first


def minimax_cuts(groups: DataFrame, shards: int, edges: int = EDGES) -> Cuts:
    """Cuts for (key, bytes), one row per group, into at most ``shards`` shards.

    Groups larger than an even share of what is left stand alone; there are
    fewer than ``shards`` of these. The others follow in key order and are cut
    at the smallest capacity that greedy filling can keep to.
    """
    top = groups.orderBy(F.col("bytes").desc(), "key").limit(shards).collect()
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    alone, left = [], total
    for row in top:
        if len(alone) < shards - 1 and row["bytes"] * (shards - len(alone)) > left:
            alone.append(row["key"])
            left -= row["bytes"]
    rest = groups.where(~F.col("key").isin(alone)) if alone else groups
    largest = next((r["bytes"] for r in top if r["key"] not in alone), 0)
    if left == 0 or shards - len(alone) == 1:
        return Cuts(alone, [], left)
    ends = prefix_sums(rest)
    cuts, capacity = search_cuts(ends, left, largest, shards - len(alone), edges)
    keys = {r["end"]: r["key"] for r in ends.where(F.col("end").isin(cuts)).collect()}
    return Cuts(alone, [keys[c] for c in cuts if c < left], capacity)


def shard_of(key: Column, cuts: Cuts) -> Column:
    """The shard of a group, by comparing its key with the cuts (fewer than the shards)."""
    place = F.lit(len(cuts.alone))
    for last in cuts.last:
        place = place + (key > F.lit(last)).cast("int")
    for i, own in enumerate(cuts.alone):
        place = F.when(key == own, F.lit(i)).otherwise(place)
    return place.cast("int")


def minimax_shards(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text",
                   edges: int = EDGES) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard, group_key.

    Groups are rows of equal text; a group is never split. Sizes are UTF-8
    bytes plus 8. Groups stand in the order of their SHA-256, so a shard holds
    a random part of every source and is found by comparing with the cuts,
    without a join. Slots number the rows of a shard in (group, id) order.

    Null text: a group of its own, of size 8 per row, CRC of no bytes. Rows
    that repeat id and text get a slot each. Fewer groups than shards: the
    last shards stay empty. Empty table: empty result. Other columns, whatever
    their names, are not looked at.
    """
    text = F.col(text_col)
    slim = written(docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.coalesce(F.sha2(text, 256), F.lit("null")).alias("key")), "shard-docs")
    groups = written(slim.groupBy("key").agg(F.sum("size").alias("bytes")), "shard-sizes")
    cuts = minimax_cuts(groups, shards, edges)
    placed = written(slim.withColumn("shard", shard_of(F.col("key"), cuts))
                     .repartitionByRange("shard", "key", "doc_id").sortWithinPartitions("shard", "key", "doc_id")
                     .withColumn("part", F.spark_partition_id())
                     .withColumn("place", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "shard-order")
    # A shard's rows in one task are consecutive: places, the first place per task and shard, and the rows in earlier tasks.
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (placed.groupBy("shard", "part").agg(F.min("place").alias("first"), F.count("*").alias("n"))
               .select("shard", "part", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")))
    return placed.join(F.broadcast(offsets), ["shard", "part"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("place") - F.col("first") + F.col("offset")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), F.col("key").alias("group_key"))

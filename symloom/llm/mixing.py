"""Mixing sources to target weights by Sainte-Laguë apportionment, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from symloom.functions.scan import dense_index
from symloom.llm.common import checked_broadcast, fresh, word_count, written

WEIGHTS = (5, 2, 1)
LIMIT = 3
SHARDS = 24
SEATS = 1024
SEED = "7"
# Sources whose targets lie within this factor of each other share blocks of one size, at least so many turns of all shards a source.
SPAN = 4
TURNS = 4
# How often a target fits below the largest one, in powers of SPAN: exact in doubles, so SQL tells the same.
DEAL = " + ".join(f"CAST(target * {SPAN ** k}e0 <= top AS INT)" for k in range(1, 27))


def source_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """Add ``weight`` and ``target`` to (source, source_size).

    Weights repeat along the sources in code-point order, null last. A source
    stops at ``limit`` times its size; what it would have had beyond goes to
    the others by weight, again and again. That fixpoint is the level L at
    which the sum of least(limit * size, L * weight) equals the total: with
    sources sorted by where they stop, prefix sums give it directly.
    """
    spec = Window.orderBy(F.col("source").isNull(), F.col("source"))
    nth = F.pmod(F.row_number().over(spec) - 1, F.lit(len(weights)))
    ranked = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (nth + 1).cast("int")).cast("long"))
    stop = F.col("source_size") / F.col("weight")
    order = Window.orderBy(stop, F.col("source").isNull(), F.col("source"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = ((F.sum("source_size").over(everything) - F.coalesce(F.sum(F.col("source_size") * limit).over(before), F.lit(0)))
             / F.sum("weight").over(after))
    # The first source that does not stop tells the level; behind it, sources are counted as stopped that are not.
    steps = ranked.withColumn("level", level).withColumn("place", F.row_number().over(order))
    goes_on = F.col("level") * F.col("weight") <= F.col("source_size") * limit
    steps = steps.withColumn("level", F.min(F.when(goes_on, F.struct("place", "level"))).over(everything)["level"])
    target = F.least((F.col("source_size") * limit).cast("double"), F.col("level") * F.col("weight"))
    return steps.withColumn("target", F.coalesce(target, F.lit(0.0))).drop("level", "place")


def deals(sources: DataFrame, shards: int = SHARDS, seats: int = SEATS) -> DataFrame:
    """Add ``deal``, ``n_blocks`` and ``block`` to (source, target): which sources are dealt blocks together, how many and how large.

    With blocks of one size for all, a source below half a block would get
    nothing. So sources are parted by size: those whose targets are within a
    factor of ``SPAN``. Every deal has at least ``seats`` blocks a shard, and at least
    ``TURNS`` a shard for each of its sources, so its smallest source is worth
    ``shards * TURNS / SPAN`` blocks or more, whatever the corpus. Without a target: no deal.
    """
    top = Window.partitionBy()
    spec = Window.partitionBy("deal")
    by_size = spec.orderBy("target", F.col("source").isNull(), F.col("source")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return (sources.withColumn("top", F.max("target").over(top))
            .withColumn("deal", F.when(F.col("target") > 0, F.expr(DEAL))).drop("top")
            .withColumn("n_blocks", F.greatest(F.lit(seats), F.count("*").over(spec) * TURNS).cast("long") * shards)
            .withColumn("block", F.round(F.sum("target").over(by_size), 3) / F.col("n_blocks")))


def apportion(sources: DataFrame, shards: int = SHARDS, seats: int = SEATS) -> DataFrame:
    """Deal the ``n_blocks`` equal blocks of every deal to (source, target, deal, n_blocks) by highest quotients.

    Without the column ``deal``, all sources share ``shards * seats`` blocks.

    Every source has the quotients target / 1, target / 3, target / 5, … and the
    highest ones of its deal get a block each; ties go to the earlier source. The n-th
    quotient goes to shard n mod ``shards``, so every shard has integer quotas
    close to the weights. Returns (source, pick, shard): the source's blocks
    numbered from 0. No source can gain more than half a block per rival over
    its proportional share, which bounds the quotients to look at by the
    number of blocks plus twice the number of sources. They are numbered by
    range partition, not in one task.
    """
    if "deal" not in sources.columns:
        sources = sources.withColumns({"deal": F.lit(0), "n_blocks": F.lit(shards * seats).cast("long")})
    together = Window.partitionBy("deal")
    share = F.col("target") * F.col("n_blocks") / F.sum("target").over(together)
    reach = F.ceil(share * (1 + F.count("*").over(together) / (2.0 * F.col("n_blocks"))) + 0.5).cast("long")
    quotients = (sources.where("target > 0").withColumn("reach", reach)
                 .select("deal", "n_blocks", "source", "target", F.explode(F.sequence(F.lit(0).cast("long"), F.col("reach"))).alias("pick"))
                 .withColumn("quotient", F.col("target") / (2 * F.col("pick") + 1)))
    order = [F.col("deal"), F.col("quotient").desc(), F.col("source").isNull(), F.col("source"), F.col("pick")]
    ranked = dense_index(quotients, order, "rank")
    # There are at most 27 deals.
    first = F.broadcast(ranked.groupBy(F.col("deal").alias("_deal")).agg(F.min("rank").alias("first")))
    place = F.col("rank") - F.col("first")
    return (ranked.join(first, F.col("deal") == F.col("_deal")).where(place < F.col("n_blocks"))
            .select("source", "pick", F.pmod(place, F.lit(shards)).cast("int").alias("shard")))


def stream_positions(rows: DataFrame, seed: str = SEED) -> DataFrame:
    """Add ``start``: the words of the same source that stand before the row in the seeded order.

    Rows are sorted by (source, hash of seed and id) over all tasks and written
    once; sums per task and source, a small table, give each task its offset.
    A source of any share of the rows is spread over as many tasks as it needs.
    """
    order = [F.col("source").isNull(), F.col("source"), F.md5(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string"))),
             F.col("doc_id"), F.col("row_no")]
    placed = written(rows.withColumn("turn", order[2])
                     .repartitionByRange(order[0], order[1], F.col("turn"), order[3], order[4])
                     .sortWithinPartitions(order[0], order[1], F.col("turn"), order[3], order[4])
                     .withColumn("part", F.spark_partition_id())
                     .withColumn("place", F.monotonically_increasing_id()).drop("turn"), "mix-order")
    within = Window.partitionBy("part", "source").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (placed.groupBy("source", "part").agg(F.sum("size").alias("here"))
               .withColumn("offset", F.coalesce(F.sum("here").over(before), F.lit(0))).drop("here"))
    offsets = offsets.select(F.col("source").alias("_source"), F.col("part").alias("_part"), "offset")
    return (placed.withColumn("start", F.coalesce(F.sum("size").over(within), F.lit(0)))
            .join(offsets, (F.col("part") == F.col("_part")) & F.col("source").eqNullSafe(F.col("_source")))
            .withColumn("start", F.col("start") + F.col("offset"))
            .drop("part", "place", "_source", "_part", "offset"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT, shards: int = SHARDS,
        seats: int = SEATS, seed: str = SEED, size: Column | None = None) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken, repeats, shard, row_no.

    ``docs`` has doc_id, text and source. The mix has as many words as all
    documents. Sources of about one size are dealt blocks of equal words
    together (``deals``), which they win by highest quotients (``apportion``), so
    a source of any size gets within half a small block of its target. A source's documents
    stand in an order set by ``seed``; its blocks are read from that stream,
    from its start again when it ends. ``repeats`` counts how often the stream
    passes a document; one that a last block cuts is taken if more than half of
    it lies inside. ``shard`` is where the document's first block belongs.

    Null text: size 0, taken 0. Null source: a source of its own, last in
    order. Rows that repeat an id are separate documents. No documents, or no
    words at all: nothing is taken. Columns besides the three are not looked at.
    """
    text_size = word_count(F.col("text")) if size is None else size
    slim = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
                               text_size.alias("size"))
                   .withColumn("row_no", F.monotonically_increasing_id()), "mix-sizes")
    totals = slim.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = written(deals(source_targets(totals, weights, limit), shards, seats), "mix-sources")
    won = written(apportion(sources, shards), "mix-blocks")
    quota = won.groupBy("source").agg(F.count("*").alias("blocks"))
    words = F.least(F.round(F.coalesce("blocks", F.lit(0)) * F.col("block")).cast("long"), F.col("source_size") * limit)
    plan = (sources.join(quota.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")), "left")
            .withColumn("words", words)
            .select("source", "source_size", "target", "block",
                    F.when(F.col("source_size") > 0, F.expr("words div source_size")).otherwise(0).alias("passes"),
                    F.when(F.col("source_size") > 0, F.expr("words % source_size")).otherwise(0).alias("rest")))
    plan = written(plan, "mix-plan").select(F.col("source").alias("_source"), "source_size", "target", "block", "passes", "rest")
    rows = (stream_positions(slim, seed)
            .join(plan, F.col("source").eqNullSafe(F.col("_source"))).drop("_source"))
    inside = (F.col("size") > 0) & (2 * F.col("start") + F.col("size") < 2 * F.col("rest"))
    repeats = F.when(F.col("size") > 0, F.col("passes") + inside.cast("long")).otherwise(0)
    rows = rows.withColumn("repeats", repeats).withColumn(
        "pick", F.when(F.col("repeats") > 0, F.floor(F.col("start") / F.col("block"))))
    seat = won.select(F.col("source").alias("_source"), F.col("pick").alias("_pick"), "shard")
    out = rows.join(seat, F.col("source").eqNullSafe(F.col("_source")) & (F.col("pick") == F.col("_pick")), "left")
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("repeats")).alias("taken"),
                      "repeats", "shard", "row_no")


def repeated_rows(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, whole, each as often as the mix takes it.

    Rows that repeat an id share its repeats: each is taken as often as the
    id's rows are on average, rounded up. The repeats, two numbers per
    document, are sent out while they are few, else both sides are shuffled once.
    """
    mixed = mix(docs).groupBy("doc_id").agg(F.ceil(F.sum("repeats") / F.count("*")).cast("int").alias("repeats"))
    key, times, turn = fresh(docs, "_id"), fresh(docs, "_times"), fresh(docs, "_turn")
    plan = written(mixed.where("repeats > 0").select(F.col("doc_id").alias(key), F.col("repeats").alias(times)), "mix-repeats")
    rows = docs.join(checked_broadcast(plan, 96), F.col("doc_id").cast("long").eqNullSafe(F.col(key)))
    return rows.withColumn(turn, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*docs.columns)


ORACLE = f"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN {WEIGHTS[0]} WHEN 1 THEN {WEIGHTS[1]} ELSE {WEIGHTS[2]} END AS weight FROM s),
l AS (SELECT *, row_number() OVER o AS place, (CAST((SELECT sum(source_size) FROM w) - coalesce(sum(source_size * {LIMIT}) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
      / CAST(sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE)) AS level
      FROM w WINDOW o AS (ORDER BY CAST(source_size AS DOUBLE) / weight, source IS NULL, source)),
t AS (SELECT source, source_size, coalesce(least(CAST(source_size * {LIMIT} AS DOUBLE),
      (SELECT arg_min(level, place) FROM l WHERE level * weight <= source_size * {LIMIT}) * weight), 0.0) AS target FROM l),
k AS (SELECT *, CASE WHEN target > 0 THEN {DEAL} END AS deal FROM (SELECT *, max(target) OVER () AS top FROM t)),
c AS (SELECT deal, CAST(greatest({SEATS}, {TURNS} * count(*)) * {SHARDS} AS BIGINT) AS n_blocks, count(*) AS n, round(sum(target), 3) AS mass FROM k WHERE target > 0 GROUP BY deal),
q AS (SELECT deal, n_blocks, source, target, unnest(range(0, CAST(ceil(target * n_blocks / mass * (1 + n / (2.0 * n_blocks)) + 0.5) AS BIGINT) + 1)) AS pick FROM k JOIN c USING (deal)),
b AS (SELECT source, count(*) AS blocks FROM (SELECT *, row_number() OVER (PARTITION BY deal ORDER BY target / (2 * pick + 1) DESC, source IS NULL, source, pick) AS place FROM q)
      WHERE place <= n_blocks GROUP BY source),
p AS (SELECT k.source, k.source_size, k.target, least(CAST(round(coalesce(b.blocks * (c.mass / c.n_blocks), 0)) AS BIGINT), k.source_size * {LIMIT}) AS words
      FROM k LEFT JOIN b ON k.source IS NOT DISTINCT FROM b.source LEFT JOIN c ON k.deal = c.deal),
r AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY md5('{SEED}:' || doc_id), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM d)
SELECT r.doc_id, r.size, p.source_size, p.target,
       CASE WHEN r.size > 0 THEN CAST(r.size * (p.words // p.source_size + CASE WHEN 2 * r.start + r.size < 2 * (p.words % p.source_size) THEN 1 ELSE 0 END) AS BIGINT) ELSE 0 END AS taken
FROM r JOIN p ON r.source IS NOT DISTINCT FROM p.source
"""

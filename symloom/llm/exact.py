"""Exact de-duplication with a heavy-hitter split, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from symloom.llm.common import ascii_lower, checked_broadcast, fresh, written

TRACKED = 4096
CANDIDATES = 512


def digest(text: Column) -> Column:
    """SHA-256 of the text with A-Z lower-cased; a null text counts as empty."""
    return F.sha2(ascii_lower(F.coalesce(text, F.lit(""))), 256)


def frequent_digests(rows: DataFrame, column: str, candidates: int = CANDIDATES, tracked: int = TRACKED) -> list[str]:
    """At most ``candidates`` values that may be frequent, from a Misra-Gries summary.

    Spark's ``approx_top_k`` keeps ``tracked`` counters per task and merges
    them (the frequent-items sketch is the Misra-Gries scheme with batched
    decrements), so the summary has a fixed size whatever the data.
    """
    found = rows.agg(F.expr(f"approx_top_k({column}, {candidates}, {tracked})").alias("top")).first()
    return [x["item"] for x in found["top"] or [] if x["item"] is not None and x["count"] > 1]


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                candidates: int = CANDIDATES, tracked: int = TRACKED) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256, and ``row_no``.

    Texts are equal when their digests are. Of a group the row with the largest
    id stays. Frequent digests come from a Misra-Gries summary; their exact
    counts and winners are taken in a second pass with map-side partial
    aggregates, and only those that really repeat are broadcast (``candidates``
    rows at most), which settles their rows without moving them. All other
    digests go through one ordinary shuffle; none of them can be frequent.

    Null text: as empty text. Null id: below every other id. Rows that repeat
    the same id and text: one of them stays. Empty table: empty result. Other
    columns of ``docs``, whatever their names, are not looked at.
    """
    slim = written(docs.select(F.col(id_col).cast("long").alias("doc_id"), digest(F.col(text_col)).alias("text_sha256"))
                   .withColumn("row_no", F.monotonically_increasing_id()), "exact-digests")
    spark = docs.sparkSession
    schema = "text_sha256 string"
    suspects = spark.createDataFrame([(x,) for x in frequent_digests(slim, "text_sha256", candidates, tracked)], schema)
    # An id of null sorts first in a struct, so it wins only when alone.
    winners = (slim.join(F.broadcast(suspects), "text_sha256")
               .groupBy("text_sha256")
               .agg(F.max(F.struct("doc_id", "row_no")).alias("win"), F.count("*").alias("group_size"))
               .where("group_size > 1"))
    winners = written(winners, "exact-winners")
    heavy = slim.join(F.broadcast(winners), "text_sha256")
    group = Window.partitionBy("text_sha256")
    rest = (slim.join(F.broadcast(winners.select("text_sha256")), "text_sha256", "left_anti")
            .withColumn("win", F.max(F.struct("doc_id", "row_no")).over(group))
            .withColumn("group_size", F.count("*").over(group)))
    out = heavy.unionByName(rest.select(heavy.columns))
    return out.select("doc_id", F.col("win.doc_id").alias("keep_id"), "group_size",
                      (F.col("row_no") == F.col("win.row_no")).alias("kept"), "text_sha256", "row_no")


def kept_rows(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, whole.

    Only dropped rows are joined back, by id and digest: far fewer than those
    that stay. They are sent out while they are few, else both sides are
    shuffled once. Rows that repeat id and digest cannot be told apart by such
    a join, so where there are any, one row of each is taken.
    """
    judged = written(exact_dedup(docs), "exact-judged")
    own, key, sha, stays = (fresh(docs, n) for n in ("_own", "_id", "_sha", "_stays"))
    pairs = (judged.groupBy("doc_id", "text_sha256").agg(F.max("kept").alias(stays), F.count("*").alias("n"))
             .where(f"NOT {stays} OR n > 1").select(F.col("doc_id").alias(key), F.col("text_sha256").alias(sha), stays))
    pairs = written(pairs, "exact-drops")
    rows = docs.withColumn(own, digest(F.col("text")))
    same = [F.col("doc_id").cast("long").eqNullSafe(F.col(key)), F.col(own) == F.col(sha)]
    joined = rows.join(checked_broadcast(pairs, 192), same, "left")
    out = joined.where(F.col(stays).isNull())
    if not pairs.where(stays).isEmpty():
        out = out.unionByName(joined.where(stays).dropDuplicates(["doc_id", own]))
    return out.select(*docs.columns)


ORACLE = """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id DESC) = 1 AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""

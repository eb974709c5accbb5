"""Hard negatives by vertical scans of columnar blocks.

Rows are packed into blocks that hold their vectors dimension by dimension. An
anchor reads a block's dimensions in the order of its own largest magnitudes,
adds them to the partial products of the rows still in question, and drops
every row whose product, with the least and the most that the remaining
dimensions can add, can neither enter the anchor's best rows nor fall into one
of its windows. What remains after the last dimension is exact.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from symloom.llm.common import arrow_limits, written

SCALE = 256
LABELS = 10
EVERY = 50  # ids of anchors are divisible by this
NOISE = 7  # ids of rows whose label moves on
POSITIVES, NEGATIVES = 5, 3
LOW, HIGH = 50, 95  # per cent of the positive's score
ROWS = 2048  # rows of a block
ANCHORS = 512  # anchors of a block
SLAB = 32 << 20  # bytes of anchor blocks that are sent out at once
STEP = 8  # dimensions read between two cuts
EXACT = 1 << 53  # below this, sums of doubles are exact integers

BLOCK = pa.schema([("block", pa.binary())])
FOUND = pa.schema([("anchor_row", pa.int64()), ("anchor_id", pa.int64()), ("positive_row", pa.int64()), ("positive_id", pa.int64()),
                   ("positive_score", pa.int64()), ("row_no", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
FOUND_DDL = ("anchor_row long, anchor_id long, positive_row long, positive_id long, positive_score long, row_no long, vec_id long, "
             "score long")


# Blocks

def pack(rows: int, keep_windows: bool):
    """Rows (row_no, vec_id, label, comps[, windows]) to blocks of at most ``rows``, sorted by label, one dimension after the other."""
    def packed(part: list[tuple]) -> pa.RecordBatch:
        part = sorted(part, key=lambda r: (str(r[2]), r[0]))
        width = max(len(r[3]) for r in part)
        # A shorter vector has nothing in its missing dimensions.
        table = np.zeros((width, len(part)), dtype=np.int64)
        for i, r in enumerate(part):
            table[:len(r[3]), i] = r[3]
        most = max(abs(int(table.min(initial=0))), abs(int(table.max(initial=0))))
        small = next((t for t in (np.int8, np.int16, np.int32) if most <= np.iinfo(t).max), np.int64)
        block = {"rows": np.array([r[0] for r in part], dtype=np.int64), "ids": np.array([r[1] for r in part], dtype=np.int64),
                 "labels": [r[2] for r in part], "table": table.astype(small)}
        if keep_windows:
            block["windows"] = [[tuple(w.values()) for w in r[4]] for r in part]
        return pa.RecordBatch.from_arrays([pa.array([pickle.dumps(block, protocol=5)], pa.binary())], schema=BLOCK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                part.append(row)
                if len(part) == rows:
                    yield packed(part)
                    part = []
        if part:
            yield packed(part)

    return run


# Scans

def _bounds(q: np.ndarray, order: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[list, list]:
    """The least and the most that the dimensions behind each step can add, for any row of the block."""
    ends = np.stack([q * low, q * high])[:, order]
    least, most = ends.min(axis=0), ends.max(axis=0)
    behind = range(STEP, len(q) + STEP, STEP)
    return [least[b:].sum() for b in behind], [most[b:].sum() for b in behind]


def _largest(values: np.ndarray, k: int):
    """The k-th largest value."""
    return np.sort(values)[-k] if values.dtype == object else np.partition(values, len(values) - k)[len(values) - k]


def best_rows(q: np.ndarray, block: "Columns", alive: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``alive`` that may be among the k best by (score, smaller id), with exact scores; at least all ties of the k-th."""
    order = np.argsort(-np.abs(q), kind="stable")
    partial = np.zeros(len(alive), dtype=q.dtype)
    least, most = _bounds(q, order, block.low, block.high)
    for step, at in enumerate(range(0, len(q), STEP)):
        dims = order[at:at + STEP]
        partial = partial + q[dims] @ block.table[dims[:, None], alive]
        if len(alive) > k:
            # Whoever cannot reach what the k-th best has for certain is out.
            stays = partial + most[step] >= _largest(partial, k) + least[step]
            alive, partial = alive[stays], partial[stays]
    return alive, partial


def window_rows(q: np.ndarray, block: "Columns", alive: np.ndarray, windows: list[tuple[int, int]], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``alive`` that may be among the k best of any window (low, high), ends included, with exact scores."""
    order = np.argsort(-np.abs(q), kind="stable")
    partial = np.zeros(len(alive), dtype=q.dtype)
    least, most = _bounds(q, order, block.low, block.high)
    for step, at in enumerate(range(0, len(q), STEP)):
        dims = order[at:at + STEP]
        partial = partial + q[dims] @ block.table[dims[:, None], alive]
        surely, possibly = partial + least[step], partial + most[step]
        stays = np.zeros(len(alive), dtype=bool)
        for low, high in windows:
            inside = surely[(surely >= low) & (possibly <= high)]
            floor = max(low, _largest(inside, k)) if len(inside) >= k else low
            stays |= (possibly >= floor) & (surely <= high)
        alive, partial = alive[stays], partial[stays]
        if not len(alive):
            break
    return alive, partial


class Columns:
    """A block ready for scans: doubles while every sum is an exact integer in them, else unbounded integers."""

    def __init__(self, block: dict, width: int, largest: int):
        table = block["table"]
        most = max(abs(int(table.min(initial=0))), abs(int(table.max(initial=0))))
        self.dtype = np.float64 if most * largest * width < EXACT else object
        self.table = np.zeros((width, table.shape[1]), dtype=self.dtype)
        self.table[:len(table)] = table.astype(np.int64).astype(self.dtype) if self.dtype != object else table.astype(object)
        self.low, self.high = self.table.min(axis=1), self.table.max(axis=1)
        self.rows, self.ids = block["rows"], block["ids"]
        labels = np.array([str(x) for x in block["labels"]])
        self.slices = {x: np.flatnonzero(labels == x) for x in set(labels.tolist())}

    def same(self, label) -> np.ndarray:
        return self.slices.get(str(label), np.empty(0, dtype=np.int64))

    def other(self, label) -> np.ndarray:
        if str(label) not in self.slices:
            return np.arange(len(self.rows))
        keep = np.ones(len(self.rows), dtype=bool)
        keep[self.slices[str(label)]] = False
        return np.flatnonzero(keep)


def _long(value) -> int:
    """A score as a long; beyond its range, the end of the range."""
    return max(-(1 << 63), min((1 << 63) - 1, int(value)))


def _top(rows: np.ndarray, scores: np.ndarray, block: Columns, k: int) -> list[tuple[int, int, int]]:
    ranked = sorted(zip((-s for s in scores.tolist()), block.ids[rows].tolist(), block.rows[rows].tolist(), strict=True))[:k]
    return [(row, vec, _long(-s)) for s, vec, row in ranked]


def _scan(k: int, negatives: bool):
    """Every (rows block, anchor block) of the input to the rows that may be among an anchor's k best, or its windows' k best."""
    def hits(block: Columns, anchors: dict, i: int) -> Iterator[tuple]:
        label, me, vec = anchors["labels"][i], int(anchors["rows"][i]), int(anchors["ids"][i])
        q = np.zeros(len(block.table), dtype=block.dtype)
        column = anchors["table"][:, i]
        q[:len(column)] = column.astype(np.int64) if block.dtype != object else column.astype(object)
        if not negatives:
            same = block.same(label)
            rows, scores = best_rows(q, block, same[block.rows[same] != me], k)
            for row, found, score in _top(rows, scores, block, k):
                yield me, vec, None, None, None, row, found, score
            return
        windows = [(-(-LOW * s // 100), HIGH * s // 100, row, pid, s) for row, pid, s in anchors["windows"][i]]
        windows = [w for w in windows if w[0] <= w[1]]
        rows, scores = window_rows(q, block, block.other(label), [w[:2] for w in windows], k)
        for low, high, prow, pid, s in windows:
            inside = (scores >= low) & (scores <= high)
            for row, found, score in _top(rows[inside], scores[inside], block, k):
                yield me, vec, prow, pid, s, row, found, score

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, other in zip(batch.column(0), batch.column(1), strict=True):
                raw, anchors = pickle.loads(data.as_py()), pickle.loads(other.as_py())
                largest = max(abs(int(anchors["table"].min(initial=0))), abs(int(anchors["table"].max(initial=0))))
                block = Columns(raw, max(len(raw["table"]), len(anchors["table"])), largest)
                out = [h for i in range(len(anchors["ids"])) for h in hits(block, anchors, i)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), FOUND, strict=True)], schema=FOUND)

    return run


def scanned(blocks: DataFrame, anchors: DataFrame, k: int, negatives: bool, slab: int = SLAB) -> DataFrame:
    """All blocks of rows against all blocks of anchors.

    Anchors are a stated query set: they go to the rows in slabs of at most
    ``slab`` bytes, counted before they are sent out, one pass over the rows
    for each slab. Rows never move.
    """
    sizes = anchors.agg(F.sum(F.octet_length("block")).alias("total"), F.max(F.octet_length("block")).alias("most")).first()
    slabs = 1 if not sizes.total or sizes.total <= slab else -(-2 * sizes.total // slab)
    dealt = anchors.withColumnRenamed("block", "anchors")
    out = None
    for n in range(slabs):
        part = dealt if slabs == 1 else dealt.where(F.pmod(F.xxhash64("anchors"), F.lit(slabs)) == n)
        met = blocks.crossJoin(F.broadcast(part)).mapInArrow(_scan(k, negatives), FOUND_DDL)
        out = met if out is None else out.unionByName(met)
    return out


def usable(vectors: DataFrame, id_col: str = "vec_id", label_col: str = "label", vec_col: str = "embedding",
           labels: int = LABELS, noise: int = NOISE, scale: int = SCALE) -> DataFrame:
    """row_no, vec_id, label, comps of the rows that take part."""
    whole = F.forall(F.col(vec_col), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    label = F.when(F.col(id_col) % noise == 0, (F.col(label_col) + 1) % labels).otherwise(F.col(label_col))
    return (vectors.where(F.col(label_col).isNotNull() & F.col(vec_col).isNotNull() & F.coalesce(whole, F.lit(False)))
            .select(F.col(id_col).cast("long").alias("vec_id"), label.alias("label"),
                    F.transform(F.col(vec_col), lambda x: F.floor(x.cast("double") * scale)).alias("comps"))
            .withColumn("row_no", F.monotonically_increasing_id()))


def hard_negatives(vectors: DataFrame, id_col: str = "vec_id", label_col: str = "label", vec_col: str = "embedding",
                   every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES,
                   rows: int = ROWS, anchors: int = ANCHORS, slab: int = SLAB) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Blocks are written once and scanned twice: for the anchors' best rows of
    the same label, then for the best rows of other labels inside the window of
    each positive. Per task only the best of each anchor and window leave it
    (Spark limits ranked groups before the shuffle), so no group is gathered.

    Null label, null vector, null or non-finite component: the row takes no
    part. Null id: no anchor, and behind equal scores first. An empty or
    shorter vector: zeros where it has nothing. Rows that repeat an id are
    rows of their own, also as anchors; ties beyond the id go by row. Scores
    beyond a long: its end. No anchor or no row: empty result. Other columns
    are not looked at.
    """
    slim = written(usable(vectors, id_col, label_col, vec_col), "bond-rows").select("row_no", "vec_id", "label", "comps")
    slim = slim.withColumn("vec_id", F.coalesce("vec_id", F.lit(-(1 << 63))))
    chosen = slim.where((F.col("vec_id") % every == 0) & (F.col("vec_id") != -(1 << 63)))
    with arrow_limits(vectors.sparkSession, rows, 8):
        blocks = written(slim.mapInArrow(pack(rows, False), "block binary"), "bond-blocks")
        queries = written(chosen.mapInArrow(pack(anchors, False), "block binary"), "bond-anchors")
    best = Window.partitionBy("anchor_row").orderBy(F.col("score").desc(), "vec_id", "row_no")
    with arrow_limits(vectors.sparkSession, 1, 8):
        found = written(scanned(blocks, queries, positives, False, slab).withColumn("rank", F.row_number().over(best))
                        .where(F.col("rank") <= positives), "bond-positives")
    windows = found.groupBy("anchor_row").agg(F.sort_array(F.collect_list(F.struct("row_no", "vec_id", "score"))).alias("windows"))
    with arrow_limits(vectors.sparkSession, anchors, 8):
        asked = chosen.join(windows, F.col("row_no") == F.col("anchor_row")).select("row_no", "vec_id", "label", "comps", "windows")
        asked = written(asked.mapInArrow(pack(anchors, True), "block binary"), "bond-windows")
    best = Window.partitionBy("anchor_row", "positive_row").orderBy(F.col("score").desc(), "vec_id", "row_no")
    with arrow_limits(vectors.sparkSession, 1, 8):
        out = written(scanned(blocks, asked, negatives, True, slab).withColumn("rank", F.row_number().over(best))
                      .where(F.col("rank") <= negatives), "bond-negatives")
    def plain(c: str):
        return F.when(F.col(c) != -(1 << 63), F.col(c))

    return out.select("anchor_id", plain("positive_id").alias("positive_id"), "rank", plain("vec_id").alias("negative_id"),
                      "positive_score", F.col("score").alias("negative_score"))


ORACLE = f"""
WITH e AS (SELECT vec_id, CASE WHEN vec_id % {NOISE} = 0 THEN (label + 1) % {LABELS} ELSE label END AS label,
  list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM e a, e b WHERE a.vec_id % {EVERY} = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {POSITIVES})
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same AND {LOW} * positive_score <= 100 * score AND 100 * score <= {HIGH} * positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) <= {NEGATIVES}
"""

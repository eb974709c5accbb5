"""An index of clusters for finding those that are far from a name.

A cluster is far from a name if their similarity is at most ``CUTOFF``. For
names of under ``LONG`` letters that means that no letter of the one stands
within reach of its place in the other, so the similarity is 0 and the
distance depends on the lengths and the last two letters only. The index keeps
for each letter the places it has in each cluster's name as bits; a target's
letters give windows of bits, and one AND per letter tells for many clusters
at once whether they are far. Clusters are looked at level by level from the
greatest possible distance down, in index order inside a level, until no level
left can reach the k-th best.

Targets travel in blocks of rows and clusters in slabs, so every pair that
Spark makes is one of a block and a slab.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symloom.functions.similarity import jaro_winkler_value

CUTOFF = 0.2
MIN_LENGTH_GAP = 2
PREFIX = 3
LONG = 40  # from this length on, names with a matching letter can be far
ROWS = 64  # letters with a row of their own; the last row is shared by all others
SLAB = 4096  # clusters of a slab
BLOCK = 1024  # targets of a block, about
SENT = 64 << 20  # bytes of slabs that may be sent to all tasks

FAR = pa.schema([("kind", pa.string()), ("target", pa.string()), ("cluster_id", pa.int64()), ("distance", pa.float64())])
SEAT = pa.schema([("kind", pa.string()), ("target", pa.string()), ("wrapped", pa.int32()), ("cluster_id", pa.int64())])


class FarIndex:
    """Clusters (cluster_id, rep_norm, rep_tokens) in index order."""

    def __init__(self, items: list[dict]):
        items = sorted(items, key=lambda c: c["cluster_id"])
        self.ids = [c["cluster_id"] for c in items]
        self.reps = [c["rep_norm"] for c in items]
        self.tokens = [frozenset(c["rep_tokens"]) for c in items]
        self.length = np.array([len(r) for r in self.reps], dtype=np.int64)
        common = Counter(ch for r in self.reps for ch in set(r)).most_common(ROWS - 1)
        self.row = {ch: i for i, (ch, _) in enumerate(common)}
        self.bits = np.zeros((ROWS, len(items)), dtype=np.uint64)
        suffixes: dict[str, list[int]] = {}
        for at, rep in enumerate(self.reps):
            suffixes.setdefault(rep[-2:], []).append(at)
            if len(rep) < LONG:
                places: dict[int, int] = {}
                for i, ch in enumerate(rep):
                    r = self.row.get(ch, ROWS - 1)
                    places[r] = places.get(r, 0) | 1 << i
                for r, bits in places.items():
                    self.bits[r, at] = bits
        self.suffixes = {s: np.array(p) for s, p in suffixes.items()}
        self.levels: dict[int, dict[int, np.ndarray]] = {}

    def by_gap(self, m: int) -> dict[int, np.ndarray]:
        """Clusters with a name by their length's gap to ``m``, 8 and more as one; too small gaps left out."""
        if m not in self.levels:
            gap = np.minimum(np.abs(self.length - m), 8)
            self.levels[m] = {g: np.flatnonzero((gap == g) & (self.length > 0)) for g in range(MIN_LENGTH_GAP, 9)}
        return self.levels[m]

    def windows(self, norm: str, reach: int) -> dict[int, int]:
        """Row of each letter to the places within reach of it."""
        out: dict[int, int] = {}
        if reach >= 0:
            for i, ch in enumerate(norm):
                low = max(0, i - reach)
                r = self.row.get(ch, ROWS - 1)
                out[r] = out.get(r, 0) | ((1 << (i + reach - low + 1)) - 1) << low
        return out

    def scores(self, norm: str, at: np.ndarray) -> np.ndarray:
        """Similarity of the clusters ``at`` to a name where it is at most ``CUTOFF`` and no cheap test fails, else nan."""
        m, length = len(norm), self.length[at]
        out = np.full(len(at), np.nan)
        empty = length == 0
        open_ = ~empty & (np.abs(length - m) >= MIN_LENGTH_GAP)
        out[empty | (open_ & (m == 0))] = 0.0
        check = open_ & (m > 0) & ((length >= LONG) | (m >= LONG))
        if 0 < m < LONG:
            reach = np.maximum(length, m) // 2 - 1
            for r in np.unique(reach[open_ & (length < LONG)]).tolist():
                some = np.flatnonzero(open_ & (length < LONG) & (reach == r))
                surely, maybe = np.zeros(len(some), dtype=bool), np.zeros(len(some), dtype=bool)
                for row, window in self.windows(norm, r).items():
                    hit = (self.bits[row, at[some]] & np.uint64(window & (1 << LONG) - 1)) != 0
                    if row == ROWS - 1:
                        maybe |= hit
                    else:
                        surely |= hit
                out[some[~surely & ~maybe]] = 0.0
                check[some[~surely & maybe]] = True
        for i in np.flatnonzero(check).tolist():
            rep = self.reps[at[i]]
            if norm[:PREFIX] != rep[:PREFIX]:
                score = jaro_winkler_value(norm, rep)
                out[i] = score if score <= CUTOFF else np.nan
        return out

    def hits(self, norm: str, tokens: frozenset, at: np.ndarray) -> Iterator[tuple[int, float]]:
        """(place, similarity) of the far clusters among ``at``, in that order; looked at in growing pieces."""
        start, piece = 0, 64
        while start < len(at):
            part = at[start:start + piece]
            found = self.scores(norm, part)
            for i in np.flatnonzero(~np.isnan(found)).tolist():
                if not tokens & self.tokens[part[i]]:
                    yield int(part[i]), float(found[i])
            start, piece = start + piece, piece * 2

    def farthest(self, norm: str, tokens: frozenset, k: int) -> list[tuple[float, int]]:
        """(distance, cluster_id) of the ``k`` farthest clusters, ties to the earlier."""
        by_gap = self.by_gap(len(norm))
        ending = self.suffixes.get(norm[-2:], np.empty(0, dtype=np.int64)) if norm else np.empty(0, dtype=np.int64)
        levels = []
        for g, at in by_gap.items():
            levels.append((self._distance(0.0, g, 1), np.intersect1d(at, ending, assume_unique=True), g, 1))
            plain = np.setdiff1d(at, ending, assume_unique=True)
            if g == 8:
                plain = np.union1d(plain, np.flatnonzero(self.length == 0))
            levels.append((self._distance(0.0, g, 0), plain, g, 0))
        best: list[tuple[float, int]] = []
        for most, at, g, ends in sorted(levels, key=lambda x: -x[0]):
            if len(best) >= k and -best[k - 1][0] > most:
                break
            exact = 0
            for place, score in self.hits(norm, tokens, at):
                best.append((-self._distance(score, g, ends), self.ids[place]))
                exact += score == 0.0
                if exact == k and len(norm) < LONG and not (self.length[at] >= LONG).any():
                    break
            best = sorted(best)[:k]
        return [(-d, c) for d, c in best]

    @staticmethod
    def _distance(score: float, gap: int, ends: int) -> float:
        return 0.50 * (1.0 - score) + 0.25 * 1.0 + 0.15 * (gap / 8.0) + 0.05 * 0.0 + 0.05 * float(ends)


class Seats:
    """Free members of a slab's clusters in one casing: how many stand before each cluster, and whether a prefix leaves any."""

    def __init__(self, index: FarIndex, seats: list[dict], base: int):
        place = {c: i for i, c in enumerate(index.ids)}
        rows = sorted((place[s["cluster_id"]], s["n"], s["low"], s["high"]) for s in seats if s["cluster_id"] in place)
        self.at = np.array([r[0] for r in rows], dtype=np.int64)
        self.upto = base + np.cumsum(np.array([r[1] for r in rows], dtype=np.int64))
        self.prefixes = [(r[2], r[3]) for r in rows]

    def first(self, index: FarIndex, target: dict) -> tuple[int, int] | None:
        """(wrapped, cluster_id) of the first far cluster with a fitting member, from the target's number on and then from the start."""
        norm, tokens, pre = target["norm"], frozenset(target["tset"]), target["pre"]
        start = int(np.searchsorted(self.upto, target["number"], side="right"))
        for wrapped, part in ((0, slice(start, None)), (1, slice(0, start))):
            fits = np.array([p != (pre, pre) for p in self.prefixes[part]], dtype=bool)
            for place, _ in index.hits(norm, tokens, self.at[part][fits]):
                return wrapped, index.ids[place]
        return None


def slabs(clusters: DataFrame) -> DataFrame:
    """(kind, slab, items) of clusters with (kind, cluster_id, rep_norm, rep_tokens): at most ``SLAB`` clusters a row."""
    return (clusters.withColumn("slab", F.floor(F.col("cluster_id") / SLAB))
            .groupBy("kind", "slab").agg(F.collect_list(F.struct("cluster_id", "rep_norm", "rep_tokens")).alias("items")))


def target_blocks(targets: DataFrame, columns: list[str], kind: str = "kind") -> DataFrame:
    """(kind, targets): the targets of a kind, about ``BLOCK`` to a row."""
    n = max(1, -(-targets.count() // BLOCK))
    return (targets.groupBy(F.col(kind).alias("kind"), F.pmod(F.xxhash64("target"), F.lit(n)).alias("_block"))
            .agg(F.collect_list(F.struct(*columns)).alias("targets")).drop("_block"))


def met(blocks: DataFrame, slab_rows: DataFrame) -> DataFrame:
    """Every block with every slab of its kind; slabs are sent out while their counted size is bounded, else both are shuffled."""
    size = slab_rows.agg(F.sum(F.expr("aggregate(items, 0L, (s, c) -> s + 64 + octet_length(c.rep_norm))"))).first()[0] or 0
    return blocks.join(F.broadcast(slab_rows) if size <= SENT else slab_rows, "kind")


def farthest(blocks: DataFrame, slab_rows: DataFrame, k: int) -> DataFrame:
    """(kind, target, cluster_id, distance): of every slab, the ``k`` farthest clusters of each target."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[tuple, FarIndex] = {}
        for batch in batches:
            for kind, targets, slab, items in zip(*(c for c in batch.columns), strict=True):
                index = _kept(kept, kind.as_py(), slab.as_py(), items)
                out = [(kind.as_py(), t["target"], c, d) for t in targets.as_py()
                       for d, c in index.farthest(t["norm"], frozenset(t["tset"]), k)]
                yield _batch(out, FAR)

    return met(blocks, slab_rows).select("kind", "targets", "slab", "items").mapInArrow(
        run, "kind string, target string, cluster_id long, distance double")


def seated(blocks: DataFrame, slab_rows: DataFrame) -> DataFrame:
    """(kind, target, cluster_id): the first far cluster with a fitting free member for each target that has one.

    Slabs have ``seats``: (cluster_id, style, n, low, high) and ``bases``, the
    members before the slab by casing.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[tuple, FarIndex] = {}
        for batch in batches:
            for kind, targets, slab, items, seats, bases in zip(*(c for c in batch.columns), strict=True):
                index = _kept(kept, kind.as_py(), slab.as_py(), items)
                by_style: dict[str, list] = {}
                for s in seats.as_py():
                    by_style.setdefault(s["style"], []).append(s)
                start = {b["style"]: b["base"] for b in bases.as_py()}
                free = {style: Seats(index, rows, start[style]) for style, rows in by_style.items()}
                found = ((t, free[t["style"]].first(index, t)) for t in targets.as_py() if t["style"] in free)
                yield _batch([(t["kind"], t["target"], *hit) for t, hit in found if hit], SEAT)

    hits = met(blocks, slab_rows).select("kind", "targets", "slab", "items", "seats", "bases").mapInArrow(
        run, "kind string, target string, wrapped int, cluster_id long")
    first = F.min(F.struct("wrapped", "cluster_id"))
    return hits.groupBy("kind", "target").agg(first.alias("x")).select("kind", "target", F.col("x.cluster_id").alias("cluster_id"))


def _kept(kept: dict[tuple, FarIndex], kind: str, slab: int, items: pa.Scalar) -> FarIndex:
    """The index of a slab; a task keeps the last few."""
    if (kind, slab) not in kept:
        if len(kept) >= 8:
            kept.pop(next(iter(kept)))
        kept[kind, slab] = FarIndex(items.as_py())
    return kept[kind, slab]


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

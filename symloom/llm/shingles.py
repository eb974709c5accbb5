"""Near-duplicates by the Jaccard similarity of word shingles: SimHash proposes, prefix filtering finds the rest exactly."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from symloom.llm.common import arrow_batches, checked_broadcast, written
from symloom.llm.components import components
from symloom.llm.simhash import fingerprint, heads, named, near_links

SHINGLE = 5
SIMILARITY = "0.8"
SEED = 42
SMALL_BUCKET = 4
# The narrowest parity, in bits; wider sets have wider ones.
PARITY = 1024
# Words of 64 bits in the sketches by which members of large buckets are compared; together no wider than the narrowest parity.
SKETCH = PARITY // 64
# A shingle that COMMON documents hold is common. That sets the order of shingles, not the result.
COMMON = 2
# Levels of common shingles, one byte each, are sent out: SLOTS bytes, whatever the corpus.
SLOTS = 1 << 24
# Shingles are counted by BLOCKS blocks of slots and 32 bits inside a block; a task gathers about KEPT of them before it passes on their counts.
BLOCKS, KEPT = 1 << 12, 1 << 18



def shingle_set(text: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the lower-cased words' shingles; all words as one if there are fewer; none without words."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in words), np.uint64, len(words))
    width = min(shingle, len(words))
    mixed = np.full(len(words) - width + 1, width, np.uint64)
    for i in range(width):
        mixed = (mixed ^ hashes[i:len(words) - width + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def digest(found: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(found.tobytes(), SEED)


def prefix(found: np.ndarray, levels: np.ndarray, at_least: Fraction) -> np.ndarray:
    """The shingles of which two sets that are similar enough share one: all but the last ceil(at_least * n) - 1, the common ones last.

    Similar sets share at_least * n shingles of the larger one or more. If the
    prefixes shared none, all that is shared would stand behind the prefix of
    the set whose prefix ends first, where there are fewer. Any one order of
    all shingles will do, so two that share a slot of ``levels`` do no harm.
    """
    n = len(found)
    need = -(-n * at_least.numerator // at_least.denominator)
    return found[np.lexsort((found, levels[found % np.uint64(len(levels))]))][:n - need + 1] if n else found


def can_reach(m: Column, i: Column, n: Column, j: Column, at_least: Fraction) -> Column:
    """Whether sets of ``m`` and ``n`` shingles can be similar enough if the first they share is the one at place ``i`` and ``j``, from 0.

    What they share then is that one and some of those behind it. A similar
    pair passes where it meets first, so other places may turn it down.
    """
    fits = F.least(m, n) * at_least.denominator >= F.greatest(m, n) * at_least.numerator
    return fits & (F.least(m - i, n - j) * (at_least.denominator + at_least.numerator) >= (m + n) * at_least.numerator)


def _slim(docs: DataFrame) -> DataFrame:
    arrow_batches(docs.sparkSession, megabytes=2)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))


def _counted(found: list[np.ndarray]) -> pa.RecordBatch:
    """(block, keys, counts): the shingles of all these sets by block of slots, with the number of sets that hold each."""
    width = np.uint64(SLOTS // BLOCKS)
    key = np.concatenate(found)
    inside = key % width + key // np.uint64(SLOTS) % (np.uint64(1 << 32) // width) * width
    packed, counts = np.unique((key % np.uint64(SLOTS) // width) << np.uint64(32) | inside, return_counts=True)
    blocks, starts = np.unique(packed >> np.uint64(32), return_index=True)
    ends = pa.py_buffer((np.append(starts, len(packed)) * 4).astype(np.int32))
    values = [pa.Array.from_buffers(pa.binary(), len(blocks), [None, ends, pa.py_buffer(v.astype(np.uint32))]) for v in (packed & np.uint64(0xFFFFFFFF), counts)]
    return pa.RecordBatch.from_arrays([pa.array(blocks.astype(np.int32)), *values], ["block", "keys", "counts"])


def common_levels(docs: DataFrame, shingle: int = SHINGLE) -> np.ndarray:
    """``SLOTS`` bytes: at a shingle's slot, how common it is, as the bits of the number of documents that hold it; 0 below ``COMMON``.

    All shingles of all documents are counted. They travel as sorted blocks of
    32-bit values with their counts, and a block of slots meets in one task: a
    group of one ``BLOCKS``-th of the shingles. Of shingles that share a slot, the
    highest level counts, so a common one never passes for a rare one.
    """
    width = SLOTS // BLOCKS
    common, kept = COMMON, KEPT

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held = [], 0
        for batch in batches:
            for text in batch.column(1):
                found.append(shingle_set(text.as_py(), shingle))
                held += len(found[-1])
                if held >= kept:
                    yield _counted(found)
                    found, held = [], 0
        if held:
            yield _counted(found)

    def levels_of(block: pa.Table) -> pa.Table:
        keys, counts = (np.frombuffer(b"".join(block.column(c).to_pylist()), np.uint32) for c in ("keys", "counts"))
        once, at = np.unique(keys, return_inverse=True)
        n = np.bincount(at, weights=counts)
        levels = np.zeros(width, np.uint8)
        np.maximum.at(levels, once % np.uint32(width), np.where(n >= common, np.frexp(n)[1], 0).astype(np.uint8))
        return pa.table({"block": block.column("block")[:1], "levels": pa.array([levels.tobytes()], pa.binary())})

    counted = _slim(docs).mapInArrow(each, "block int, keys binary, counts binary")
    levels = np.zeros(SLOTS, np.uint8)
    for row in counted.groupBy("block").applyInArrow(levels_of, "block int, levels binary").collect():
        levels[row["block"] * width:(row["block"] + 1) * width] = np.frombuffer(row["levels"], np.uint8)
    return levels


def parity_width(n: int) -> int:
    """Bits of the parity of a set of ``n``: the least power of two that is not below it, at least ``PARITY``."""
    return max(PARITY, 1 << max(n - 1, 0).bit_length())


def parity(found: np.ndarray) -> bytes:
    """Bits that tell whether an odd number of hashes falls on them: sets that differ in d elements differ in at most d bits.

    The width grows with the set, since a fixed one is as good as random, and
    rules nothing out, once sets have a few times as many elements.
    """
    width = parity_width(len(found))
    return np.packbits((np.bincount((found % np.uint64(width)).astype(np.int64), minlength=width) & 1).astype(np.uint8)).tobytes()


def sketches(parities: list[bytes]) -> pa.StructArray:
    """Parities brought to the narrowest width, as ``SKETCH`` words each, which Spark compares by itself."""
    rows = [folded(np.frombuffer(p, np.uint8)[None], PARITY // 8)[0] for p in parities]
    words = np.concatenate([np.zeros(0, np.uint8), *rows]).view(np.int64).reshape(-1, SKETCH)
    return pa.StructArray.from_arrays([pa.array(words[:, k]) for k in range(SKETCH)], [f"w{k}" for k in range(SKETCH)])


def may_differ(x: str, y: str, m: Column, n: Column, at_least: Fraction) -> Column:
    """Whether sets of ``m`` and ``n`` shingles can be similar enough by the bits in which their sketches differ, as in ``_possible``."""
    apart = sum((F.bit_count(F.col(f"{x}.w{k}").bitwiseXOR(F.col(f"{y}.w{k}"))) for k in range(SKETCH)), F.lit(0))
    return apart * (at_least.denominator + at_least.numerator) <= (m + n) * (at_least.denominator - at_least.numerator)


def folded(rows: np.ndarray, width: int) -> np.ndarray:
    """Parities of a wider power of two, as bytes in rows, brought to ``width`` bytes: the same bits as if made so."""
    while rows.shape[1] > width:
        half = rows.shape[1] // 2
        rows = rows[:, :half] ^ rows[:, half:]
    return rows


def differing_bits(left: list[bytes], right: list[bytes]) -> np.ndarray:
    """In how many bits the parities of each pair differ, at the width of the narrower one."""
    widths = np.array([(len(x), len(y)) for x, y in zip(left, right, strict=True)], np.int64).reshape(-1, 2)
    apart = np.zeros(len(left), np.int64)
    for m, n in np.unique(widths, axis=0):
        at = np.nonzero((widths == (m, n)).all(1))[0]
        x, y = (np.frombuffer(b"".join(side[i] for i in at), np.uint8).reshape(len(at), w) for side, w in ((left, m), (right, n)))
        apart[at] = np.bitwise_count(folded(x, min(m, n)) ^ folded(y, min(m, n))).sum(1, dtype=np.int64)
    return apart


def fingerprint_pairs(once: DataFrame, at_least: Fraction) -> DataFrame:
    """(a, b, m, n, shared) of set digests, m and n their sizes, that SimHash proposes as near copies and whose sizes fit.

    Sets of one SimHash fingerprint are paired with the smallest of them; the
    smallest of two fingerprints that ``near_links`` links are paired too. The
    proposals are verified on the shingles like any others.
    """
    prints = written(once.groupBy("simhash").agg(F.min(F.struct("fp", "n")).alias("low")).select("simhash", "low.fp", "low.n"), "shingle-prints")
    low = prints.select("simhash", F.col("fp").alias("a"), F.col("n").alias("m"))
    same = once.select("simhash", F.col("fp").alias("b"), "n").join(low, "simhash").select("a", "b", "m", "n")
    links = written(near_links(prints.select(F.col("simhash").alias("fp"))), "shingle-fingerprints")
    near = (links.select(F.col("a").alias("simhash"), F.col("b").alias("_other")).join(low, "simhash")
            .join(prints.select(F.col("simhash").alias("_other"), F.col("fp").alias("b"), "n"), "_other").select("a", "b", "m", "n"))
    met = same.unionByName(near).where("a <> b").where(F.least("m", "n") * at_least.denominator >= F.greatest("m", "n") * at_least.numerator)
    turned = F.col("a") > F.col("b")
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.when(turned, F.col("n")).otherwise(F.col("m")).alias("m"),
                      F.when(turned, F.col("m")).otherwise(F.col("n")).alias("n"), F.lit(0).cast("long").alias("shared")).distinct()


def _possible(pairs: DataFrame, once: DataFrame, at_least: Fraction, name: str) -> DataFrame:
    """(a, b, shared) of the pairs (a, b, m, n, shared), m and n their sizes, that parities do not rule out; none that is similar enough goes."""
    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = batch.column(2).to_numpy() + batch.column(4).to_numpy()
            apart = differing_bits(batch.column(3).to_pylist(), batch.column(5).to_pylist())
            # overlap >= at_least * union says that the sets differ in at most (1 - at_least) / (1 + at_least) of both sizes.
            few = apart * (at_least.denominator + at_least.numerator) <= both * (at_least.denominator - at_least.numerator)
            yield batch.select(["a", "b", "shared"]).filter(pa.array(few, pa.bool_()))

    left, right = (once.select(F.col("fp").alias(end), F.col("parity").alias(bits)) for end, bits in (("a", "x"), ("b", "y")))
    met = pairs.join(left, "a").join(right, "b")
    return written(met.select("a", "b", "m", "x", "n", "y", "shared").mapInArrow(kept, "a long, b long, shared long"), f"{name}-possible")


def _verified(pairs: DataFrame, docs: DataFrame, per: DataFrame, shingle: int, at_least: Fraction, name: str) -> DataFrame:
    """The pairs (a, b) of set digests that are similar enough, compared on the whole sets of one document each.

    Texts take less room than their hashes, so they are what is moved. Rows
    that repeat an id may hold other texts: those have another digest.
    """
    nodes = pairs.select(F.col("a").alias("fp")).unionByName(pairs.select(F.col("b").alias("fp"))).distinct()
    ids = written(per.join(nodes, "fp", "left_semi").select(F.col("first").alias("_first"), F.col("fp").alias("_fp")), f"{name}-reps")
    texts = _slim(docs).join(checked_broadcast(ids, 64), F.col("doc_id").eqNullSafe(F.col("_first"))).select(F.col("_fp").alias("fp"), "text")
    if not per.where("copies > 1").isEmpty():
        texts = texts.dropDuplicates(["fp", "text"])

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b, s, t in zip(batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy().view(np.uint64), batch.column(2), batch.column(3)):
                x, y = shingle_set(s.as_py(), shingle), shingle_set(t.as_py(), shingle)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(digest(x) == a and digest(y) == b and both * at_least.denominator >= (len(x) + len(y) - both) * at_least.numerator)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = texts.select(F.col("fp").alias("a"), F.col("text").alias("x"))
    right = texts.select(F.col("fp").alias("b"), F.col("text").alias("y"))
    return written(pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(close, "a long, b long"), f"{name}-links")


def _linked(pairs: DataFrame, docs: DataFrame, per: DataFrame, shingle: int, at_least: Fraction, name: str) -> DataFrame:
    """Of the pairs (a, b, shared), similar ones that connect whatever all similar ones connect.

    Texts move for every pair that is verified, and in a group of near copies
    nearly all pairs are similar. So each set is first verified with the one it
    shares most prefix shingles with; pairs inside the components that this
    gives are settled, only the others are verified as well.
    """
    best = written(pairs.groupBy("b").agg(F.max_by("a", F.struct("shared", "a")).alias("a")).select("a", "b"), f"{name}-best")
    links = _verified(best, docs, per, shingle, at_least, f"{name}-one")
    roots = written(components(links, f"{name}-one"), f"{name}-one-roots")
    ends = pairs.select("a", "b").join(best, ["a", "b"], "left_anti")
    for end in ("a", "b"):
        ends = ends.join(roots.select(F.col("node").alias(end), F.col("root").alias(f"{end}_root")), end, "left")
    rest = written(ends.where(~F.coalesce("a_root", "a").eqNullSafe(F.coalesce("b_root", "b"))).select("a", "b"), f"{name}-rest")
    return links.unionByName(_verified(rest, docs, per, shingle, at_least, f"{name}-all"))


def _unsettled(pairs: DataFrame, links: DataFrame) -> DataFrame:
    """The pairs (a, b, …) whose ends ``links`` do not connect."""
    roots = written(components(links, "shingle-near"), "shingle-near-roots")
    ends = pairs
    for end in ("a", "b"):
        ends = ends.join(roots.select(F.col("node").alias(end), F.col("root").alias(f"{end}_root")), end, "left")
    return ends.where(~F.coalesce("a_root", "a").eqNullSafe(F.coalesce("b_root", "b"))).select(*pairs.columns)


def similar_components(docs: DataFrame, shingle: int = SHINGLE, similarity: str = SIMILARITY) -> DataFrame:
    """doc_id, component_id and component_size per document, linked where shingle sets have at least this Jaccard similarity.

    No pair is lost, whatever the order of shingles. Documents of one set are
    one from the start. Then come the pairs whose SimHash fingerprints differ in
    two bits or less, verified on the shingles; what these connect is settled.
    The rest of the sets meet by the shingles of their prefixes; buckets of
    up to ``SMALL_BUCKET`` compare all pairs of fitting sizes and places
    (``can_reach``). In larger ones all members are compared with the smallest,
    then pairs only where the members are not yet linked with each other, at
    least one of them not with the smallest, and their sketches allow it.
    Parities rule pairs out, the others are verified on the whole sets.

    Null text, or one without words: the empty set, equal to others of its
    kind. Repeated rows get a row each. Empty table: empty result.
    """
    at_least = Fraction(similarity)
    levels = docs.sparkSession.sparkContext.broadcast(common_levels(docs, shingle))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_set(text.as_py(), shingle) for text in batch.column(1)]
            first = [prefix(f, levels.value, at_least).view(np.int64) for f in found]
            parities = [parity(f) for f in found]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(np.array([digest(f) for f in found], np.uint64).view(np.int64)), pa.array([len(f) for f in found], pa.int64()),
                pa.array(parities, pa.binary()), sketches(parities), pa.array(first, pa.list_(pa.int64())),
                pa.array(np.array([fingerprint(text.as_py()) for text in batch.column(1)], np.uint64).view(np.int64))],
                ["doc_id", "fp", "n", "parity", "sketch", "prefix", "simhash"])

    words = ", ".join(f"w{k}: long" for k in range(SKETCH))
    rows = written(_slim(docs).mapInArrow(prefixes, f"doc_id long, fp long, n long, parity binary, sketch struct<{words}>, prefix array<long>, simhash long"),
                   "shingle-rows")
    per = written(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")), "shingle-per")
    # A set held by many rows gives its prefix once; such sets are few after exact copies have gone, and only they are put together.
    repeated = written(per.where("copies > 1").select(F.col("fp").alias("_fp")), "shingle-copies")
    once = rows.select("fp", "n", "parity", "sketch", "prefix", "simhash")
    if not repeated.isEmpty():
        marked = once.join(checked_broadcast(repeated, 16), F.col("fp") == F.col("_fp"), "left")
        several = marked.where("_fp IS NOT NULL").groupBy("fp").agg(*(F.min(c).alias(c) for c in ("n", "parity", "sketch", "prefix", "simhash")))
        several = written(several, "shingle-several").select(*once.columns)
        once = marked.where("_fp IS NULL").select(*once.columns).unionByName(several)
        if repeated.count() * 16 > 64 << 20:
            once = written(once, "shingle-once")
    proposed = _possible(fingerprint_pairs(once, at_least), once, at_least, "shingle-near")
    links = _verified(proposed.select("a", "b"), docs, per, shingle, at_least, "shingle-near")
    # Each entry moves once: its bucket's size and smallest member are found where the bucket's entries meet.
    keys = once.select(F.posexplode("prefix").alias("at", "key"), "fp", F.col("n").cast("int").alias("n"))
    bucket = Window.partitionBy("key")
    met = (keys.withColumn("held", F.count("*").over(bucket)).withColumn("low", F.min(F.struct("fp", "n", "at")).over(bucket)).where("held > 1")
           .select("key", "fp", F.col("n").cast("long").alias("n"), "at", "held",
                   F.col("low.fp").alias("low"), F.col("low.n").cast("long").alias("low_n"), F.col("low.at").alias("low_at")))
    met = written(met, "shingle-met")

    small = met.where(F.col("held") <= SMALL_BUCKET)
    mine = small.select("key", F.col("fp").alias("a"), F.col("n").alias("m"), F.col("at").alias("i"))
    other = small.select("key", F.col("fp").alias("b"), "n", F.col("at").alias("j"))
    fits = can_reach(F.col("m"), F.col("i"), F.col("n"), F.col("j"), at_least)
    pairs = mine.join(other, "key").where((F.col("a") < F.col("b")) & fits).select("a", "b", "m", "n")
    large = met.where(F.col("held") > SMALL_BUCKET)
    stars = large.where("fp <> low").select(F.col("low").alias("a"), F.col("fp").alias("b"), F.col("low_n").alias("m"), "n", F.col("low_at").alias("i"), F.col("at").alias("j"))
    stars = stars.where(fits).select("a", "b", "m", "n")
    pairs = pairs.unionByName(stars).groupBy("a", "b", "m", "n").agg(F.count("*").alias("shared"))
    pairs = _possible(pairs, once, at_least, "shingle")
    links = links.unionByName(_linked(written(_unsettled(pairs, links), "shingle-unsettled"), docs, per, shingle, at_least, "shingle"))

    if not large.isEmpty():
        roots = written(components(links, "shingle-first"), "shingle-first-roots").select(F.col("node").alias("_node"), "root")
        rooted = large.join(roots, F.col("fp") == F.col("_node"), "left").select("key", "fp", "n", "at", "low", F.coalesce("root", "fp").alias("root"))
        rooted = rooted.join(roots.select(F.col("_node"), F.col("root").alias("low_root")), F.col("low") == F.col("_node"), "left")
        rooted = rooted.join(once.select("fp", "sketch"), "fp")
        rooted = written(rooted.select("key", "fp", "n", "at", "sketch", "root", (F.col("root") != F.coalesce("low_root", "low")).alias("apart")), "shingle-large")
        apart = rooted.where("apart").select("key", F.col("fp").alias("x"), F.col("n").alias("m"), F.col("at").alias("i"),
                                                F.col("sketch").alias("x_sketch"), F.col("root").alias("x_root"))
        near = may_differ("sketch", "x_sketch", F.col("m"), F.col("n"), at_least)
        more = (rooted.withColumnRenamed("at", "j").join(apart, "key").where((F.col("root") != F.col("x_root")) & fits & near)
                .select(F.least("fp", "x").alias("a"), F.greatest("fp", "x").alias("b"),
                        F.when(F.col("fp") < F.col("x"), F.col("n")).otherwise(F.col("m")).alias("m"),
                        F.when(F.col("fp") < F.col("x"), F.col("m")).otherwise(F.col("n")).alias("n")).groupBy("a", "b", "m", "n").agg(F.count("*").alias("shared"))
                .join(pairs, ["a", "b"], "left_anti"))
        more = _possible(more, once, at_least, "shingle-more")
        if not more.isEmpty():
            links = links.unionByName(_linked(more, docs, per, shingle, at_least, "shingle-second"))
    return named(rows.select("doc_id", "fp"), links, "shingle").select("doc_id", "component_id", "component_size")


def similar_heads(docs: DataFrame, shingle: int = SHINGLE, similarity: str = SIMILARITY) -> DataFrame:
    """The rows of ``docs``, whole, that head their component (``simhash.heads``)."""
    return heads(docs, similar_components(docs, shingle, similarity))

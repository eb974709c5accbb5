"""Near-duplicates by SimHash, found with Golay-code fuzzy hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symloom.llm.common import arrow_batches, checked_broadcast, fresh, written
from symloom.llm.components import components

SHINGLE = 3
SEED = 42
# Segments of the 64 bits as (first bit, bits). Each is a word of the 23-bit Golay code whose other bits are zero.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
# Up to two differing bits leave one of these pairs with none in its first segment and at most one in its second.
PAIRS = ((0, 1), (1, 2), (2, 0))
GENERATOR = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1, the Golay code's polynomial
SMALL_BUCKET = 128


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of the lower-cased words' shingles, repeats included; 0 without words."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(b" ".join(w), SEED) for w in zip(*(words[i:] for i in range(shingle)))), np.uint64,
                         len(words) - shingle + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        block = hashes[at:at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(sum(1 << b for b in np.nonzero(2 * ones > len(hashes))[0].tolist()))


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.array([fingerprint(text.as_py()) for text in batch.column(1)], np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64), pa.int64())], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and ``fp``, the fingerprint as a signed long, for every whole text."""
    arrow_batches(docs.sparkSession)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return slim.mapInArrow(_fingerprints, "doc_id long, fp long")


def syndromes(words: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit words by the generator."""
    words = words.copy()
    for bit in range(22, 10, -1):
        words ^= (words >> bit & 1) * (GENERATOR << (bit - 11))
    return words


def golay_tables() -> tuple[np.ndarray, np.ndarray]:
    """For each 11-bit syndrome, the error words of up to 4 bits that lead to a codeword: first the one of up to 3, then the others.

    The Golay code is perfect: a 23-bit word has exactly one codeword within
    three bits. If it is exactly three away, five more codewords are four away,
    else none. Returns (2048, 6) errors and how many of each row are used.
    """
    bits = 1 << np.arange(23, dtype=np.int64)
    errors = [np.zeros(1, np.int64)]
    for _ in range(4):
        more = (errors[-1][:, None] | bits[None, :]).ravel()
        errors.append(np.setdiff1d(more, np.concatenate(errors)))
    table, used = np.zeros((2048, 6), np.int64), np.zeros(2048, np.int64)
    for group in errors[:4]:
        at = syndromes(group)
        table[at, 0], used[at] = group, 1
    far = syndromes(errors[3])
    four, of = errors[4], syndromes(errors[4])
    four, of = four[np.isin(of, far)], of[np.isin(of, far)]
    order = np.argsort(of, kind="stable")
    four, of = four[order].reshape(-1, 5), of[order].reshape(-1, 5)
    table[of[:, 0], 1:], used[of[:, 0]] = four, 6
    return table, used


TABLE, USED = golay_tables()


def fuzzy_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of uint64 fingerprints as (place, key, home).

    A key joins the bits of one segment, as they are, with the number of a
    codeword within four bits of another segment. The home key has the nearest
    codeword. If two fingerprints agree in the first segment and differ in at
    most one bit of the second, the home codeword of either, at most three
    away, is at most four away from the other, so they share that key.
    """
    places, keys, homes = [], [], []
    values = fps.astype(np.int64)
    parts = [values >> first & ((1 << bits) - 1) for first, bits in SEGMENTS]
    for pair, (exact, fuzzy) in enumerate(PAIRS):
        which = syndromes(parts[fuzzy])
        for k in range(6):
            at = np.nonzero(USED[which] > k)[0]
            # The upper 12 of the 23 bits tell the codewords apart.
            codeword = (parts[fuzzy][at] ^ TABLE[which[at], k]) >> 11
            places.append(at)
            keys.append((np.int64(pair) << 60) | (codeword << 24) | parts[exact][at])
            homes.append(np.full(len(at), k == 0))
    return np.concatenate(places), np.concatenate(keys), np.concatenate(homes)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = batch.column(0).to_numpy().view(np.uint64)
        place, key, home = fuzzy_keys(fps)
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fps[place].view(np.int64)), pa.array(home)], ["key", "fp", "home"])


def differing(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def near_links(fps: DataFrame, most: int = 2) -> DataFrame:
    """Links (a, b) between distinct fingerprints of ``fp`` that join all of those within ``most`` (at most 2) differing bits.

    Fingerprints meet by fuzzy keys. Keys held once are dropped by a semi-join
    with counts made by partial sums. Buckets of up to 128 fingerprints compare
    home against all members and keep pairs that are verified. Larger buckets
    are not compared in pairs: each of their members gives itself and its 64
    one-bit neighbours as keys, two members share one exactly if they differ in
    two bits or less, and all who share one are linked to the smallest of them.
    """
    if most > 2:
        raise ValueError("the keys cover at most two differing bits")
    keys = written(fps.select("fp").distinct().mapInArrow(_keyed, "key long, fp long, home boolean"), "simhash-keys")
    counts = written(keys.groupBy("key").agg(F.count("*").alias("n"), F.max("home").alias("any_home"))
                     .where("n > 1 AND any_home").select(F.col("key").alias("_key"), "n"), "simhash-buckets")
    met = written(keys.join(counts, F.col("key") == F.col("_key")).select("key", "fp", "home", "n"), "simhash-met")
    small = met.where(F.col("n") <= SMALL_BUCKET)
    homes = small.where("home").select("key", F.col("fp").alias("a"))
    pairs = (homes.join(small.select("key", F.col("fp").alias("b")), "key")
             .where((F.col("a") != F.col("b")) & (differing(F.col("a"), F.col("b")) <= most)).select("a", "b"))
    crowd = met.where(F.col("n") > SMALL_BUCKET).select("fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *(F.lit((1 << i) - (1 << 64) * (i == 63)).cast("long") for i in range(64)))
    shared = written(crowd.select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("key")), "simhash-crowd")
    stars = written(shared.groupBy("key").agg(F.min("fp").alias("low"), F.count("*").alias("n")).where("n > 1").select(F.col("key").alias("_key"), "low"), "simhash-stars")
    linked = (shared.join(stars, F.col("key") == F.col("_key")).where("fp <> low")
              .where(differing(F.col("fp"), F.col("low")) <= most).select(F.col("fp").alias("a"), F.col("low").alias("b")))
    return pairs.unionByName(linked)


def named(rows: DataFrame, links: DataFrame, name: str) -> DataFrame:
    """doc_id, fp, component_id and component_size for (doc_id, fp), given links (a, b) between values of ``fp``."""
    roots = written(components(links, name), f"{name}-roots")
    # Per fingerprint first: a fingerprint may stand for any share of the rows.
    per = written(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), f"{name}-per")
    rooted = per.join(roots, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"), "first", "n")
    rooted = written(rooted, f"{name}-rooted")
    names = written(rooted.groupBy("root").agg(F.min("first").alias("component_id"), F.sum("n").alias("component_size"))
                    .select(F.col("root").alias("_root"), "component_id", "component_size"), f"{name}-names")
    found = written(rooted.join(names, F.col("root") == F.col("_root")).select(F.col("fp").alias("_fp"), "component_id", "component_size"), f"{name}-named")
    return rows.join(found, F.col("fp") == F.col("_fp")).select("doc_id", "fp", "component_id", "component_size")


def simhash_components(docs: DataFrame, most: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id and component_size per document.

    The component is the smallest doc_id reachable by links of at most ``most``
    differing bits. Texts are read once; only fingerprints move, distinct ones
    past the first step, so a group of equal texts costs no more than one.

    Null text, or one without words: fingerprint zero, linked like any other.
    Repeated rows get a row each; null doc_id: it never gives a component its
    name unless it is alone, then that is null. Empty table: empty result.
    Columns besides doc_id and text are not looked at.
    """
    rows = written(fingerprints(docs), "simhash-docs")
    return named(rows, near_links(rows, most), "simhash").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "component_size")


def component_heads(docs: DataFrame, most: int = 2) -> DataFrame:
    """The rows of ``docs``, whole, that head their component (``heads``)."""
    return heads(docs, simhash_components(docs, most))


def heads(docs: DataFrame, components_of: DataFrame) -> DataFrame:
    """The rows of ``docs``, whole, that head their component by (doc_id, component_id): one per component, that with the smallest id.

    Ids of the others, fewer than the documents, are joined back: sent out while
    they are few, else both sides are shuffled once. Where an id repeats, one of
    its rows is taken; rows without id stay if nothing is near them.
    """
    found = written(components_of, "simhash-found")
    ids = found.groupBy("doc_id").agg(F.count("*").alias("n"), F.min(F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("heads"))
    key, head = fresh(docs, "_id"), fresh(docs, "_heads")
    marked = written(ids.where("NOT heads OR n > 1").select(F.col("doc_id").alias(key), F.col("heads").alias(head)), "simhash-drops")
    joined = docs.join(checked_broadcast(marked, 96), F.col("doc_id").cast("long").eqNullSafe(F.col(key)), "left")
    out = joined.where(F.col(head).isNull())
    if not marked.where(head).isEmpty():
        out = out.unionByName(joined.where(head).dropDuplicates(["doc_id"]))
    return out.select(*docs.columns)

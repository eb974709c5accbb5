"""Removal of repeated passages by column-wise construction of aligned suffix orders.

A collection's suffix order, its Burrows-Wheeler column and its common
prefixes can be built column by column: each round inserts one symbol per
string. Done on whole documents this takes as many rounds, and passes over the
whole collection, as the longest document has bytes. Only suffixes that could
start a repeat matter, and those can be aligned: equal strings of ``length``
bytes have the same smallest 32-byte gram, their anchor, at the same place. So
the strings inserted here are the contexts of anchors that occur more than
once, 168 bytes with the anchor in the middle, spread over the tasks by anchor;
every collection needs 168 rounds, whatever the documents' lengths, and reads
its strings once from Spark's sorted shuffle files.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from symloom.llm.common import arrow_batches, written

LENGTH = 100
GRAM = 32
REACH = LENGTH - GRAM  # bytes of context on each side of an anchor
WIDTH = 2 * REACH + GRAM
CHUNK = 1 << 19  # bytes that are hashed together
PLACE_BITS = 31  # room for places in a chunk: no Spark value is longer
COLLECTION = 40_000  # strings sorted together
SAMPLE = 20_000  # documents looked at for frequent anchors
FREQUENT = 0.01  # share of the sampled documents that makes an anchor frequent
LEAST = 50  # sampled documents
MIXERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)

ROW = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("doc_id", pa.int64()), ("row_no", pa.int64()),
                 ("place", pa.int32()), ("hi", pa.int32()), ("kind", pa.int8())])
ROW_DDL = "a long, b long, doc_id long, row_no long, place int, hi int, kind tinyint"
CONTEXT, WINDOW, REPEAT = 0, 1, 2


def _words(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from every place on, as one number."""
    return np.ascontiguousarray(np.lib.stride_tricks.as_strided(raw, (len(raw) - 7, 8), (1, 1))).view("<u8").ravel()


def _mixed(words: np.ndarray, places: np.ndarray | None, offsets: list[int], mixer: int) -> np.ndarray:
    """A 64-bit hash of the words at ``offsets`` from each place (from every place if None)."""
    n = len(words) - offsets[-1] if places is None else len(places)
    out = np.full(n, mixer, np.uint64)
    for offset in offsets:
        out ^= words[offset:offset + n] if places is None else words[places + offset]
        out *= np.uint64(mixer)
        out ^= out >> np.uint64(29)
    out *= np.uint64(MIXERS[0] ^ mixer | 1)
    return out ^ (out >> np.uint64(32))


GRAM_WORDS = [0, 8, 16, 24]
LENGTH_WORDS = [*range(0, LENGTH - 8, 8), LENGTH - 8]
CONTEXT_WORDS = [*range(0, WIDTH - 7, 8)]


class Chunk:
    """Some texts behind each other, with room around each, and the anchors of their windows."""

    def __init__(self, texts: list[bytes]):
        self.lengths = np.array([len(t) for t in texts], np.int64)
        gap = bytes(REACH + 8)
        self.starts = np.cumsum(np.concatenate(([len(gap)], self.lengths[:-1] + len(gap))))
        self.raw = np.frombuffer(gap + b"".join(t + gap for t in texts) + bytes(WIDTH), np.uint8)
        self.words = _words(self.raw)
        grams = _mixed(self.words, None, GRAM_WORDS, MIXERS[1])
        # Upper bits decide, the same ones in every chunk, then the place, so the leftmost of equal ones is taken wherever the window stands.
        bits = np.uint64(PLACE_BITS)
        least = (grams >> bits << bits) | np.arange(len(grams), dtype=np.uint64)
        size, span = REACH + 1, 1
        while span * 2 <= size:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if span < size:
            least = np.minimum(least[:-(size - span)], least[size - span:])
        firsts = [np.arange(s, s + n - LENGTH + 1) for s, n in zip(self.starts, self.lengths) if n >= LENGTH]
        self.windows = np.concatenate(firsts) if firsts else np.zeros(0, np.int64)
        chosen = (least[self.windows] & np.uint64((1 << int(bits)) - 1)).astype(np.int64)
        turn = np.concatenate(([True], chosen[1:] != chosen[:-1])) if len(chosen) else np.zeros(0, bool)
        self.anchors = chosen[turn]
        self.of_window = np.cumsum(turn) - 1
        self.keys = grams[self.anchors]
        self.text = np.searchsorted(self.starts, self.anchors, side="right") - 1
        self.place = self.anchors - self.starts[self.text]

    def context_hash(self) -> np.ndarray:
        """Of the bytes around each anchor and how many of them belong to its text."""
        before = np.minimum(self.place, REACH)
        after = np.minimum(self.lengths[self.text] - self.place - GRAM, REACH)
        out = _mixed(self.words, self.anchors - REACH, CONTEXT_WORDS, MIXERS[0])
        out ^= (before * 1000 + after).astype(np.uint64)
        out *= np.uint64(MIXERS[1])
        return out ^ (out >> np.uint64(31))


def _chunks(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Consecutive (from, to) of texts of about ``CHUNK`` bytes."""
    start, total = 0, 0
    for i, text in enumerate(texts):
        total += len(text)
        if total >= CHUNK:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def _sampled_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for text in batch.column(0):
            keys = np.unique(Chunk([text.as_py()]).keys)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64))], ["a"])


def frequent_anchors(docs: DataFrame) -> np.ndarray:
    """Anchors in more than one percent of about 20,000 documents drawn by a hash of the id.

    This only tells which anchors are worked on window by window; results do not
    depend on it. At most a hundred times the anchors of one document are kept.
    """
    total = docs.count()
    share = min(1.0, SAMPLE / max(1, total))
    drawn = docs.where(F.pmod(F.xxhash64("doc_id", "row_no"), F.lit(1_000_000)) < share * 1_000_000).where(F.octet_length("text") >= LENGTH)
    least = max(LEAST, int(FREQUENT * min(total, SAMPLE)))
    rows = drawn.select("text").mapInArrow(_sampled_keys, "a long").groupBy("a").count().where(F.col("count") >= least)
    return np.sort(np.array([r["a"] for r in rows.collect()], np.int64).view(np.uint64))


def _reduced(a, b, doc_id, row_no, place, hi, kind: int) -> Iterator[pa.RecordBatch]:
    """Of rows that agree in (a, b), here in one task, the first goes on; the others are repeats already."""
    if not len(a):
        return
    order = np.lexsort((place, row_no, doc_id, b, a))
    columns = [x[order] for x in (a, b, doc_id, row_no, place, hi)]
    a, b = columns[:2]
    again = np.concatenate(([False], (a[1:] == a[:-1]) & (b[1:] == b[:-1])))
    for keep, own in ((~again, kind), (again, REPEAT)):
        if keep.any():
            out = [x[keep] for x in columns]
            if own == REPEAT:  # these only have to reach their document
                if kind == CONTEXT:
                    out[4] = np.maximum(out[4] - REACH, 0)
                out[0], out[1] = out[2] * np.int64(1_000_003) + out[4], np.arange(len(out[0]))
            yield pa.RecordBatch.from_arrays([*(pa.array(c, t.type) for c, t in zip(out, ROW)),
                                              pa.array(np.full(len(out[0]), own, np.int8))], schema=ROW)


def anchor_rows(docs: DataFrame, frequent: np.ndarray) -> DataFrame:
    """Rows of three kinds, by ``place`` in a document, with the last window start ``hi`` that they stand for.

    Context: ``a`` is the anchor at ``place``, ``b`` the hash of its context.
    Window: a single window of a frequent anchor, ``a`` and ``b`` its hash.
    Repeat: an equal row came before it in the same batch, so the windows from
    ``place`` to ``hi`` start earlier elsewhere.
    """
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = shared.value
        for batch in batches:
            ids, numbers = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            texts = [t.as_py() for t in batch.column(2)]
            contexts, windows = [], []
            for start, end in _chunks(texts):
                chunk = Chunk(texts[start:end])
                if not len(chunk.anchors):
                    continue
                hot = np.isin(chunk.keys, often) if len(often) else np.zeros(len(chunk.keys), bool)
                at = np.nonzero(~hot)[0]
                text, place = chunk.text[at], chunk.place[at]
                contexts.append((chunk.keys[at].view(np.int64), chunk.context_hash()[at].view(np.int64), ids[start:end][text],
                                 numbers[start:end][text], place, np.minimum(place, chunk.lengths[text] - LENGTH)))
                if hot.any():
                    which = hot[chunk.of_window]
                    at = chunk.windows[which]
                    text = chunk.text[chunk.of_window[which]]
                    place = at - chunk.starts[text]
                    windows.append((_mixed(chunk.words, at, LENGTH_WORDS, MIXERS[0]).view(np.int64),
                                    _mixed(chunk.words, at, LENGTH_WORDS, MIXERS[1]).view(np.int64),
                                    ids[start:end][text], numbers[start:end][text], place, place))
            for kind, found in ((CONTEXT, contexts), (WINDOW, windows)):
                if found:
                    yield from _reduced(*(np.concatenate(c) for c in zip(*found)), kind)

    return docs.where(F.octet_length("text") >= LENGTH).mapInArrow(rows, ROW_DDL)


def insert_columns(strings: np.ndarray, rank: np.ndarray, columns: int = REACH + 1, length: int = LENGTH) -> np.ndarray:
    """Which windows of ``strings`` repeat one of a smaller rank: a (strings, columns) table of flags.

    ``strings`` holds a symbol per row and column, 0 where a text has ended or
    not begun. From the last column to the first, each round inserts one symbol
    per string: the symbols in the present order of suffixes are the collection's
    Burrows-Wheeler column, its stable sort is the next order, and neighbours
    with the same symbol have one more symbol in common than the least common
    prefix between their former places; an end symbol equals nothing. Where at
    least ``length`` symbols are shared, windows are equal.
    """
    n, width = strings.shape
    order, common = np.arange(n), np.zeros(n, np.int32)
    out = np.zeros((n, columns), bool)
    for column in range(width - 1, -1, -1):
        bwt = strings[order, column]
        moved = np.argsort(bwt, kind="stable")
        symbols = bwt[moved]
        same = np.nonzero((symbols[1:] == symbols[:-1]) & (symbols[1:] > 0))[0]
        fresh = np.zeros(n, np.int32)
        low, high = moved[same] + 1, moved[same + 1]  # least of common[low … high]
        levels = np.frexp((high - low + 1).astype(np.float64))[1] - 1
        table = common
        for level in range(int(levels.max(initial=-1)) + 1):
            if level:
                half = 1 << (level - 1)
                table = np.minimum(table[:-half], table[half:])
            at = np.nonzero(levels == level)[0]
            fresh[same[at] + 1] = 1 + np.minimum(table[low[at]], table[high[at] + 1 - (1 << level)])
        order, common = order[moved], fresh
        if column < columns:
            heads = np.nonzero(common < length)[0]
            ranks = rank[order]
            first = np.repeat(np.minimum.reduceat(ranks, heads), np.diff(np.append(heads, n)))
            out[order, column] = ranks != first
    return out


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, doc_id, row_no, lo, hi, context) of the anchors of every text, given as lists of a, lo and hi."""
    for batch in batches:
        out: list[list] = [[], [], [], [], [], []]
        for doc_id, row_no, text, anchors in zip(*(batch.column(i) for i in range(4))):
            raw, doc_id, row_no = text.as_py(), doc_id.as_py(), row_no.as_py()
            for x in anchors.as_py():
                place = x["place"]
                left, right = max(0, place - REACH), min(len(raw), place + GRAM + REACH)
                for column, value in zip(out, (x["a"], doc_id, row_no, place, REACH - (place - left), raw[left:right])):
                    column.append(value)
        yield pa.RecordBatch.from_arrays([*(pa.array(out[i], pa.int64()) for i in range(3)), pa.array(out[3], pa.int32()),
                                          pa.array(out[4], pa.int32()), pa.array(out[5], pa.binary())],
                                         ["a", "doc_id", "row_no", "place", "missing", "context"])


def _judged(a, doc_id, row_no, place, missing, contexts: list[bytes]) -> pa.RecordBatch:
    strings = np.zeros((len(a), WIDTH), np.uint16)
    for i, (skip, raw) in enumerate(zip(missing, contexts)):
        strings[i, skip:skip + len(raw)] = np.frombuffer(raw, np.uint8)
        strings[i, skip:skip + len(raw)] += 1
    rank = np.empty(len(a), np.int64)
    rank[np.lexsort((place, row_no, doc_id))] = np.arange(len(a))
    flags = np.zeros((len(a), REACH + 3), np.int8)
    flags[:, 1:-1] = insert_columns(strings, rank)
    edges = np.diff(flags, axis=1)
    row, first = np.nonzero(edges == 1)
    _, last = np.nonzero(edges == -1)
    start = place[row] - REACH
    return pa.RecordBatch.from_arrays([pa.array(doc_id[row]), pa.array(row_no[row]), pa.array(start + first, pa.int32()),
                                       pa.array(start + last - 1, pa.int32())], ["doc_id", "row_no", "lo", "hi"])


def _sorted_collections(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Read strings sorted by anchor, take about ``COLLECTION`` at a time without parting an anchor, and judge them."""
    held: list[pa.RecordBatch] = []
    size = 0

    def judged(table: pa.Table) -> pa.RecordBatch:
        columns = [table[c].to_numpy() for c in ("a", "doc_id", "row_no", "place", "missing")]
        return _judged(*columns, table["context"].to_pylist())

    for batch in batches:
        held.append(batch)
        size += len(batch)
        if size >= COLLECTION:
            table = pa.Table.from_batches(held)
            a = table["a"].to_numpy()
            cut = int(np.searchsorted(a, a[-1]))
            if cut:
                yield judged(table.slice(0, cut))
                held, size = table.slice(cut).to_batches(), size - cut
    if size:
        yield judged(pa.Table.from_batches(held))


def spans(lo: list[int], hi: list[int], length: int = LENGTH) -> list[tuple[int, int]]:
    """Maximal byte runs (from, to) covered by windows that start at lo … hi."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(zip(lo, hi)):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end + length))
        else:
            out.append((start, end + length))
    return out


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    runs = pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))
    for batch in batches:
        out: list[list] = [[], [], [], [], []]
        for text, windows in zip(batch.column(1), batch.column(2)):
            raw, windows = text.as_py(), windows.as_py() or []
            found = spans([w["lo"] for w in windows], [w["hi"] for w in windows])
            digest, at = hashlib.sha256(), 0
            for start, end in found:
                digest.update(raw[at:start])
                at = end
            digest.update(raw[at:])
            row = (len(raw), sum(e - s for s, e in found), len(found), digest.hexdigest(), [{"from": s, "to": e} for s, e in found])
            for column, value in zip(out, row):
                column.append(value)
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in out[:3]), pa.array(out[3], pa.string()),
                                          pa.array(out[4], runs)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and ``spans`` (byte runs removed) per document.

    Removed is every byte covered by a 100-byte string that also starts earlier,
    in a document of smaller id or before in the same one. Steps: anchors of
    all windows with hashes of their contexts, equal ones reduced in each batch;
    one shuffle by anchor, in which equal contexts leave their first occurrence
    and the windows of the others are repeats; column-wise orders of the
    different contexts that share an anchor; all windows of a document
    together. Frequent anchors are spread by window instead. Every text is
    moved once, to be cut and to be hashed.

    Null text: empty. Texts below 100 bytes: nothing removed. Rows that repeat an
    id: separate documents in the order in which they are read. Null id: before all others.
    Empty table: empty result. Columns besides doc_id and text are not looked at.
    """
    arrow_batches(docs.sparkSession)
    slim = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc_id"),
                       F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    ids = docs.agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("d")).first()
    if ids["n"] == ids["d"]:
        slim = slim.select("doc_id", F.lit(0).cast("long").alias("row_no"), "text")
    else:  # numbers have to be the same whenever the rows are read
        slim = written(slim.withColumn("row_no", F.monotonically_increasing_id()), "repeats-docs").select("doc_id", "row_no", "text")
    found = anchor_rows(slim, frequent_anchors(slim)).repartition("a")
    same = Window.partitionBy("a", "b", "kind").orderBy("doc_id", "row_no", "place")
    found = found.withColumn("turn", F.row_number().over(same))
    different = F.sum(((F.col("kind") == CONTEXT) & (F.col("turn") == 1)).cast("int")).over(Window.partitionBy("a"))
    lo = F.when(F.col("kind") == CONTEXT, F.greatest(F.col("place") - REACH, F.lit(0))).otherwise(F.col("place"))
    found = (found.withColumn("different", different)
             .withColumn("repeat", (F.col("kind") == REPEAT) | (F.col("turn") > 1)).withColumn("lo", lo)
             .where(F.col("repeat") | ((F.col("kind") == CONTEXT) & (F.col("different") > 1))))
    found = written(found.select("a", "doc_id", "row_no", "place", "lo", "hi", "repeat"), "repeats-anchors")

    # Both joins below read this one exchange: it is the same in one plan.
    texts = slim.repartition("doc_id", "row_no")
    key = ["doc_id", "row_no"]
    wanted = found.where("NOT repeat").groupBy(*key).agg(F.collect_list(F.struct("a", "place")).alias("anchors"))
    contexts = (texts.join(wanted, key).select("doc_id", "row_no", "text", "anchors")
                .mapInArrow(_contexts, "a long, doc_id long, row_no long, place int, missing int, context binary"))
    judged = contexts.repartition("a").sortWithinPartitions("a").mapInArrow(_sorted_collections, "doc_id long, row_no long, lo int, hi int")
    repeats = found.where("repeat").select("doc_id", "row_no", "lo", "hi").unionByName(judged)
    windows = repeats.groupBy(*key).agg(F.collect_list(F.struct("lo", "hi")).alias("windows"))
    out = texts.join(windows, key, "left").select("doc_id", "text", "windows").mapInArrow(
        _removed, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<from: int, to: int>>")
    return out.withColumn("doc_id", F.when(F.col("doc_id") > -(1 << 63), F.col("doc_id")))

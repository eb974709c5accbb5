"""Scoring documents by the cross-entropy difference of two matched n-gram models of words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symloom.llm.common import arrow_batches, checked_broadcast, written

PRIOR = 4.0
GRAM_BYTES = 96  # what a row of the model takes once it is sent out
SLAB = 1 << 22
FACTOR = np.uint64(0x9E3779B97F4A7C15)

BLANK = np.isin(np.arange(256), [32, *range(9, 14)])
# A random number for every byte; A-Z count as a-z.
NUMBERS = np.random.default_rng(5).integers(1, 1 << 63, 256, np.uint64)
NUMBERS[65:91] = NUMBERS[97:123]


def mixed(h: np.ndarray) -> np.ndarray:
    """The bits of every number spread over all 64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_codes(text: bytes) -> np.ndarray:
    """A 64-bit code of every word, without case of A-Z; worked on in slabs of whole words, so long texts take little more than their words."""
    codes = np.frombuffer(text, np.uint8)
    edges = np.flatnonzero(np.diff(np.concatenate(([True], BLANK[codes], [True]))))
    starts, ends = edges[::2], edges[1::2]
    out, at = np.zeros(len(starts), np.uint64), 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + SLAB, "right")))
        first, sizes = starts[at:to], ends[at:to] - starts[at:to]
        offset = np.cumsum(sizes) - sizes
        place = np.arange(sizes.sum()) - np.repeat(offset, sizes)
        powers = np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(sizes.max(), FACTOR))))
        out[at:to] = np.add.reduceat(NUMBERS[codes[np.repeat(first, sizes) + place]] * powers[place], offset)
        at = to
    return mixed(out)


def pairs(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every word: the code of it and the word before, that of the word before (0 at the start), and its own."""
    words = word_codes(text)
    before = np.concatenate((np.zeros(min(1, len(words)), np.uint64), words[:-1]))
    return mixed(before * FACTOR + words), before, words


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found: dict[bool, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {True: [], False: []}
        for flag, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            found[flag].append(pairs(text.as_py()))
        for flag, parts in found.items():
            if parts:
                gram, before, word = (np.concatenate(x) for x in zip(*parts))
                gram, at, n = np.unique(gram, return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(before[at].view(np.int64)), pa.array(word[at].view(np.int64)),
                                                  pa.array(n if flag else np.zeros(len(n), np.int64)), pa.array(n)], ["gram", "before", "word", "target", "n"])


def train(docs: DataFrame, target_ids: DataFrame) -> DataFrame:
    """Both models as one table: gram, target and background, the log probabilities of a word behind another.

    Every pair of neighbouring words of every document of (doc_id, text) is
    counted and has a row, so the table grows with the corpus; ``target_ids``
    (doc_id) names the target's documents. The vocabulary, all words, is
    shared. The background is what is outside the target, scaled to the target's
    mass, so that the prior weighs the same in both; without a target, or
    with nothing outside it, there is nothing to match and all documents count.
    Pairs fall back on single words, and these on the vocabulary, with a fixed
    prior strength. Words and pairs are told apart by 64-bit codes.
    """
    arrow_batches(docs.sparkSession)
    targets = checked_broadcast(target_ids.select(F.col("doc_id").cast("long").alias("_id")).where("_id IS NOT NULL").distinct(), 16)
    rows = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
            .where(F.octet_length("text") > 0)
            .join(targets, F.col("doc_id") == F.col("_id"), "left")
            .select(F.col("_id").isNotNull().alias("is_target"), "text"))
    grams = written(rows.mapInArrow(_counted, "gram long, before long, word long, target long, n long")
                    .groupBy("gram").agg(F.min("before").alias("before"), F.min("word").alias("word"), F.sum("target").alias("target"), F.sum("n").alias("n")),
                    "lm-grams")
    words = grams.groupBy("word").agg(F.sum("target").alias("word_target"), F.sum("n").alias("word_n"))
    words = written(words, "lm-words")
    size, mass, everything = words.agg(F.count("*"), F.coalesce(F.sum("word_target"), F.lit(0)), F.coalesce(F.sum("word_n"), F.lit(0))).first()
    scale = mass / (everything - mass) if 0 < mass < everything else None

    def background(target: str, n: str):
        return F.col(n).cast("double") if scale is None else (F.col(n) - F.col(target)) * F.lit(scale)

    def smoothed(count, total, lower):
        return (count + PRIOR * lower) / (total + PRIOR)

    outside = mass if scale is not None else everything
    words = words.select("word", smoothed(F.col("word_target"), F.lit(float(mass)), F.lit(1.0 / max(size, 1))).alias("p_target"),
                         smoothed(background("word_target", "word_n"), F.lit(float(outside)), F.lit(1.0 / max(size, 1))).alias("p_background"))
    contexts = grams.groupBy("before").agg(F.sum("target").alias("before_target"), F.sum("n").alias("before_n"))
    model = (grams.join(words, "word").join(contexts, "before")
             .select("gram", F.log(smoothed(F.col("target"), F.col("before_target"), F.col("p_target"))).alias("target"),
                     F.log(smoothed(background("target", "n"), background("before_target", "before_n"), F.col("p_background"))).alias("background")))
    return written(model, "lm-model")


def _document_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs of every row with their counts; a row without words has one entry without a pair."""
    for batch in batches:
        for doc_id, row, value in zip(*batch.columns):
            gram, n = np.unique(pairs(value.as_py() or b"")[0], return_counts=True)
            some, size = len(gram) > 0, max(len(gram), 1)
            yield pa.RecordBatch.from_arrays(
                [pa.repeat(doc_id, size), pa.repeat(row, size), pa.array(gram.view(np.int64)) if some else pa.nulls(1, pa.int64()),
                 pa.array(n if some else np.zeros(1, np.int64))], ["doc_id", "row_no", "gram", "n"])


def score(docs: DataFrame, model: DataFrame) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss and score for every row of (doc_id, text).

    Losses are nats per word; ``score`` is target minus background, so lower is
    closer to the target. Null, empty or blank text: no tokens, null losses and
    score. Repeated rows get a row each; other columns are ignored. ``model``
    must have been trained on these rows too: pairs that it lacks count nothing.

    A row's pairs meet the model where they are while its counted rows fit a
    broadcast, so that only sums move; beyond that both are shuffled once by pair.
    """
    arrow_batches(docs.sparkSession)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row_no"), F.col("text").cast("binary").alias("text"))
    grams = slim.mapInArrow(_document_pairs, "doc_id long, row_no long, gram long, n long")
    out = (grams.join(checked_broadcast(model, GRAM_BYTES), "gram", "left").groupBy("row_no", "doc_id")
           .agg(F.sum("n").alias("n_tokens"), F.sum(F.col("n") * F.col("target")).alias("t"), F.sum(F.col("n") * F.col("background")).alias("b")))
    some = F.col("n_tokens") > 0
    return (out.select("doc_id", "n_tokens", F.when(some, -F.col("t") / F.col("n_tokens")).alias("target_loss"),
                       F.when(some, -F.col("b") / F.col("n_tokens")).alias("background_loss"))
            .withColumn("score", F.col("target_loss") - F.col("background_loss")))


def cross_entropy_difference(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Score all documents; the target are those that ``labels`` (doc_id, quality, toxic) call good and not toxic.

    Without any labelled document both models are equal up to the prior and
    scores say nothing about quality; an empty table gives an empty result.
    """
    good = labels.where((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)).select("doc_id")
    return score(docs, train(docs, good))

"""Language identification with error-correcting output codes."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symloom.llm.common import arrow_batches

BUCKETS = 1 << 14
PER_LANGUAGE = 8000
UNKNOWN = "und"
MARGIN = 0.02
_LETTER = re.compile(r"[^\W\d_]")
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:128] = [c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 else 32 for c in range(128)]


def gram_counts(text: bytes) -> np.ndarray:
    """Counts of hashed byte trigrams; A-Z lower-cased, other ASCII as blanks, runs of blanks as one."""
    folded = _FOLD[np.frombuffer(b" " + text + b" ", np.uint8)]
    blank = folded == 32
    folded = folded[np.concatenate(([True], ~(blank[1:] & blank[:-1])))]
    grams = folded.astype(np.uint32)
    if len(grams) < 3:
        return np.zeros(BUCKETS, np.int64)
    codes = (grams[:-2] << 16) | (grams[1:-1] << 8) | grams[2:]
    return np.bincount((codes * np.uint32(2654435761)) >> np.uint32(18), minlength=BUCKETS)


def has_letters(text: bytes | None) -> bool:
    return bool(text) and _LETTER.search(text.decode("utf-8", "replace")) is not None


def codewords(n: int) -> np.ndarray:
    """An (n, bits) matrix of +1 and -1 in which rows differ in many places, columns split the rows, and no two columns agree.

    Up to 6 languages: every split of the rows into two sides, once. More: bits
    of a fixed pseudo-random sequence, 16 per doubling, which keep about half
    of their places apart.
    """
    if n < 2:
        return np.ones((n, 1), np.int8)
    if n <= 6:
        splits = [[1] + [1 if s >> i & 1 else -1 for i in range(n - 1)] for s in range((1 << n - 1) - 1)]
        return np.array(splits, np.int8).T
    bits = 16 * int(np.ceil(np.log2(n)))
    draw = np.random.default_rng(20_231).integers(0, 2, (n, bits)).astype(np.int8) * 2 - 1
    return draw[:, np.abs(draw.sum(0)) < n]


@dataclass
class LanguageModel:
    """``languages`` with their ``codes``; ``weights``: log odds of each trigram bucket per bit; ``loss_weights`` per bit."""

    languages: list[str]
    codes: np.ndarray
    weights: np.ndarray
    loss_weights: np.ndarray

    def losses(self, counts: np.ndarray) -> np.ndarray:
        """Mean weighted logistic loss of every codeword against the bits' margins."""
        margins = counts @ self.weights / max(1, counts.sum())
        loss = np.logaddexp(0, -4.0 * self.codes * margins)
        return loss @ self.loss_weights / self.loss_weights.sum()

    def predict(self, text: bytes | None) -> tuple[str, float, bool]:
        """Language, score 0 to 1, and whether the runner-up is too close to tell."""
        if not self.languages or not has_letters(text):
            return UNKNOWN, 0.0, True
        losses = self.losses(gram_counts(text))
        order = np.argsort(losses, kind="stable")
        odds = np.exp(-8.0 * (losses - losses[order[0]]))
        score = float(1.0 / odds.sum())
        close = len(order) > 1 and losses[order[1]] - losses[order[0]] < MARGIN
        return self.languages[order[0]], score, bool(close)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            counts = gram_counts(text.as_py())
            if lang in sums:
                sums[lang] += counts
            else:
                sums[lang] = counts.astype(np.int64)
    for lang, counts in sums.items():
        at = counts.nonzero()[0]
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at, pa.int32()), pa.array(counts[at])], ["lang", "bucket", "n"])


def train(rows: DataFrame, per_language: int = PER_LANGUAGE) -> LanguageModel:
    """Fit on (doc_id, text, lang), all columns non-null.

    At most about ``per_language`` documents of each language are read (the
    documented bound of the sample), chosen by a hash of the id; languages
    with fewer are used whole. Tasks send one row per language and bucket, so
    the driver gets languages * 16384 sums, whatever the number of rows. Each
    bit's classifier is a naive Bayes over trigram buckets of the languages on
    its two sides, each language weighing the same.
    """
    arrow_batches(rows.sparkSession, megabytes=2)
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return LanguageModel([], codewords(0), np.zeros((BUCKETS, 1)), np.ones(1))
    share = F.lit(0.0)
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, per_language / n))).otherwise(share)
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("sample")), F.lit(1_000_000)) / 1e6
    chosen = rows.where(draw < share).select("lang", F.col("text").cast("binary").alias("text"))
    sums = chosen.mapInArrow(_summed, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros((len(languages), BUCKETS))
    at = {lang: i for i, lang in enumerate(languages)}
    for r in sums:
        counts[at[r["lang"]], r["bucket"]] = r["n"]
    shares = (counts + 0.5) / (counts + 0.5).sum(1, keepdims=True)
    codes = codewords(len(languages))
    weights = np.zeros((BUCKETS, codes.shape[1]))
    separation = np.ones(codes.shape[1])
    for b in range(codes.shape[1]):
        ones, others = codes[:, b] > 0, codes[:, b] < 0
        if ones.any() and others.any():
            weights[:, b] = np.log(shares[ones].mean(0)) - np.log(shares[others].mean(0))
            means = shares @ weights[:, b]
            # A bit counts by how far apart its two sides are on average.
            separation[b] = max(1e-3, means[ones].min() - means[others].max())
    return LanguageModel(languages, codes, weights, separation)


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred, score, ambiguous for every row of (doc_id, text); only the text is looked at.

    Null texts and texts without letters are ``und`` with score 0. Other
    columns are ignored, repeated rows get a row each, an empty table gives none.
    """
    spark = docs.sparkSession
    arrow_batches(spark, megabytes=2)
    shared = spark.sparkContext.broadcast((model.languages, model.codes, model.weights, model.loss_weights))

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = LanguageModel(*shared.value)
        for batch in batches:
            out = [own.predict(text.as_py()) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64()),
                 pa.array([x[2] for x in out], pa.bool_())], ["doc_id", "lang_pred", "score", "ambiguous"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return slim.mapInArrow(predicted, "doc_id long, lang_pred string, score double, ambiguous boolean")


def known_language(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """The rows of ``docs``, whole, whose text is in one of the languages and not ambiguous.

    Rows pass through the classifier one batch at a time and are never moved.
    Without a model (no labelled document) nothing can be told and nothing goes
    but what has no letters.
    """
    spark = docs.sparkSession
    arrow_batches(spark, megabytes=2)
    shared = spark.sparkContext.broadcast((model.languages, model.codes, model.weights, model.loss_weights))
    place = docs.columns.index("text")

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = LanguageModel(*shared.value)
        for batch in batches:
            keep = []
            for value in batch.column(place):
                text = value.as_py()
                raw = text.encode("utf-8", "surrogatepass") if text else None
                keep.append(has_letters(raw) and not (own.languages and own.predict(raw)[2]))
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(passed, docs.schema)


def held_out(doc_id: str = "doc_id"):
    """A quarter of the documents, by CRC-32 of the id's digits, is never learned from."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def learned_rows(docs: DataFrame) -> DataFrame:
    return docs.where(~held_out() & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull()
                      ).select("doc_id", "text", "lang")


def language_id(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """Train on the labelled documents that are not held out, then predict every document.

    Returns doc_id, held_out, lang_pred, score, ambiguous. Without any
    labelled document everything is ``und``.
    """
    model = train(learned_rows(docs), per_language)
    return identify(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "ambiguous")

"""Quality rules per document and per host."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symloom.llm.common import arrow_batches, written

SYMBOLS = "#*$%&|<>"
FEWEST_WORDS = 50
MOST_REPEATED = 50  # percent of words in repeated windows
WINDOW = 3
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window of ``window`` words found twice or more."""
    windows = list(zip(*(words[i:] for i in range(window))))
    if len(set(windows)) == len(windows):
        return 0
    counts = Counter(windows)
    hits = np.fromiter((counts[w] > 1 for w in windows), bool, len(windows))
    covered = np.zeros(len(words), bool)
    for i in range(window):
        covered[i:i + len(windows)] |= hits
    return int(covered.sum())


def measure(text: bytes | None) -> tuple[int, int, int, int, int]:
    """The five measures of a UTF-8 text; a null text has none of anything."""
    if not text:
        return 0, 0, 0, 0, 0
    words = text.split()
    joined = b"".join(words)
    code_points = len(joined) - int(np.count_nonzero((np.frombuffer(joined, np.uint8) & 0xC0) == 0x80))
    symbols = len(text) - len(text.translate(None, SYMBOLS.encode()))
    lines = [line for line in text.split(b"\n") if line.split()] if b"\n" in text else []
    return len(words), code_points, symbols, len(lines) - len(set(lines)), repeated_words(words)


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [measure(text.as_py()) for text in batch.column(2)]
        columns = [pa.array(c, pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * len(MEASURES)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["doc_id", "host", *MEASURES])


def document_measures(docs: DataFrame, host_col: str = "source") -> DataFrame:
    """doc_id, host and the five measures of every whole text."""
    arrow_batches(docs.sparkSession)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(host_col).cast("string").alias("host"),
                       F.col("text").cast("binary").alias("text"))
    return slim.mapInArrow(_measured, "doc_id long, host string, " + ", ".join(f"{m} long" for m in MEASURES))


def host_rates(rows: DataFrame) -> DataFrame:
    """(host, failed) rows to host, docs, failures, ``rate``: failures shrunk by an empirical beta prior.

    The prior is fitted by moments over all hosts: mean m of all rows, and
    between-host variance as the spread of host rates beyond what binomial
    noise explains. Its strength a + b tells how many documents of its own
    outweigh what other hosts look like; with no spread left all hosts get m.
    """
    hosts = rows.groupBy("host").agg(F.count("*").alias("docs"), F.sum(F.col("failed").cast("long")).alias("failures"))
    sums = hosts.agg(F.sum("docs").alias("n"), F.sum("failures").alias("f"), F.sum(F.pow("docs", F.lit(2.0))).alias("n2"),
                     F.count("*").alias("k"), F.sum(F.pow("failures", F.lit(2.0)) / F.col("docs")).alias("f2")).first()
    n, f, k = float(sums["n"] or 0), float(sums["f"] or 0), sums["k"]
    if not n:
        return hosts.withColumn("rate", F.lit(None).cast("double"))
    mean = f / n
    noise = mean * (1 - mean)
    between = sums["f2"] - n * mean * mean  # sum of docs * (rate - mean)^2
    scale = n - sums["n2"] / n
    spread = max(0.0, (between - (k - 1) * noise) / scale) if scale > 0 else 0.0
    strength = noise / spread - 1 if spread > 0 else None
    if strength is None:
        rate = F.lit(mean)
    else:
        strength = max(strength, 1e-9)
        rate = (F.col("failures") + mean * strength) / (F.col("docs") + strength)
    return hosts.withColumn("rate", rate.cast("double"))


def host_rules(docs: DataFrame, host_col: str = "source", fewest_words: int = FEWEST_WORDS,
               most_repeated: int = MOST_REPEATED, host_limit: float = 0.5) -> DataFrame:
    """One row per document: its measures, base_failed, kept, and what its host looks like.

    A document fails the base rules with fewer than ``fewest_words`` words or
    more than ``most_repeated`` percent of them in repeated windows. A host
    fails when its failure rate, shrunk towards all hosts, is above
    ``host_limit``: then all its documents go, and else those that fail
    themselves. Rates need one row per host, made by partial sums in every
    task; the measures are written once, so texts are read once and never moved.

    Null text: no words, so it fails. Null host: no host evidence, judged on
    its own. Rows that repeat: each counts and gets a row. Empty table: empty
    result. Columns besides doc_id, text and the host are not looked at.
    """
    measured = written(document_measures(docs, host_col), "quality-measures")
    failed = (F.col("n_words") < fewest_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    rows = measured.withColumn("base_failed", failed)
    rates = written(host_rates(rows.where("host IS NOT NULL").select("host", F.col("base_failed").alias("failed"))), "quality-hosts")
    out = rows.join(rates, "host", "left")
    host_kept = F.coalesce(F.col("rate") <= host_limit, F.lit(True))
    return out.select("doc_id", *MEASURES, "base_failed", (~F.col("base_failed") & host_kept).alias("kept"), "host",
                      F.coalesce("docs", F.lit(0)).cast("long").alias("host_docs"),
                      F.coalesce("failures", F.lit(0)).cast("long").alias("host_failures"), host_kept.alias("host_kept"))


ORACLE = f"""
WITH w AS (SELECT doc_id, source AS host, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
g AS (SELECT doc_id, host, text, words, CASE WHEN len(words) < 3 THEN [] ELSE list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]) END AS wins FROM w),
u AS (SELECT doc_id, unnest(wins) AS win, generate_subscripts(wins, 1) AS i FROM g),
h AS (SELECT doc_id, i FROM u QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1),
r AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM h, (SELECT unnest([0, 1, 2]) AS o) GROUP BY doc_id),
l AS (SELECT doc_id, sum(c - 1) AS n FROM (SELECT doc_id, line, count(*) AS c FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w)
      WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id, line) GROUP BY doc_id),
m AS (SELECT w.doc_id, host, CAST(len(words) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
      CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
      CAST(coalesce(l.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN l USING (doc_id) LEFT JOIN r USING (doc_id)),
b AS (SELECT *, n_words < {FEWEST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed FROM m),
t AS (SELECT host, count(*) AS docs, CAST(sum(CAST(base_failed AS INT)) AS BIGINT) AS failures FROM b WHERE host IS NOT NULL GROUP BY host),
s AS (SELECT CAST(sum(docs) AS DOUBLE) AS n, sum(failures) / CAST(sum(docs) AS DOUBLE) AS p, count(*) AS k, sum(CAST(docs AS DOUBLE) * docs) AS n2,
      sum(CAST(failures AS DOUBLE) * failures / docs) AS f2 FROM t),
v AS (SELECT p, p * (1 - p) AS noise, CASE WHEN n - n2 / n > 0 THEN greatest(0, (f2 - n * p * p - (k - 1) * p * (1 - p)) / (n - n2 / n)) ELSE 0 END AS spread FROM s),
x AS (SELECT host, docs, failures, CASE WHEN spread > 0 THEN (failures + p * greatest(noise / spread - 1, 1e-9)) / (docs + greatest(noise / spread - 1, 1e-9)) ELSE p END AS rate FROM t, v)
SELECT b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(rate <= 0.5, true) AS kept, b.host,
       coalesce(docs, 0) AS host_docs, coalesce(failures, 0) AS host_failures, coalesce(rate <= 0.5, true) AS host_kept
FROM b LEFT JOIN x ON b.host = x.host
"""

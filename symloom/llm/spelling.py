"""Spelling variants: words one edit apart, found by search schemes on FM-indexes.

If two words differ by one inserted, deleted or replaced code point, one of the
two halves of either is untouched: the other word begins with the first half or
ends with the second. So a word is searched twice: its first half exactly and
then to the right across the second with at most one error, and its second half
exactly and then to the left across the first. Both go along suffix-rank
intervals of a vocabulary whose words are closed by delimiters; since whole
words are wanted, a search starts at a delimiter. The two directions are two
indexes, of the words and of the words reversed.

The vocabulary is dealt to shards by the halves that a search matches exactly,
so a word meets all its candidates in one shard of each direction. Halves that
many words share are cut into several shards, which their searches all visit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symloom.llm.common import arrow_limits, ascii_lower, checked_broadcast, written

RUN = "[A-Za-z\\u00C0-\\u00FF]+"
EVERY = 97  # of so many runs, one in the mean loses a letter
SHORTEST, LEAST = 5, 3
RATIO = 2
SYMBOLS = 200_000  # symbols of a shard, about
HOT = 8_000  # words that share a half, from which on it is cut
CHUNK = 4_096  # words searched together

FOUND = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("form", pa.string()), ("form_n", pa.int64())])
FOUND_DDL = "word string, n_near long, form string, form_n long"


# Words

def spelled(text: Column, doc_id: Column, every: int = EVERY) -> Column:
    """The runs of letters of a text, A-Z lower-cased; where ``every`` divides the run's hash, one code point is left out."""
    runs = F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(RUN), F.lit(0))

    def one(run: Column) -> Column:
        h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), run).cast("binary"))
        at = F.pmod(h, F.length(run)).cast("int")
        cut = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))
        return F.when(h % every == 0, cut).otherwise(run)

    return F.transform(runs, one)


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = SHORTEST, least: int = LEAST) -> DataFrame:
    """(word, n): the distinct spelled words of ``shortest`` code points or more that occur ``least`` times or more."""
    words = docs.select(F.explode(spelled(F.col(text_col), F.col(id_col))).alias("word"))
    return words.where(F.length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


# Index

class FMIndex:
    """Suffix ranks of words written one after the other, each closed by a delimiter, read from their beginnings to the right.

    The indexed text is the reversed words, so a step that puts a symbol in
    front of a pattern of the text extends a word's beginning to the right.
    ``ranks`` holds symbol * length + place for every place of the
    Burrows-Wheeler column, sorted: one binary search is the whole step.
    """

    def __init__(self, words: list[str]):
        # Every code point is a symbol; the delimiter, 0, stands for none.
        points = [np.frombuffer(w[::-1].encode("utf-32-le"), dtype=np.uint32) for w in words]
        lengths = np.fromiter(map(len, points), dtype=np.int64, count=len(points))
        self.letters = np.unique(np.concatenate(points)) if points else np.empty(0, dtype=np.uint32)
        starts = np.concatenate([[0], np.cumsum(lengths + 1)])
        text = np.zeros(int(starts[-1]) + 1, dtype=np.int64)
        for at, p in zip(starts[:-1], points, strict=True):
            text[at + 1:at + 1 + len(p)] = np.searchsorted(self.letters, p) + 1
        size = self.size = len(text)
        order = _suffix_order(text, int(lengths.max(initial=0)) + 2)
        self.last = text[order - 1]  # the column: what stands in front of each suffix, cyclic
        self.ranks = np.sort(self.last * size + np.arange(size))
        # A row of the final interval begins with the delimiter in front of a word.
        self.word_of = np.searchsorted(starts, order)
        self.n = len(words)

    def codes(self, word: str) -> np.ndarray:
        """Symbols of a word; -1 for letters that the index does not have."""
        points = np.frombuffer(word.encode("utf-32-le"), dtype=np.uint32)
        at = np.searchsorted(self.letters, points)
        there = at < len(self.letters)
        there[there] = self.letters[at[there]] == points[there]
        return np.where(there, at + 1, -1)

    def step(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the patterns with ``symbol`` added; empty for symbol -1."""
        base = symbol * self.size
        return np.searchsorted(self.ranks, base + low), np.searchsorted(self.ranks, base + high)

    def branches(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All (state, letter) such that the letter follows in the state's interval, delimiter left out."""
        width = high - low
        narrow = np.flatnonzero(width <= len(self.letters))
        wide = np.flatnonzero(width > len(self.letters))
        total = int(width[narrow].sum())
        state = np.repeat(narrow, width[narrow])
        offset = np.arange(total) - np.repeat(np.cumsum(width[narrow]) - width[narrow], width[narrow])
        key = np.unique(state * (len(self.letters) + 1) + self.last[low[state] + offset])
        state, letter = key // (len(self.letters) + 1), key % (len(self.letters) + 1)
        seen = letter > 0
        every = np.arange(1, len(self.letters) + 1)
        return (np.concatenate([state[seen], np.repeat(wide, len(every))]), np.concatenate([letter[seen], np.tile(every, len(wide))]))

    def near(self, patterns: list[np.ndarray], halves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pattern, word): all indexed words that begin with the pattern's first ``halves`` symbols and are one edit from it."""
        lengths = np.fromiter(map(len, patterns), dtype=np.int64, count=len(patterns))
        table = np.full((len(patterns), int(lengths.max()) + 1), -1, dtype=np.int64)
        for i, p in enumerate(patterns):
            table[i, :len(p)] = p
        query = np.arange(len(patterns))
        low, high = np.zeros(len(query), dtype=np.int64), np.full(len(query), self.n + 1, dtype=np.int64)
        low, high = self.step(np.zeros(len(query), dtype=np.int64), np.zeros(len(query), dtype=np.int64), np.full(len(query), self.size))
        at = np.zeros(len(query), dtype=np.int64)
        failed: list[tuple[np.ndarray, ...]] = []  # states with their error behind them
        while len(query):
            free = np.flatnonzero(at >= halves[query])
            if len(free):
                q, j, lo, hi = query[free], at[free], low[free], high[free]
                inside = j < lengths[q]
                failed.append((q[inside], j[inside] + 1, lo[inside], hi[inside]))  # a symbol of the pattern left out
                state, letter = self.branches(lo, hi)
                lo, hi = self.step(letter, lo[state], hi[state])
                q, j, there = q[state], j[state], hi > lo
                failed.append((q[there], j[there], lo[there], hi[there]))  # a letter put in
                other = there & (j < lengths[q]) & (letter != table[q, j])
                failed.append((q[other], j[other] + 1, lo[other], hi[other]))  # a letter replaced
            on = np.flatnonzero(at < lengths[query])
            query, at, low, high = query[on], at[on], low[on], high[on]
            low, high = self.step(table[query, at], low, high)
            on = np.flatnonzero(high > low)
            query, at, low, high = query[on], at[on] + 1, low[on], high[on]
        query, at, low, high = (np.concatenate(x) for x in zip(*failed, strict=True)) if failed else (query, at, low, high)
        hits_q, hits_w = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)]
        while len(query):
            done = at == lengths[query]
            lo, hi = self.step(np.zeros(int(done.sum()), dtype=np.int64), low[done], high[done])
            whole = hi > lo
            # Words are distinct, so an interval closed on both sides holds one.
            hits_q.append(query[done][whole])
            hits_w.append(self.word_of[lo[whole]])
            on = ~done
            query, at = query[on], at[on]
            low, high = self.step(table[query, at], low[on], high[on])
            on = high > low
            query, at, low, high = query[on], at[on] + 1, low[on], high[on]
        key = np.unique(np.concatenate(hits_q) * (self.n + 1) + np.concatenate(hits_w))
        return key // (self.n + 1), key % (self.n + 1)


def _suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Places of the suffixes in order of their first ``depth`` symbols at least, by doubling."""
    size = len(text)
    rank, known = text.copy(), 1
    order = np.argsort(rank, kind="stable")
    while known < depth:
        behind = np.full(size, -1, dtype=np.int64)
        behind[:size - known] = rank[known:]
        key = rank * (size + 1) + behind + 1
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        rank = np.empty(size, dtype=np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        known *= 2
        if rank[order[-1]] == size - 1:
            break
    return order


# Shards

def shard_rows(words: DataFrame, symbols: int = SYMBOLS, hot: int = HOT) -> DataFrame:
    """(side, shard, word, n, size, asks): every word as a question to, and as a target in, the shards of its halves.

    On side 0 words stand as they are, on side 1 reversed. A question of m code
    points asks with its first m // 2 (m - m // 2 on side 1); a target, one
    code point shorter, as long, or one longer, is listed under each half that
    such a question may ask with. Halves under which more than ``hot`` words
    are listed are cut by a hash of the word, and their questions go to each cut.
    """
    m = F.length("word")
    halves = [F.array_distinct(F.array(*[F.floor((m + d) / 2) for d in (-1, 0, 1)])),
              F.array_distinct(F.array(*[F.ceil((m + d) / 2) for d in (-1, 0, 1)]))]
    own = [F.floor(m / 2), F.ceil(m / 2)]
    sides = []
    for side in (0, 1):
        base = words.select(F.lit(side).alias("side"), (F.reverse("word") if side else F.col("word")).alias("word"), "n")
        # On both sides a half is the beginning of what stands there.
        target = base.withColumn("size", F.explode(halves[side])).withColumn("asks", F.lit(False))
        question = base.withColumn("size", own[side]).withColumn("asks", F.lit(True))
        sides += [target, question]
    rows = sides[0]
    for other in sides[1:]:
        rows = rows.unionByName(other)
    rows = rows.withColumn("half", F.xxhash64("side", F.substring(F.col("word"), F.lit(1), F.col("size").cast("int"))))
    crowded = (rows.where("NOT asks").groupBy("half").agg(F.count("*").alias("words")).where(F.col("words") > hot)
               .withColumn("cuts", F.ceil(F.col("words") / hot).cast("int")).drop("words"))
    crowded = checked_broadcast(written(crowded, "spelling-crowded"), 32)
    rows = rows.join(crowded, "half", "left").withColumn("cuts", F.coalesce("cuts", F.lit(1)))
    mine = F.array(F.pmod(F.xxhash64("word"), F.col("cuts")).cast("int"))
    rows = rows.withColumn("cut", F.explode(F.when(F.col("asks"), F.sequence(F.lit(0), F.col("cuts") - 1)).otherwise(mine)))
    size = words.agg(F.sum(F.length("word") + 1)).first()[0] or 0
    shards = max(1, -(-4 * size // (2 * symbols)))  # each side lists a word under two halves
    return rows.select("side", F.pmod(F.xxhash64("half", "cut"), F.lit(shards)).cast("int").alias("shard"), "word", "n",
                       F.col("size").cast("int").alias("size"), "asks")


def search_shard(table: pa.Table) -> pa.Table:
    """Of one shard: each asking word's near words that begin with its half, as their number and the best of them.

    A word listed under halves of two lengths may stand in two shards, and the
    question too: it counts where it is listed under a half as long as the
    question's, which is one shard only. On side 1 a word that also begins (unreversed) with the question's first
    half was found on side 0 and is left out.
    """
    side = table.column("side")[0].as_py()
    asks = np.array(table.column("asks").to_pylist(), dtype=bool)
    words, counts, sizes = (table.column(c).to_pylist() for c in ("word", "n", "size"))
    listed = {w: n for w, n, a in zip(words, counts, asks, strict=True) if not a}
    under = {(w, s) for w, s, a in zip(words, sizes, asks, strict=True) if not a}
    targets = list(listed)
    questions = list({w for w, a in zip(words, asks, strict=True) if a})
    out: list[tuple] = []
    if targets and questions:
        index = FMIndex(targets)
        for at in range(0, len(questions), CHUNK):
            part = questions[at:at + CHUNK]
            halves = [len(w) - len(w) // 2 if side else len(w) // 2 for w in part]
            found: dict[int, tuple] = {}
            for q, t in zip(*(x.tolist() for x in index.near([index.codes(w) for w in part], np.array(halves))), strict=True):
                word = targets[t]
                if (word, halves[q]) not in under or side and word[::-1].startswith(part[q][::-1][:len(part[q]) // 2]):
                    continue
                n, best = found.get(q, (0, None))
                here = (-listed[word], word[::-1] if side else word)
                found[q] = (n + 1, here if best is None or here < best else best)
            out += [(part[q][::-1] if side else part[q], n, best[1], -best[0]) for q, (n, best) in found.items()]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else [[]] * 4, FOUND, strict=True)], schema=FOUND)


def near_words(words: DataFrame, symbols: int = SYMBOLS, hot: int = HOT) -> DataFrame:
    """(word, n_near, form, form_n) of the words with near words; form: the near word of largest n, then smallest. No pair leaves its shard."""
    rows = shard_rows(words, symbols, hot)
    found = rows.groupBy("side", "shard").applyInArrow(search_shard, FOUND_DDL)
    best = F.min(F.struct((-F.col("form_n")).alias("n"), "form"))
    return (found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best"))
            .select("word", "n_near", F.col("best.form").alias("form"), (-F.col("best.n")).alias("form_n")))


def with_roots(forms: DataFrame) -> DataFrame:
    """Add ``root`` to (word, form): the last word along the forms, by pointer doubling; chains double n at each step, so few rounds do."""
    steps = written(forms.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "spelling-steps")
    while True:
        further = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        steps = written(steps.join(further, "root", "left")
                        .select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-steps")
        if steps.where("moved").isEmpty():
            break
        steps = steps.drop("moved")
    return forms.join(steps.select("word", "root"), "word", "left").withColumn("root", F.coalesce("root", "word"))


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ratio: int = RATIO,
             symbols: int = SYMBOLS, hot: int = HOT) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the texts.

    Null text: no runs. Null id: hashed as the word null. Rows that repeat an
    id are separate texts. Of near words with the same n the smallest is the
    form. A text or word of any length is read whole. Empty table, or no word
    that is long and frequent enough: empty result. Other columns are not
    looked at.
    """
    words = written(vocabulary(docs, id_col, text_col), "spelling-words")
    with arrow_limits(docs.sparkSession, 100_000, 32):
        near = written(near_words(words, symbols, hot), "spelling-near")
    strong = F.col("form_n") >= ratio * F.col("n")
    judged = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(strong, F.col("form")).alias("form"), F.when(strong, F.col("form_n")).alias("form_n"))
    return with_roots(written(judged, "spelling-forms")).select("word", "form", "root", "n", "n_near", "form_n")

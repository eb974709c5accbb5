"""SentencePiece encoding and decoding with N-best segmentation."""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import chain, count
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symloom.llm.common import arrow_batches

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BEST = 4
BLANK = "▁"
# Stands for a blank mark that is part of the text; no valid text holds a lone surrogate.
LITERAL = "\ud800"
UNIT = 1 << 20  # scores are integers in this unit, so that sums are exact
NEVER = 1 << 62
CACHED = 150_000
LONGEST_CACHED = 32
SEARCHED = 10_000
# A word starts where a run of blanks starts; no piece crosses such a place.
_WORD = re.compile(f"{BLANK}+[^{BLANK}]*|[^{BLANK}]+")


def cut_pattern(pieces: Iterable[str]) -> re.Pattern:
    """What to encode on its own: words, or runs of letters and of other characters if no piece joins the two."""
    odd = re.escape("".join(sorted({c for p in pieces for c in p if c.isalnum() and not c.isalpha()})))
    runs = re.compile(f"{BLANK}*(?:[^\\W\\d_{odd}]+|(?:[^\\w{BLANK}]|[\\d_{odd}])+)|{BLANK}+")
    return runs if all(len(runs.findall(p)) == 1 for p in pieces) else _WORD


@dataclass
class Vocabulary:
    """Pieces with id and score, ids and score of the 256 byte pieces, where texts fall apart, and a finder of all pieces in a text."""

    pieces: dict[str, tuple[int, int]]
    byte_ids: list[int]
    byte_score: int
    cuts: re.Pattern = _WORD
    finder: ahocorasick.Automaton | None = None
    single: frozenset[str] = frozenset()

    def __post_init__(self) -> None:
        self.finder = ahocorasick.Automaton()
        for piece, (i, score) in self.pieces.items():
            self.finder.add_word(piece, (len(piece), score, (i,)))
        self.finder.make_automaton()
        self.single = frozenset(p for p in self.pieces if len(p) == 1)
        self.cuts = cut_pattern(self.pieces)


def read_vocabulary(path: str = MODEL) -> Vocabulary:
    """Read a SentencePiece model file on the driver.

    The file ranks its pieces. Scores are -log(2 + rank), so that a path's score
    is the log probability of its pieces under Zipf's law. The byte pieces
    rank last.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, byte_ids, rank = {}, [0] * 256, 0
    for i in range(model.get_piece_size()):
        if model.is_byte(i):
            byte_ids[int(model.id_to_piece(i)[3:5], 16)] = i
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            pieces[model.id_to_piece(i)] = (i, -round(UNIT * math.log(2 + rank)))
            rank += 1
    if any(BLANK in p.lstrip(BLANK) for p in pieces):
        raise ValueError("a piece of this vocabulary crosses the start of a word")
    return Vocabulary(pieces, byte_ids, -round(UNIT * math.log(2 + rank)))


_SCORE, _IDS, _GAP = itemgetter(0), itemgetter(1), itemgetter(2)
Path = tuple[int, tuple[int, ...]]
Edge = tuple[int, int, tuple[int, ...]]


def byte_edges(character: str, vocab: Vocabulary, start: int = 0) -> list[Edge]:
    """The edge of a character as its bytes."""
    raw = (BLANK if character == LITERAL else character).encode("utf-8", "surrogatepass")
    return [(start, vocab.byte_score * len(raw), tuple(vocab.byte_ids[b] for b in raw))]


def lattice(segment: str, vocab: Vocabulary) -> list[list[Edge]]:
    """Edges by end: (start, score, ids). A character that is not a piece by itself is also its bytes."""
    edges: list[list[Edge]] = [[] for _ in range(len(segment) + 1)]
    for end, (size, score, ids) in vocab.finder.iter(segment):
        edges[end + 1].append((end + 1 - size, score, ids))
    for start, character in enumerate(segment):
        if character not in vocab.single:
            edges[start + 1] += byte_edges(character, vocab, start)
    return edges


def forward(edges: list[list[Edge]]) -> list[int]:
    """Viterbi: the best score of reaching every place."""
    ahead = [0] * len(edges)
    for end in range(1, len(edges)):
        ahead[end] = max((ahead[start] + score for start, score, _ in edges[end]), default=-NEVER)
    return ahead


def n_best(segment: str, vocab: Vocabulary, n: int) -> list[Path]:
    """The ``n`` best segmentations, best first.

    Forward: Viterbi gives every place the best score of reaching it. Backward:
    A* from the end, in which a partial path's promise is its own score plus
    that Viterbi score, the exact best completion, so only places on wanted
    paths are opened and finished paths come out in order.
    """
    edges = lattice(segment, vocab)
    ahead = forward(edges)
    found: list[Path] = []
    serial = count()  # settles ties; behind it, every entry has its last edge's ids and the entry's own rest
    agenda: list[tuple] = [(-ahead[-1], len(segment), 0, 0, None)]
    while agenda and len(found) < n:
        _, place, _, score, path = heapq.heappop(agenda)
        if place == 0:
            ids: list[int] = []
            while path:
                own, path = path
                ids += own
            found.append((score, tuple(ids)))
            continue
        for start, gain, own in edges[place]:
            heapq.heappush(agenda, (-(ahead[start] + gain + score), start, -next(serial), gain + score, (own, path)))
    return found


def best_and_gap(segment: str, vocab: Vocabulary) -> tuple[int, tuple[int, ...], int]:
    """Score and ids of the best segmentation, and how much worse the second best is: Viterbi with the two best scores per place."""
    if not segment:
        return 0, (), NEVER
    size = len(segment)
    # By end, counted from 0; what lies before the segment is the entry behind the last, at -1.
    best, second, back = [-NEVER] * size + [0], [-NEVER] * (size + 1), [None] * size
    if vocab.single.issuperset(segment):
        found = vocab.finder.iter(segment)  # by end, so a place is settled before an edge leaves it
    else:
        found = ((end - 1, (end - start, gain, ids)) for end, into in enumerate(lattice(segment, vocab)) for start, gain, ids in into)
    for end, edge in found:
        length, gain, _ = edge
        score = best[end - length] + gain
        if score > (top := best[end]):
            other = second[end - length] + gain
            second[end] = other if other > top else top
            best[end], back[end] = score, edge
        elif score > second[end]:
            second[end] = score
    taken, place = [], size - 1
    while place >= 0:
        length, _, own = back[place]
        taken.append(own)
        place -= length
    return best[-2], tuple(chain.from_iterable(reversed(taken))), best[-2] - second[-2] if second[-2] > -NEVER // 2 else NEVER


@dataclass
class Encoder:
    """Encodes texts; keeps what it found for short words, for twice ``CACHED`` of them at most, and forgets those not met for long.

    Words that are often among the closest calls keep their further segmentations as well, ``SEARCHED`` of them at most.
    """

    vocab: Vocabulary
    best: int = BEST
    known: dict[str, tuple[int, tuple[int, ...], int]] = field(default_factory=dict)
    older: dict[str, tuple[int, tuple[int, ...], int]] = field(default_factory=dict)
    searched: dict[str, list[Path]] = field(default_factory=dict)

    def word(self, word: str) -> tuple[int, tuple[int, ...], int]:
        """Score, ids and gap of a word that is not in ``known``."""
        found = self.older.get(word) or best_and_gap(word, self.vocab)
        if len(word) <= LONGEST_CACHED:
            if len(self.known) >= CACHED:
                self.older = self.known.copy()
                self.known.clear()
            self.known[word] = found
        return found

    def choices(self, word: str) -> list[Path]:
        """The N best segmentations of a word, the one that ``word`` gives first."""
        if (paths := self.searched.get(word)) is None:
            score, ids, _ = self.known.get(word) or self.word(word)
            paths = [(score, ids), *(p for p in n_best(word, self.vocab, self.best) if p[1] != ids)][:self.best]
            if len(word) <= LONGEST_CACHED:
                if len(self.searched) >= SEARCHED:
                    self.searched.clear()
                self.searched[word] = paths
        return paths

    def encode(self, text: str) -> tuple[list[int], list[int], list[list[tuple[int, int]]]]:
        """Ids of the best path, scores of the N best, and for each of these its (word, choice) pairs that differ from the best.

        Words share no pieces, so the N best paths of the text are the N best
        sums of one choice per word. The N - 1 words with the smallest gaps
        already give N - 1 further paths by one change each, so no other word
        departs from its best choice, and only these are searched for more.
        """
        if not text:
            return [], [0], [[]]
        words = self.vocab.cuts.findall(BLANK + text.replace(BLANK, LITERAL).replace(" ", BLANK))
        found = list(map(self.known.get, words))
        if None in found:
            for i in [i for i, x in enumerate(found) if x is None]:
                found[i] = self.known.get(words[i]) or self.word(words[i])
        total, ids, gaps = sum(map(_SCORE, found)), list(chain.from_iterable(map(_IDS, found))), list(map(_GAP, found))
        kept: list[tuple[int, list[tuple[int, int]]]] = [(0, [])]
        for _ in range(min(self.best - 1, len(words))):
            i = gaps.index(min(gaps))
            gaps[i] = NEVER + 1
            paths = self.choices(words[i])
            sums = [(loss + paths[0][0] - s, [*path, (i, c)] if c else path) for c, (s, _) in enumerate(paths) for loss, path in kept]
            kept = heapq.nsmallest(self.best, sums, key=_SCORE)
        return ids, [total - loss for loss, _ in kept], [path for _, path in kept]


def piece_bytes(vocab: Vocabulary) -> list[bytes]:
    """What each piece id stands for: blank marks are blanks, byte pieces their bytes."""
    out = [b""] * (1 + max([i for i, _ in vocab.pieces.values()] + vocab.byte_ids))
    for piece, (i, _) in vocab.pieces.items():
        out[i] = piece.replace(BLANK, " ").encode()
    for byte, i in enumerate(vocab.byte_ids):
        out[i] = bytes((byte,))
    return out


def decode(ids: list[int], of_id: list[bytes]) -> str:
    """The text of piece ids, without the blank that encoding puts in front."""
    return b"".join(map(of_id.__getitem__, ids)).decode("utf-8", "surrogatepass").removeprefix(" ")


def encode_documents(docs: DataFrame, vocab: Vocabulary | None = None, best: int = BEST) -> DataFrame:
    """doc_id, ids, scores, alternatives, and whether decoding the ids gives back the text, for every whole text.

    ``scores`` are those of the ``best`` best segmentations, best first;
    ``alternatives`` describes each by the words in which it departs from the best
    one. Null text: null ids and scores. Empty text: no ids, one
    score of 0. Shorter lattices have fewer paths than asked for. Rows that
    repeat get a row each, an empty table gives none, other columns are ignored.
    """
    spark: SparkSession = docs.sparkSession
    arrow_batches(spark, megabytes=1)
    vocab = vocab or read_vocabulary()
    shared = spark.sparkContext.broadcast((vocab.pieces, vocab.byte_ids, vocab.byte_score))
    alternatives = pa.list_(pa.list_(pa.struct([("word", pa.int32()), ("choice", pa.int32())])))

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Vocabulary(*shared.value)
        encoder = Encoder(own, best)
        of_id = piece_bytes(own)
        for batch in batches:
            ids, scores, ways, same = [], [], [], []
            for value in batch.column(1):
                text = value.as_py()
                if text is None:
                    row = None, None, None, None
                else:
                    out, sums, paths = encoder.encode(text)
                    row = (np.array(out, np.int32), [x / UNIT for x in sums], [[{"word": s, "choice": c} for s, c in p] for p in paths],
                           decode(out, of_id) == text)
                for column, x in zip((ids, scores, ways, same), row):
                    column.append(x)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(scores, pa.list_(pa.float64())),
                 pa.array(ways, alternatives), pa.array(same, pa.bool_())], ["doc_id", "ids", "scores", "alternatives", "round_trip"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        encoded, "doc_id long, ids array<int>, scores array<double>, alternatives array<array<struct<word: int, choice: int>>>, round_trip boolean")

"""Small sources in the mixture, personal values of more formats, words without end."""

import re
import time

import pytest

from symloom.llm import mixing, pieces, pii


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_small_source_meets_its_target(spark):
    sizes = {"a": 2_000_000, "b": 2_000_000, "c": 2_000_000, "tiny": 25}
    docs = spark.createDataFrame([(i * 10 + j, s, n // 5) for i, (s, n) in enumerate(sizes.items()) for j in range(5)], "doc_id long, source string, n long")
    rows = mixing.mix(docs.withColumn("text", docs.n.cast("string")), size=docs.n).collect()
    taken = {s: sum(r.taken for r in rows if r.source == s) for s in sizes}
    assert taken["tiny"] == 75
    for r in rows:
        assert abs(taken[r.source] - r.target) <= r.size


def test_many_sources(spark):
    docs = spark.range(30_000).selectExpr("id AS doc_id", "repeat('w ', 2 + cast(id % 40 AS int)) AS text", "concat('h', id) AS source")
    rows = mixing.mix(docs).where("size > 0").selectExpr("count(*) AS n", "count_if(repeats = 0 AND target > size) AS lost",
                                                        "max(abs(taken - target) / size) AS off").first()
    # A source of one document can only be taken whole; it then is as near as whole documents come.
    assert rows.n == 30_000 and rows.lost == 0 and rows.off <= 0.52


@pytest.mark.parametrize("text,value", [
    ("ES91 2100 0418 4502 0005 1332 BIC", "2100 0418"), ("ES9121000418450200051332 EUR", "ES9121000418450200051332"),
    ("AT611904300234573201 500", "AT611904300234573201"), ("at 2024-01-15T10:00 sharp", "2024-01-15"), ("ring +44 20 7946 0958 now", "7946 0958"),
    ("ring +33 1 23 45 67 89.", "23 45 67 89"), ("ring +442079460958", "+442079460958"), ("x/4417744280351547", "4417744280351547"),
    ("иван@пример.рф", "иван"), ("γιώργος@mail.gr", "γιώργος"), ("http://10.20.30.40/x", "10.20.30.40")])
def test_valid_values_go(spark, text, value):
    row = pii.pseudonymized(docs_of(spark, [(1, text, "s")])).first()
    assert row.n_found == 1 and value not in row.text
    assert re.sub(r"\w+", "x", row.text) == re.sub(r"\w+", "x", text)


def test_invalid_values_stay(spark):
    kept = ["1/2/03/04/1999", "2024-01-15x", "..@mail.example", "+1 2 3", "ES91 2100 0418 4502 0005 1333 BIC", "ES9121000418450200051333", ""]
    rows = pii.pseudonymized(docs_of(spark, [(i, t, "s") for i, t in enumerate(kept)])).collect()
    assert {r.doc_id: (r.text, r.n_found) for r in rows} == {i: (t, 0) for i, t in enumerate(kept)}


def test_pseudonyms_of_empty_repeated_and_long(spark):
    assert pii.pseudonymized(docs_of(spark, [])).count() == 0
    long = "see 10.20.30.40 and more words " * 20_000
    rows = pii.pseudonymized(docs_of(spark, [(1, long, "s"), (1, "at 10.20.30.40", "s"), (1, "at 10.20.30.40", "s")])).collect()
    assert sorted(r.n_found for r in rows) == [1, 1, 20_000]
    new = {re.search(r"[0-9.]{7,}", r.text)[0] for r in rows}
    assert len(new) == 1 and "10.20.30.40" not in new


def test_long_words_take_linear_time():
    vocab = pieces.read_vocabulary()
    encoder, of_id = pieces.Encoder(vocab), pieces.piece_bytes(vocab)
    text = "".join(chr(97 + i * i % 23) for i in range(400_000))
    start = time.process_time()
    ids, scores, ways = encoder.encode(text)
    assert time.process_time() - start < 60
    assert pieces.decode(ids, of_id) == text and len(scores) == len(ways) == pieces.BEST and scores == sorted(scores, reverse=True)


def test_further_segmentations_of_a_word_are_searched_once(monkeypatch):
    """The same closest words come up in text after text; their N best paths are kept, within bounds, and stay the same."""
    monkeypatch.setattr(pieces, "SEARCHED", 4)
    vocab, asked, search = pieces.read_vocabulary(), [], pieces.n_best
    monkeypatch.setattr(pieces, "n_best", lambda word, *rest: asked.append(word) or search(word, *rest))
    encoder, text = pieces.Encoder(vocab), "the house and the garden"
    first = encoder.encode(text)
    once = len(asked)
    assert once and encoder.encode(text) == first and len(asked) == once
    for other in ("a river runs", "seven old trees", "no more words"):
        assert encoder.encode(other) == pieces.Encoder(vocab).encode(other) and len(encoder.searched) <= 4


def test_best_and_gap_is_that_of_the_two_best_paths():
    vocab = pieces.read_vocabulary()
    for word in ("▁the", "▁ofonheshnd", "Edlying", "▁", "x\U0001f600", "日本"):
        paths = pieces.n_best(word, vocab, 2)
        score, ids, gap = pieces.best_and_gap(word, vocab)
        assert score == paths[0][0] == pieces.n_best(word, vocab, 1)[0][0] and gap == (score - paths[1][0] if len(paths) > 1 else pieces.NEVER)
    assert pieces.best_and_gap("", vocab) == (0, (), pieces.NEVER)

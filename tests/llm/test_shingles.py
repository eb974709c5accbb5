"""Near copies by five-word shingles against brute force."""

import collections

import numpy as np
import pytest

import corpus_pipeline
from symloom.llm import shingles, simhash
from tests.conftest import SF


def sets(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def similar(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def brute(docs):
    found = [(d, sets(t)) for d, t in docs]
    root = {d: d for d, _ in found}
    def find(d):
        return d if root[d] == d else find(root[d])
    for i, (d, a) in enumerate(found):
        for e, b in found[:i]:
            if similar(a, b):
                x, y = find(d), find(e)
                root[max(x, y)] = min(x, y)
    return {d: find(d) for d in root}


def copies():
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(3000)]
    def text(n):
        return list(rng.choice(words, n))
    passage, docs = text(60), []
    for _ in range(12):
        base = text(120)
        for edits in range(8):
            new = list(base)
            for at in rng.choice(len(new), edits, replace=False):
                new[at] = "changed"
            docs.append(new)
    docs += [passage + text(20) for _ in range(45)] + [passage + text(6) for _ in range(10)]
    return [(i, " ".join(d)) for i, d in enumerate(docs)] + [(900, None), (901, " \n"), (902, "One two"), (903, "one  TWO"), (904, "one")]


@pytest.mark.parametrize("bucket,common,kept", [(32, 8, 1 << 21), (2, 2, 1 << 21), (2, 2, 40), (2, 10 ** 9, 1 << 21)])
def test_no_similar_pair_is_lost(spark, bucket, common, kept, monkeypatch):
    monkeypatch.setattr(shingles, "SMALL_BUCKET", bucket)
    monkeypatch.setattr(shingles, "COMMON", common)
    monkeypatch.setattr(shingles, "KEPT", kept)
    docs = copies()
    got = {r.doc_id: r.component_id for r in shingles.similar_components(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute(docs)


def test_parities_of_any_size():
    rng = np.random.default_rng(6)
    for m, n, apart in ((900, 1100, 120), (3000, 2900, 300), (4090, 4100, 10), (20000, 17000, 5000), (0, 1, 1)):
        base = rng.integers(0, 2 ** 63, m + n, dtype=np.uint64)
        x, y = np.unique(base[:m]), np.unique(np.concatenate([base[:max(0, n - apart)], base[m:m + apart]]))
        found = shingles.differing_bits([shingles.parity(x)], [shingles.parity(y)])[0]
        assert found <= len(np.setxor1d(x, y))
        width = min(shingles.parity_width(len(x)), shingles.parity_width(len(y)))
        narrow = [np.bincount((s % np.uint64(width)).astype(np.int64), minlength=width) & 1 for s in (x, y)]
        assert found == (narrow[0] ^ narrow[1]).sum()
    # Long texts that share a quarter are ruled out, though parities of 1,024 bits could not.
    base = rng.integers(0, 2 ** 63, 9000, dtype=np.uint64)
    x, y = np.unique(base[:5000]), np.unique(np.concatenate([base[:1250], base[5250:9000]]))
    assert 9 * shingles.differing_bits([shingles.parity(x)], [shingles.parity(y)])[0] > len(x) + len(y)


def test_long_texts_that_share_a_passage(spark):
    rng = np.random.default_rng(8)
    passage = [f"p{i}" for i in range(1500)]
    long = [[f"d{d}w{w}" for w in rng.integers(0, 10 ** 6, 3000)] for d in range(8)]
    docs = [(d, " ".join(passage + w)) for d, w in enumerate(long)] + [(10 + d, " ".join(passage + w[:2800])) for d, w in enumerate(long[:3])]
    got = {r.doc_id: r.component_id for r in shingles.similar_components(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute(docs) and len(set(got.values())) == 8


def test_near_dedup_leaves_no_near_copies(spark):
    docs = copies()
    table = spark.createDataFrame([(d, t, "en", "s", 0) for d, t in docs], "doc_id long, text string, lang string, source string, n_chars int")
    kept = sorted(r.doc_id for r in dict(corpus_pipeline.STAGES)["near_dedup"](spark, table, SF).collect())
    assert kept == sorted(set(brute(docs).values()))


def test_repeated_and_missing_ids(spark):
    rows = [(1, "x y"), (1, "x y"), (1, "p q r s t u"), (None, "X y"), (2, "p q r s t u")]
    found = shingles.similar_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id is None, r.doc_id, r.component_id, r.component_size) for r in found if r.doc_id) == [
        (False, 1, 1, 2), (False, 1, 1, 3), (False, 1, 1, 3), (False, 2, 1, 2)] and len(found) == 5


def test_fingerprints_propose_and_shingles_decide(spark, monkeypatch):
    """Without prefixes, only SimHash can find a pair; what it finds is linked only if the shingles agree."""
    rng = np.random.default_rng(11)
    base = [f"w{i}" for i in rng.integers(0, 10 ** 6, 1500)]
    chant = ["x", "y", "z"] * 200
    docs = [(1, " ".join(base)), (2, " ".join([*base, "end"])), (3, " ".join(chant + base[:30])), (4, " ".join(chant + base[100:130]))]
    prints = {d: simhash.fingerprint(t.encode()) for d, t in docs}
    assert 0 < (prints[1] ^ prints[2]).bit_count() <= 2 and (prints[3] ^ prints[4]).bit_count() <= 2
    monkeypatch.setattr(shingles, "prefix", lambda found, levels, at_least: found[:0])
    got = {r.doc_id: r.component_id for r in shingles.similar_components(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute(docs) == {1: 1, 2: 1, 3: 3, 4: 4}


def test_members_of_large_buckets_that_cannot_be_similar_make_no_pairs(spark, monkeypatch):
    """Sixty texts share a passage of 56 shingles out of 66: every prefix holds some, no two texts are similar."""
    rng = np.random.default_rng(11)
    passage = [f"p{i}" for i in range(60)]
    docs = [(d, " ".join([*passage, *(f"u{d}x{i}" for i in rng.permutation(10))])) for d in range(60)]
    given, possible = [], shingles._possible

    def counted(pairs, *rest):
        given.append(pairs.count())
        return possible(pairs, *rest)

    monkeypatch.setattr(shingles, "_possible", counted)
    got = shingles.similar_components(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == {d: d for d, _ in docs}
    assert sum(given) <= len(docs)


def test_sketches_are_parities_at_the_narrowest_width():
    rng = np.random.default_rng(3)
    found = [np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64)) for n in (0, 7, 900, 5000)]
    got = np.array([list(x.values()) for x in shingles.sketches([shingles.parity(f) for f in found]).to_pylist()], np.int64)
    bits = [np.bincount((f % np.uint64(shingles.PARITY)).astype(np.int64), minlength=shingles.PARITY) & 1 for f in found]
    assert (got == np.stack([np.packbits(b.astype(np.uint8)).view(np.int64) for b in bits])).all()
    assert len(shingles.sketches([])) == 0


def test_shingles_of_all_documents_are_counted(spark, monkeypatch):
    """Each of 4,200 words is held by two or three documents, and one by all: a part of the documents would miss most of them."""
    monkeypatch.setattr(shingles, "KEPT", 500)
    docs = [(i, f"w{i % 4200}") for i in range(10000)] + [(20000 + i, "x") for i in range(300)] + [(30000, "once"), (30001, None)]
    levels = shingles.common_levels(spark.createDataFrame(docs, "doc_id long, text string").repartition(3))
    want = np.zeros(shingles.SLOTS, np.uint8)
    for word, n in collections.Counter(t for _, t in docs if t).items():
        slot = int(shingles.shingle_set(word.encode())[0]) % shingles.SLOTS
        want[slot] = max(want[slot], n.bit_length() if n >= shingles.COMMON else 0)
    assert (levels == want).all() and want.max() == 9

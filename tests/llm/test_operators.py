"""The corpus operators against brute force on small tables with odd rows, and on given tables."""

import datetime
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from check import compare, connect
from symloom.llm import components, exact, langid, lm_score, mixing, pieces, pii, quality, sharding, simhash, suffixes
from symloom.llm.queries import ORACLES, QUERIES
from tests.conftest import SF
from tests.llm import brute

LONG = "the quick brown fox jumps over the lazy dog and runs away from it again. " * 300
ODD = [
    (1, "Hello World", "b"), (2, "hello world", "b"), (3, "HELLO WORLD", None), (4, None, "a"), (5, "", "a"), (6, " \t\n\x0b\x0c\r ", "a"),
    (7, LONG, "b"), (8, LONG + "x", "b"), (9, LONG, "c"), (10, "Ärger Éclair ärger", "c"), (11, "ärger éclair ärger", "c"),
    (12, "a b c a b c\na b c\n\na b c", "c"), (13, "😀 ퟿ 日本語", None), (14, "one two", "b"), (15, "one\x00two three", "b"),
] + [(100 + i, f"copy number of the same words {i % 7} " * 12, "hot") for i in range(120)]
# Columns whose names clash with those that the operators make.
SCHEMA = "doc_id long, text string, source string, lang string, size long, key string, shard string, kept string, fp string, a string, _id string, row_no string"


def table(spark, rows):
    return spark.createDataFrame([(*r[:3], "xx", 5, "k", "s", "y", "f", "a", "i", "r") for r in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def odd(spark):
    return table(spark, ODD)


@pytest.fixture(scope="module")
def empty(spark):
    return table(spark, ODD).where("false")


@pytest.fixture(scope="module")
def given(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(name, spark):
    assert compare(QUERIES[name](spark, SF), connect(SF), ORACLES[name]) == ""


# 1. Sharding

@pytest.mark.parametrize("edges", [4, 16384])
@pytest.mark.parametrize("which", ["odd", "given"])
def test_shards_have_the_smallest_capacity(edges, which, request):
    docs = request.getfixturevalue(which)
    rows = sharding.minimax_shards(docs, 5, edges=edges).collect()
    sizes = {d: len(brute.raw(t)) + 8 for d, t in pairs(docs)}
    assert {r.doc_id: (r.size, r.text_crc32) for r in rows} == {d: (sizes[d], brute.crc(t)) for d, t in pairs(docs)}
    groups, slots, shard_of = Counter(), defaultdict(list), {}
    for r in rows:
        groups[r.group_key] += r.size
        slots[r.shard].append(r.slot)
        assert shard_of.setdefault(r.group_key, r.shard) == r.shard
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(5))
    load = Counter()
    for key, size in groups.items():
        load[shard_of[key]] += size
    alone, left = [], dict(groups)
    for key, size in sorted(groups.items(), key=lambda x: (-x[1], x[0])):
        if len(alone) < 4 and size * (5 - len(alone)) > sum(left.values()):
            alone.append(key)
            del left[key]
    best = brute.smallest_capacity([left[k] for k in sorted(left)], 5 - len(alone))
    assert max(load[shard_of[k]] for k in left) == best
    assert all(load[shard_of[k]] == groups[k] for k in alone)


def test_shards_of_few_and_no_rows(spark, empty):
    assert sharding.minimax_shards(empty).count() == 0
    one = sharding.minimax_shards(table(spark, ODD[:1])).collect()
    assert [(r.size, r.slot, r.law, r.grown_shard) for r in one] == [(19, 0, "bytes", None)]
    twice = sharding.minimax_shards(table(spark, [ODD[0], ODD[0]]), 3).collect()
    assert sorted(r.slot for r in twice) == [0, 1] and len({r.shard for r in twice}) == 1


# 2. Pseudonyms

PRIVATE = ("write to anna.k@mail.example.org, card 4417744280351547 or 4417-7442-8035-1547 not 4417744280351548; host 10.20.30.40 not 300.1.1.1; "
           "born 2024-02-29 or 2.3.1999 or 03/04/1999 never 2023-02-30; call +1 (017) 555-7713 or (017) 555-7713; ssn 123-45-6789 not 666-12-1234; "
           "DE89 3704 0044 0532 0130 00 or GB82WEST12345698765432; version 1.2.3")


def test_pseudonyms_keep_format_links_and_checks(spark):
    rows = pii.pseudonymized(table(spark, [(1, PRIVATE, "s"), (2, "again 4417744280351547", "s"), (3, None, "s"), (4, "", "s"), (5, "no number", "s")])).collect()
    got = {r.doc_id: r for r in rows}
    assert got[3].text is None and got[4].text == "" and got[5].text == "no number" and got[3].n_found == got[5].n_found == 0
    text = got[1].text
    assert got[1].n_found == 12 and re.sub(r"\w+", "x", text) == re.sub(r"\w+", "x", PRIVATE)
    cards = re.findall(r"\b\d{16}\b|\d{4}-\d{4}-\d{4}-\d{4}", text)
    assert cards[0] == cards[1].replace("-", "") != "4417744280351547" and brute.luhn_valid(cards[0]) and cards[2] == "4417744280351548"
    assert got[2].text == f"again {cards[0]}"
    phones = re.findall(r"\(\d{3}\) \d{3}-\d{4}", text)
    assert phones[0] == phones[1] != "(017) 555-7713"
    assert all(brute.iban_valid(x) for x in re.findall(r"DE\d\d(?: \d{4}){4} \d\d|GB\d\d[A-Z]{4}\d{14}", text))
    assert "666-12-1234" in text and "300.1.1.1" in text and "2023-02-30" in text and "version 1.2.3" in text
    datetime.date.fromisoformat(re.search(r"born (\S+)", text)[1])
    for old in ("anna.k", "10.20.30.40", "2024-02-29", "2.3.1999", "03/04/1999", "123-45-6789", "3704 0044"):
        assert old not in text


@pytest.mark.parametrize("a,b", [(92, 397), (75, 487), (10, 1), (4, 9)])
def test_number_permutation(spark, a, b):
    out = spark.range(a * b).select("id", pii.permuted(F.col("id"), F.lit(a).cast("long"), F.lit(b).cast("long"), "k", "secret").alias("p")).collect()
    assert sorted(r.p for r in out) == list(range(a * b)) and all(r.id != r.p for r in out)


def test_text_permutation(spark):
    rows = spark.range(2600).select(F.concat(F.char(F.col("id") % 26 + 97), F.lpad(F.floor(F.col("id") / 26).cast("string"), 2, "0")).alias("t"))
    out = rows.select("t", pii.permuted_text(F.col("t"), "k", "secret").alias("p")).collect()
    assert {r.p for r in out} == {r.t for r in out} and all(r.t != r.p for r in out)


def test_given_private_values_go(spark, given):
    rows = given.join(pii.pseudonymized(given).select("doc_id", F.col("text").alias("new"), "n_found"), "doc_id").collect()
    assert len(rows) == given.count() and sum(r.n_found for r in rows) > 0
    for r in rows:
        for kind in (r"\b\d{16}\b", r"\S+@\S+\.com", r"\b\d{1,3}(?:\.\d{1,3}){3}\b", r"\(\d{3}\) 555-\d{4}"):
            for value in re.findall(kind, r.text):
                if kind != r"\b\d{16}\b" or brute.luhn_valid(value):
                    assert value not in r.new
        if not r.n_found:
            assert r.text == r.new


# 3. SimHash

def test_golay_code():
    assert np.bincount(simhash.USED).tolist() == [0, 277, 0, 0, 0, 0, 1771]
    rng = np.random.default_rng(3)
    x = rng.integers(0, 1 << 63, 500, dtype=np.uint64)
    y = x.copy()
    for i in range(len(y)):
        for bit in rng.choice(64, rng.integers(0, 3), replace=False):
            y[i] ^= np.uint64(1) << np.uint64(bit)
    def keys(values):
        place, key, home = simhash.fuzzy_keys(values)
        return [set(key[place == i]) for i in range(len(values))], [set(key[(place == i) & home]) for i in range(len(values))]
    (all_x, _), (_, home_y) = keys(x), keys(y)
    assert all(a & h for a, h in zip(all_x, home_y))


@pytest.mark.parametrize("small", [0, 128])
@pytest.mark.parametrize("which", ["odd", "given"])
def test_simhash(which, small, request, monkeypatch):
    monkeypatch.setattr(simhash, "SMALL_BUCKET", small)
    docs = request.getfixturevalue(which)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.simhash_components(docs).collect()}
    assert got == brute.near_components(pairs(docs))


def test_simhash_of_crowded_fingerprints(spark):
    rng = np.random.default_rng(8)
    values = [int(rng.integers(0, 1 << 62))]
    for _ in range(400):
        v = values[rng.integers(0, len(values))]
        for bit in rng.choice(64, rng.integers(1, 5), replace=False):
            v ^= 1 << int(bit)
        values.append(v)
    values = sorted({v - (1 << 64) if v >> 63 else v for v in values})
    df = spark.createDataFrame([(v,) for v in values], "fp long")
    got = {r.node: r.root for r in components.components(simhash.near_links(df)).collect()}
    root = {v: v for v in values}
    for _ in range(len(values)):
        before = dict(root)
        for a in values:
            for b in values:
                if bin((a ^ b) & ((1 << 64) - 1)).count("1") <= 2:
                    root[a] = root[b] = min(root[a], root[b])
        if root == before:
            break
    assert all(got.get(v, v) == root[v] for v in values)


def test_simhash_edges(spark, empty):
    assert simhash.simhash_components(empty).count() == 0
    rows = simhash.simhash_components(table(spark, [(1, None, "s"), (2, "", "s"), (None, "", "s"), (2, "", "s")])).collect()
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in rows} == {(1, "0" * 16, 1), (2, "0" * 16, 1), (None, "0" * 16, 1)} and len(rows) == 4
    heads = simhash.component_heads(table(spark, [(1, "x", "s"), (1, "x", "s"), (2, "x", "s"), (3, "other words here", "s")])).collect()
    assert sorted(r.doc_id for r in heads) == [1, 3]


def test_long_chain_of_links(spark):
    links = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).union(spark.createDataFrame([(500, 501)], "a long, b long"))
    roots = {r.node: r.root for r in components.components(links).collect()}
    assert roots == {**{i: 0 for i in range(301)}, 500: 500, 501: 500}


# 4. Host rules

def measures(text):
    w, lines = brute.words(text), (text or "").split("\n")
    seen, dup = set(), 0
    for line in lines:
        if brute.words(line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    covered = {i + o for i in range(len(w) - 2) if windows[tuple(w[i:i + 3])] > 1 for o in range(3)}
    return len(w), len(b"".join(w).decode()), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered)


@pytest.mark.parametrize("which", ["odd", "given"])
def test_measures(which, request):
    docs = request.getfixturevalue(which)
    got = {r.doc_id: tuple(r[m] for m in quality.MEASURES) for r in quality.document_measures(docs).collect()}
    assert got == {d: measures(t) for d, t in pairs(docs)}


def test_bad_host_goes_and_small_host_is_shrunk(spark, empty):
    good, bad = " ".join(f"w{i}" for i in range(80)), "short"
    rows = [(i, bad if i < 95 else good, "bad") for i in range(100)] + [(200 + i, bad if i < 5 else good, "fine") for i in range(100)]
    rows += [(400 + h * 10 + i, bad if i < 1 else good, f"host{h}") for h in range(20) for i in range(8)]
    rows += [(900, bad, "tiny"), (903, good, "tiny"), (901, good, None), (902, bad, None)]
    got = {r.doc_id: r for r in quality.host_rules(table(spark, rows)).collect()}
    assert not any(got[i].kept for i in range(100)) and all(got[200 + i].kept == (i >= 5) for i in range(100))
    assert got[900].host_kept and not got[900].kept and got[903].kept and got[901].kept and not got[902].kept and got[902].host_kept
    alike = [(i, bad if i % 4 == 0 else good, f"h{i // 8}") for i in range(160)] + [(900, bad, "tiny")]
    got = {r.doc_id: r for r in quality.host_rules(table(spark, alike)).collect()}
    assert got[900].host_kept  # where hosts differ no more than chance allows, one failure says nothing
    assert quality.host_rules(empty).count() == 0


# 5. LM scoring

def test_lm_score(spark, empty):
    formal = "the committee considered the annual report and approved it "
    noise = "zx qv jjk wq zzxx kq "
    docs = table(spark, [(i, formal * (1 + i % 3), "s") for i in range(20)] + [(100 + i, noise * 4, "s") for i in range(20)] + [(300, None, "s"), (301, "", "s")])
    labels = spark.createDataFrame([(i, 1, 0) for i in range(10)] + [(100, 1, 1), (101, 0, 0), (999, 1, 0)], "doc_id long, quality int, toxic int")
    rows = {r.doc_id: r for r in lm_score.cross_entropy_difference(docs, labels).collect()}
    assert rows[300].score is None and rows[301].score is None and rows[300].n_tokens == 0 and len(rows) == 42
    assert max(rows[i].score for i in range(20)) < 0 < min(rows[100 + i].score for i in range(20))
    assert lm_score.cross_entropy_difference(empty, labels).count() == 0


def word_losses(texts, targets):
    """Losses of every text under both models, counted word by word."""
    words = {d: [w.lower() for w in brute.words(t)] for d, t in texts.items()}
    grams = {d: list(zip([None, *w], w)) for d, w in words.items()}
    size = len({x for w in words.values() for x in w})
    own = Counter(g for d in grams if d in targets for g in grams[d])
    rest = Counter(g for d in grams if d not in targets for g in grams[d])
    scale = sum(own.values()) / sum(rest.values()) if own and rest else None
    out = {}
    for name, counts in (("target", own), ("background", Counter({g: n * scale for g, n in rest.items()}) if scale else own + rest)):
        total, single, before = sum(counts.values()), Counter(), Counter()
        for (a, b), n in counts.items():
            single[b] += n
            before[a] += n
        p = lambda a, b: (counts[a, b] + lm_score.PRIOR * (single[b] + lm_score.PRIOR / size) / (total + lm_score.PRIOR)) / (before[a] + lm_score.PRIOR)  # noqa: B023, E731
        for d, g in grams.items():
            out[d, name] = -sum(np.log(p(*x)) for x in g) / len(g) if g else None
    return out, {d: len(w) for d, w in words.items()}


@pytest.mark.parametrize("targets", [[], [1, 2, 8], None])
@pytest.mark.parametrize("sent_out", [True, False])
def test_lm_losses(spark, odd, targets, sent_out, monkeypatch):
    if not sent_out:
        monkeypatch.setattr(lm_score, "GRAM_BYTES", 1 << 40)
    texts = dict(pairs(odd))
    targets = list(texts) if targets is None else targets
    want, sizes = word_losses(texts, set(targets))
    model = lm_score.train(odd, spark.createDataFrame([(i,) for i in [*targets, None]], "doc_id long"))
    rows = lm_score.score(odd, model).collect()
    assert {r.doc_id: r.n_tokens for r in rows} == sizes
    for r in rows:
        for name, loss in (("target", r.target_loss), ("background", r.background_loss)):
            assert (loss is None) == (want[r.doc_id, name] is None) and (loss is None or abs(loss - want[r.doc_id, name]) < 1e-9)


def test_lm_model_grows_and_repeated_rows(spark, monkeypatch):
    ids = spark.createDataFrame([(1,)], "doc_id long")
    few = [(1, "a b A b", "s"), (1, "a b A b", "s"), (2, "b " * 5000 + "x" * 5000, "s"), (None, "a b", "s")]
    more = few + [(10 + i, f"w{i} v{i}", "s") for i in range(500)]
    assert lm_score.train(table(spark, few), ids).count() == 6 and lm_score.train(table(spark, more), ids).count() == 6 + 1000
    rows = lm_score.cross_entropy_difference(table(spark, few), spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")).collect()
    assert sorted(r.n_tokens for r in rows) == [2, 4, 4, 5001]
    codes = lm_score.word_codes(b"one  Two three\tone " + b"y" * 99 + b" two")
    monkeypatch.setattr(lm_score, "SLAB", 8)
    assert (codes == lm_score.word_codes(b"one  Two three\tone " + b"y" * 99 + b" two")).all()
    assert codes[0] == codes[3] and codes[1] == codes[5] and len(set(codes.tolist())) == 4


# 6. Repeated passages

@pytest.mark.parametrize("which", ["odd", "given"])
@pytest.mark.parametrize("frequent", [False, True])
def test_repeats(which, frequent, request, monkeypatch):
    if frequent:
        monkeypatch.setattr(suffixes, "LEAST", 2)
        monkeypatch.setattr(suffixes, "FREQUENT", 0.0)
    else:
        monkeypatch.setattr(suffixes, "CHUNK", 3000)
        monkeypatch.setattr(suffixes, "COLLECTION", 50)
    docs = request.getfixturevalue(which)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.remove_repeats(docs).collect()}
    assert got == brute.without_repeats(pairs(docs))


def test_column_insertion():
    rng = np.random.default_rng(4)
    strings = rng.integers(1, 3, (200, 30)).astype(np.uint16)
    strings[50:80] = strings[10:40]
    strings[rng.integers(0, 200, 20), rng.integers(0, 30, 20)] = 0
    rank = rng.permutation(200)
    flags = suffixes.insert_columns(strings, rank, columns=19, length=12)
    for c in range(19):
        for i in range(200):
            own = strings[i, c:c + 12]
            earlier = any(rank[j] < rank[i] and own.all() and (strings[j, c:c + 12] == own).all() for j in range(200))
            assert flags[i, c] == earlier


def test_repeats_of_repeated_rows(spark, empty):
    assert suffixes.remove_repeats(empty).count() == 0
    rows = suffixes.remove_repeats(table(spark, [(1, LONG, "s"), (1, LONG, "s"), (None, LONG[:300], "s"), (2, None, "s")])).collect()
    assert len(rows) == 4
    assert sorted((r.doc_id is None, r.n_bytes) for r in rows) == [(False, 0), (False, len(LONG)), (False, len(LONG)), (True, 300)]
    assert all(r.n_removed < 300 for r in rows if r.doc_id is None)


# 7. Mixing

def test_mix(spark, odd, empty):
    assert mixing.mix(empty).count() == 0
    rows = mixing.mix(odd).collect()
    sizes = {d: len(brute.words(t)) for d, t in pairs(odd)}
    assert {r.doc_id: r.size for r in rows} == sizes and all(r.taken == r.size * r.repeats <= 3 * r.size for r in rows)
    total, taken, own, target = sum(sizes.values()), Counter(), {}, {}
    for r in rows:
        taken[r.source] += r.taken
        own[r.source], target[r.source] = r.source_size, r.target
    assert abs(sum(target.values()) - total) < 1e-6 and all(target[s] <= 3 * own[s] for s in own)
    largest = max(sizes.values())
    assert all(abs(taken[s] - target[s]) <= largest for s in own)
    assert mixing.mix(table(spark, [(1, None, None), (2, "", "a")])).agg(F.sum("taken")).first()[0] == 0
    assert {r.doc_id: r.taken for r in rows} == {r.doc_id: r.taken for r in mixing.mix(odd).collect()}


def test_targets_reshare_what_is_above(spark):
    sources = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1), (None, 500)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(sources).collect()}
    weights, sizes, total = {"a": 5, "b": 2, "c": 1, None: 5}, {"a": 10, "b": 1000, "c": 1, None: 500}, 1511
    want, open_, left = {}, set(sizes), total
    while True:
        share = {s: left * weights[s] / sum(weights[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not over:
            want |= share
            break
        want |= {s: 3 * sizes[s] for s in over}
        left -= sum(3 * sizes[s] for s in over)
        open_ -= over
    assert {s: round(t, 6) for s, t in got.items()} == {s: round(t, 6) for s, t in want.items()}


def test_highest_quotients(spark):
    votes = {"a": 53.0, "b": 24.0, "c": 23.0, "d": 0.4}
    got = mixing.apportion(spark.createDataFrame(list(votes.items()), "source string, target double"), 2, 10).collect()
    quotients = sorted(((-v / (2 * k + 1), s, k) for s, v in votes.items() for k in range(30)))[:20]
    assert Counter(r.source for r in got) == Counter(s for _, s, _ in quotients)
    assert Counter(r.shard for r in got) == {0: 10, 1: 10}


def test_repeated_rows(spark, odd):
    rows = Counter(r.doc_id for r in mixing.repeated_rows(odd).collect())
    assert rows == Counter({r.doc_id: r.repeats for r in mixing.mix(odd).collect() if r.repeats})


# 8. Pieces

def segmentations(text, vocab):
    edges = pieces.lattice(text, vocab)
    def go(place):
        if place == len(text):
            return [(0, ())]
        return [(s + rest, ids + more) for end in range(place + 1, len(text) + 1) for start, s, ids in edges[end] if start == place for rest, more in go(end)]
    return sorted(go(0), reverse=True)


@pytest.mark.parametrize("text", ["ab, c▁x 1.2", " \n\n a.b", "é1é_a", "▁", "thhethea", "²."])
def test_n_best_paths(text):
    vocab = pieces.read_vocabulary()
    marked = pieces.BLANK + text.replace(pieces.BLANK, pieces.LITERAL).replace(" ", pieces.BLANK)
    every = segmentations(marked, vocab)
    assert [s for s, _ in pieces.n_best(marked, vocab, 6)] == [s for s, _ in every[:6]]
    ids, scores, ways = pieces.Encoder(vocab, 6).encode(text)
    assert scores == [s for s, _ in every[:6]] and (scores[0], tuple(ids)) in every and len(ways) == len(scores)


def test_encoding_comes_back(spark, odd, empty, given):
    assert pieces.encode_documents(empty).count() == 0
    rows = {r.doc_id: r for r in pieces.encode_documents(odd).collect()}
    assert rows[4].ids is None and rows[5].ids == [] and rows[5].scores == [0.0]
    assert all(r.round_trip for d, r in rows.items() if d != 4)
    assert all(r.scores == sorted(r.scores, reverse=True) and r.alternatives[0] == [] for r in rows.values() if r.ids)
    assert pieces.encode_documents(given).where("NOT round_trip").count() == 0


def test_full_cache_changes_nothing(monkeypatch):
    vocab = pieces.read_vocabulary()
    text = LONG[:2000] + " some other words, and more; of them"
    want = pieces.Encoder(vocab).encode(text)
    monkeypatch.setattr(pieces, "CACHED", 3)
    assert pieces.Encoder(vocab).encode(text) == want


# 9. Exact copies

@pytest.mark.parametrize("which", ["odd", "given"])
def test_exact_groups(which, request):
    docs = request.getfixturevalue(which)
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact.exact_dedup(docs).collect()}
    assert got == brute.exact_groups(pairs(docs))
    kept = sorted(r.doc_id for r in exact.kept_rows(docs).collect())
    assert kept == sorted(d for d, g in got.items() if g[2])


def test_exact_with_repeated_rows_and_no_frequent_digest(spark, empty):
    assert exact.exact_dedup(empty).count() == 0
    docs = table(spark, [(1, "x", "s"), (1, "x", "s"), (None, "X", "s"), (None, "y", "s"), (1, "z", "s")])
    for candidates in (1, 512):
        rows = exact.exact_dedup(docs, candidates=candidates, tracked=512).collect()
        assert sorted((r.group_size, r.kept) for r in rows) == [(1, True), (1, True), (3, False), (3, False), (3, True)]
    assert sorted((r.text, r.doc_id) for r in exact.kept_rows(docs).collect()) == [("x", 1), ("y", None), ("z", 1)]


# 10. Language ID

def test_codewords_differ():
    for n in (2, 3, 4, 6, 9, 40):
        codes = langid.codewords(n).astype(int)
        apart = [(codes[i] != codes[j]).sum() for i in range(n) for j in range(i)]
        assert min(apart) >= max(1, codes.shape[1] // 4)


def test_language_id(spark, given, odd, empty):
    rows = {r.doc_id: r for r in langid.language_id(given).collect()}
    truth = {r.doc_id: r.lang for r in given.collect()}
    held = [d for d, r in rows.items() if r.held_out]
    assert held == [d for d in rows if brute.zlib.crc32(str(d).encode()) % 4 == 2] and len(rows) == len(truth)
    assert sum(rows[d].lang_pred == truth[d] for d in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in rows.values())
    strange = {r.doc_id: r for r in langid.language_id(odd).collect()}
    assert {strange[d].lang_pred for d in (4, 5, 6)} == {"und"} and strange[1].lang_pred == "xx"
    assert langid.language_id(empty).count() == 0
    unlabelled = odd.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in langid.language_id(unlabelled).collect()} == {"und"}


def test_prediction_ignores_other_columns(spark, given):
    model = langid.train(langid.learned_rows(given))
    changed = given.select("doc_id", "text", F.lit("zz").alias("lang"), F.lit("q").alias("source"), (F.col("doc_id") * 0).alias("n_chars"))
    a, b = (sorted(map(tuple, langid.identify(d, model).collect())) for d in (given, changed))
    assert a == b


def test_repeats_where_every_anchor_is_frequent(spark):
    # Default settings: each batch holds frequent anchors only.
    rng = np.random.default_rng(6)
    page = "".join(rng.choice(list("abcdefgh "), 300))
    docs = [(i, page) for i in range(400)]
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(8)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.remove_repeats(table).collect()}
    assert got == brute.without_repeats(docs)


def test_anchors_do_not_depend_on_the_chunk():
    rng = np.random.default_rng(7)
    text = bytes(rng.integers(0, 256, 4000, dtype=np.uint8))
    alone = suffixes.Chunk([text])
    among = suffixes.Chunk([bytes(rng.integers(0, 256, 300_000, dtype=np.uint8)), text])
    mine = among.text == 1
    assert np.array_equal(alone.place, among.place[mine]) and np.array_equal(alone.keys, among.keys[mine])

"""WARC archives, spelling variants and hard negatives against brute force and planted damage."""

import gzip
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from symloom.llm import negatives, spelling, warc
from tests.conftest import SF

BIG = "<p>the same page again</p>" * 60
PAGES = [(1, "http://a.b/1", BIG), (2, "http://a.b/2 x\r\ny", BIG), (3, None, BIG), (4, "http://a.b/4", "small"), (5, "", "small"),
         (6, "http://a.b/6", None), (7, "http://a.b/7", ""), (8, "http://ü.b/8", "é" * 500), (9, "http://a.b/9", "é" * 499),
         (None, "http://a.b/n", BIG), (10, "u", "WARC/1.1\r\nWARC-Type: response\r\n\r\n" * 50), (11, "v", "x\r\n\r\n" * 300)]
PAGE_SCHEMA = "page_id long, url string, html string, payload string, digest string, n int, record_type string"


def page_table(spark, rows):
    return spark.createDataFrame([(*r, "p", "d", 1, "t") for r in rows], PAGE_SCHEMA).repartition(3)


def expected_pages(rows):
    groups = defaultdict(list)
    for i, (page, _, html) in enumerate(rows):
        groups[(html or "").encode()].append((-1 if page is None else page, i))
    out = Counter()
    for data, members in groups.items():
        top = max(members)
        for page, i in members:
            again = len(data) >= 1000 and (page, i) != top
            out[(rows[i][0], len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", rows[top[1]][0] if again else None)] += 1
    return out


def read_pages(df):
    return Counter(tuple(r) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect())


@pytest.mark.parametrize("rows", [PAGES, PAGES * 2 + [(3, "http://other", BIG)], [(20, "u", "z" * 3_000_000), (21, "u", "z" * 3_000_000)], []],
                         ids=["odd", "repeated", "long", "empty"])
def test_pages_come_back(spark, rows):
    assert read_pages(warc.archived_pages(page_table(spark, rows))) == expected_pages(rows)


@pytest.mark.parametrize("compressed", [True, False])
def test_archives_are_valid_and_bounded(spark, tmp_path, compressed):
    folder = str(tmp_path / "archives")
    warc.write_archives(page_table(spark, PAGES).coalesce(1), folder, limit=4000, compressed=compressed)
    files = [p.read_bytes() for p in (tmp_path / "archives").glob("part-*")]
    assert len(files) > 1
    plain = b"".join(map(gzip.decompress, files)) if compressed else b"".join(files)
    assert plain.count(b"WARC-Record-ID:") == len(PAGES)
    records = warc.read_archives(spark, folder)
    assert warc.quarantined(records).count() == 0
    got = Counter(bytes(r.payload) for r in records.where("record_type = 'response'").collect())
    assert set(got) == {(h or "").encode() for _, _, h in PAGES}
    assert all(re.fullmatch(r"[\x21-\x7e]+", r.target_uri) for r in records.collect())


def record(n, payload=None):
    payload = b"payload %d " % n * 30 if payload is None else payload
    return warc.page_record(n, b"http://x/%d" % n, payload, len(payload), hashlib.sha1(payload).hexdigest(), False, None)


def outcome(data):
    """Ids that were read, and the gaps; every byte is in one of them."""
    ids, gaps, at = [], [], 0
    for start, stop, problem, r in warc.salvage(data):
        assert start == at and stop > start
        at = stop
        if r:
            ids.append(int(r.fields["x-page-id"]))
        else:
            gaps.append((start, stop, problem))
    assert at == len(data)
    return ids, gaps


@pytest.mark.parametrize("compressed", [True, False])
def test_damage_costs_only_what_it_hits(compressed):
    parts = [record(n) for n in range(6)]
    parts = [zlib.compress(p, 6, 31) for p in parts] if compressed else parts
    ends = [sum(map(len, parts[:n + 1])) for n in range(6)]
    whole = b"".join(parts)
    assert outcome(whole) == ([0, 1, 2, 3, 4, 5], [])
    hit = bytearray(whole)
    hit[ends[1] + len(parts[2]) // 2] ^= 0x55  # one byte inside record 2
    ids, gaps = outcome(bytes(hit))
    assert ids == [0, 1, 3, 4, 5] and [(g[0], g[1]) for g in gaps] == [(ends[1], ends[2])]
    ids, gaps = outcome(whole[:-10])
    assert ids == [0, 1, 2, 3, 4] and gaps[0][:2] == (ends[4], ends[5] - 10) and "truncated" in gaps[0][2]
    ids, gaps = outcome(whole[ends[0] + 7:])  # starts inside record 1
    assert ids == [2, 3, 4, 5] and gaps[0][0] == 0
    noise = b"\x1f\x8b\x08 no member WARC/1.1\r\nno record\r\n" * 3
    ids, gaps = outcome(whole[:ends[2]] + noise + whole[ends[2]:])
    assert ids == [0, 1, 2, 3, 4, 5] and [(g[0], g[1]) for g in gaps] == [(ends[2], ends[2] + len(noise))]
    assert outcome(b"") == ([], []) and outcome(noise)[0] == []


@pytest.mark.parametrize("change,problem", [
    (lambda r: r.replace(b"Content-Length: 4", b"Content-Length: 9", 1) if b"Content-Length: 4" in r else r.replace(b"Content-Length: 3", b"Content-Length: 9", 1), None),
    (lambda r: r.replace(b"WARC/1.1", b"WARC/9.1", 1), "version"), (lambda r: r.replace(b"WARC-Type", b"XARC-Type", 1), "header"),
    (lambda r: re.sub(rb"Content-Length: \d+\r\n\r\nHTTP", b"Content-Length: no\r\n\r\nHTTP", r), "length"),
    (lambda r: r[:-4] + b"....", "trailer"), (lambda r: r.replace(b"payload 2 ", b"payload 7 ", 1), "block digest"),
])
def test_checks_that_fail(change, problem):
    parts = [record(n) for n in range(5)]
    parts[2] = change(parts[2])
    ids, gaps = outcome(b"".join(parts))
    assert ids == [0, 1, 3, 4] and len(gaps) == 1 and (problem is None or gaps[0][2] == problem)


def test_damage_in_written_archives(spark, tmp_path):
    folder = tmp_path / "archives"
    warc.write_archives(page_table(spark, [(n, "u", f"page {n} " * 200) for n in range(40)]), str(folder), limit=3000)
    paths = sorted(folder.glob("part-*"))
    data = bytearray(paths[0].read_bytes())
    data[-6] ^= 0xFF  # in the checksum of the last member
    for crc in folder.glob(".*.crc"):
        crc.unlink()
    paths[0].write_bytes(bytes(data))
    records = warc.read_archives(spark, str(folder))
    assert warc.quarantined(records).count() == 1
    assert records.where("problem IS NULL").count() == 39


# Spelling variants

def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_variants(rows):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'null' if doc is None else doc}:{run}".encode())
            counts[run[:h % len(run)] + run[h % len(run) + 1:] if h % 97 == 0 else run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    shared = defaultdict(set)
    for w in words:
        for v in {w, *(w[:i] + w[i + 1:] for i in range(len(w)))}:
            shared[v].add(w)
    near = {w: set() for w in words}
    for group in shared.values():
        for a in group:
            near[a] |= {b for b in group if one_edit(a, b)}
    forms = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        if best is not None and words[best] >= 2 * n:
            forms[w] = best

    def root(w):
        while w in forms:
            w = forms[w]
        return w

    return Counter((w, forms.get(w), root(w), n, len(near[w]), words.get(forms.get(w))) for w, n in words.items())


def odd_texts():
    random.seed(3)
    words = ["".join(random.choice("abcé") for _ in range(random.randint(4, 7))) for _ in range(400)]
    rows = [(i, " ".join(random.choice(words[:40 + 9 * i]) for _ in range(300))) for i in range(40)]
    long = "ab" * 700
    return rows + [(50, None), (51, ""), (52, "×÷ÿÀ×÷ÿÀ " * 5 + "ÄRGER Ärger äRGER"), (None, "nullid nullid nullid nullib nullib nullib"),
                   (53, f"{long} {long} {long} {long}c {long}c {long}c"), (54, "hello hello hello"), (54, "hello hello hello hallo hallo hallo")]


@pytest.mark.parametrize("symbols,hot", [(spelling.SYMBOLS, spelling.HOT), (600, 15)])
def test_variants_are_those_of_brute_force(spark, symbols, hot):
    rows = odd_texts()
    docs = spark.createDataFrame([(*r, 1, "w", "f") for r in rows], "doc_id long, text string, n long, word string, form string").repartition(3)
    got = spelling.variants(docs, symbols=symbols, hot=hot)
    assert Counter(tuple(r) for r in got.collect()) == brute_variants(rows)


def test_variants_of_the_given_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert Counter(tuple(r) for r in spelling.variants(docs).collect()) == brute_variants(rows)


def test_no_variants_of_nothing(spark):
    assert spelling.variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert spelling.variants(spark.createDataFrame([(1, "few words here")], "doc_id long, text string")).count() == 0


# Hard negatives

def brute_negatives(rows):
    used = []
    for vec_id, label, vec in rows:
        if label is None or vec is None or any(x is None or not math.isfinite(x) for x in vec):
            continue
        used.append((vec_id, (label + 1) % 10 if vec_id is not None and vec_id % 7 == 0 else label, [math.floor(256 * x) for x in vec]))
    out = Counter()
    for i, (anchor, label, q) in enumerate(used):
        if anchor is None or anchor % 50:
            continue
        scored = [(-sum(x * y for x, y in zip(q, v, strict=False)), -1 << 63 if j is None else j, k, other)
                  for k, (j, other, v) in enumerate(used) if k != i]
        for ps, pid, _, _ in sorted(s for s in scored if s[3] == label)[:5]:
            good = sorted(s for s in scored if s[3] != label and -50 * ps <= -100 * s[0] <= -95 * ps)[:3]
            for rank, (ns, nid, _, _) in enumerate(good, 1):
                out[(anchor, *(None if x == -1 << 63 else x for x in (pid,)), rank, None if nid == -1 << 63 else nid, -ps, -ns)] += 1
    return out


def vectors(seed, n, width=6):
    random.seed(seed)
    near = [[random.gauss(0, 1) for _ in range(width)] for _ in range(4)]
    return [(i, random.choice([0, 1, 1, 1, 2]), [float(x + random.gauss(0, 0.4)) for x in random.choice(near)]) for i in range(n)]


ODD_VECTORS = [(400, 1, None), (401, None, [0.5] * 6), (402, 1, [float("nan")] * 6), (403, 1, [float("inf"), 0.0]), (404, 1, [None, 0.5]),
               (405, 1, []), (406, 2, [1.0]), (None, 1, [1.0] * 6), (None, 2, [1.0] * 6), (450, 1, [0.5] * 9), (450, 1, [0.5] * 9), (500, 2, [0.0] * 6)]
VECTOR_SCHEMA = "vec_id long, label int, embedding array<float>, score string, row_no string, rank string, comps string"


def vector_table(spark, rows):
    return spark.createDataFrame([(*r, "s", "r", "k", "c") for r in rows], VECTOR_SCHEMA).repartition(3)


@pytest.mark.parametrize("rows", [vectors(1, 320) + ODD_VECTORS, vectors(2, 200), ODD_VECTORS, [(0, 1, [1.0])], []],
                         ids=["odd", "plain", "few", "one", "empty"])
@pytest.mark.parametrize("sizes", [{}, {"rows": 16, "anchors": 2, "slab": 600}], ids=["whole", "small"])
def test_negatives_are_those_of_brute_force(spark, rows, sizes):
    # Spark's floats hold 32 bits, so the plain version starts from what they hold.
    table = vector_table(spark, rows)
    held = [tuple(r) for r in table.select("vec_id", "label", "embedding").collect()]
    assert Counter(tuple(r) for r in negatives.hard_negatives(table, **sizes).collect()) == brute_negatives(held)


def test_scores_beyond_doubles_are_exact(spark):
    rows = [(i, i % 2, [3e6 + i, -2e4 * i, 1e6]) for i in range(60)]
    table = vector_table(spark, rows)
    held = [tuple(r) for r in table.select("vec_id", "label", "embedding").collect()]
    want = brute_negatives(held)
    assert want and Counter(tuple(r) for r in negatives.hard_negatives(table).collect()) == want


def test_repeated_vectors_tie_by_id(spark):
    rows = [(i, i % 3, [0.5, 0.25]) for i in range(150)]
    got = Counter(tuple(r) for r in negatives.hard_negatives(vector_table(spark, rows), rows=8).collect())
    assert got == brute_negatives(rows)


def test_no_query_reads_less_than_its_table(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    assert warc.archived_pages(pages).agg(F.countDistinct("page_id")).first()[0] == pages.count()

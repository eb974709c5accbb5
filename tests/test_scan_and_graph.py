import math
import random

import pytest
from pyspark.sql import functions as F

from symloom.functions import scan
from symloom.operators import flags, graph
from symloom.session import salted_join


def test_scans_over_blocks(spark):
    rng = random.Random(1)
    rows = [(0 if rng.random() < 0.7 else rng.randint(1, 4), i, rng.randint(-1, 1), rng.choice(["x", "y", None])) for i in range(700)]
    df = spark.createDataFrame(rows, "k int, i int, v int, s string")
    block = F.floor(F.col("i") / 50)
    got = {r["i"]: (r["total"], r["last"]) for r in scan.carry_last(
        scan.running_sum(df, ["k"], "i", F.col("v"), "total", block), ["k"], "i", F.col("s"), "last", block).collect()}
    total, last = {}, {}
    for k, i, v, s in rows:
        total[k] = total.get(k, 0) + v
        assert got[i] == (total[k], last.get(k)), i
        last[k] = s or last.get(k)


def test_last_n_and_dense_index(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    top = scan.last_n(df, ["k"], [F.desc("id")], 5, F.col("id")).collect()
    assert sorted(r["id"] for r in top) == sorted(range(985, 1000))
    idx = {r["id"]: r["n"] for r in scan.dense_index(df.where("id % 2 = 0"), [F.col("id")], "n").collect()}
    assert idx == {i: i // 2 for i in range(0, 1000, 2)}


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_join(spark, how):
    big = spark.range(300).select(F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("id") % 11).alias("k"), "id")
    small = spark.createDataFrame([(7, "a"), (3, "b"), (99, "c")], "k long, t string")
    a, b = salted_join(big, small, "k", F.col("id"), how).collect(), big.join(small, "k", how).collect()
    assert sorted(map(tuple, a), key=str) == sorted(map(tuple, b), key=str)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_sends_nothing_out(spark, tmp_path, how):
    """Names unnested from small files, which the optimizer takes for a small table."""
    spark.range(300).write.parquet(str(tmp_path / "t"))
    names = spark.read.parquet(str(tmp_path / "t")).select(F.explode(F.array(*[F.concat(F.lit(p), F.col("id")) for p in "abc"])).alias("k"))
    big = spark.range(2000).select(F.concat(F.lit("b"), F.col("id")).alias("k"), "id")
    joined = salted_join(big, names.distinct(), "k", F.col("id"), how)
    assert joined.count() == {"inner": 300, "left": 2000, "left_semi": 300, "left_anti": 1700}[how]
    assert "Broadcast" not in joined._jdf.queryExecution().executedPlan().toString()


def test_closure_and_ancestors_survive_cycles(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "x")], "parent string, child string")
    got = {(r["root"], r["node"], r["depth"]) for r in graph.closure(e, spark.createDataFrame([("a",), ("x",), ("lone",)], "node string")).collect()}
    assert got == {("a", "a", 0), ("a", "b", 1), ("a", "c", 2), ("a", "d", 3), ("x", "x", 0), ("lone", "lone", 0)}
    g = spark.createDataFrame([(1, None, "r"), (2, 1, "m"), (3, 2, "l"), (4, 5, "p"), (5, 4, "q"), (6, 77, "o")], "id int, parent_id int, name string")
    paths = {r["id"]: r["path"] for r in graph.ancestor_path(g).collect()}
    assert paths == {1: ["r"], 2: ["r", "m"], 3: ["r", "m", "l"], 4: ["q", "p"], 5: ["p", "q"], 6: ["o"]}


def test_same_named_types_and_undeclared_parents(spark):
    rows = [(1, "A", "class", ["P"]), (2, "A", "struct", []), (3, "A", "extension", ["Q"]), (4, "Ghost", "extension", []), (5, "B", "class", ["A", "Alias"]), (6, "P", "protocol", [])]
    nodes = spark.createDataFrame(rows, "node_id int, name string, kind string, adopted array<string>")
    edges = graph.edges(nodes)
    assert {(r["parent"], r["child_id"], r["rel"]) for r in edges.collect()} == {
        ("P", 1, "adopts"), ("A", 5, "adopts"), ("Alias", 5, "adopts"), ("A", 3, "extends"), ("Ghost", 4, "extends")}
    assert {(r["parent"], r["parent_id"]) for r in graph.link_parents(edges, nodes).collect()} == {("P", 6), ("A", 1), ("Alias", None), ("Ghost", None)}
    assert {r["node_id"] for r in graph.external_candidates(nodes, edges).collect()} == {3, 4, 5}
    assert {r["node_id"]: r["adopted"] for r in graph.fold_extensions(nodes).collect()}[2] == ["Q"]
    alias = spark.createDataFrame([("Alias", ["X", "Y"]), ("A", [])], "alias string, protocols array<string>")
    assert {r["node_id"]: r["adopted"] for r in graph.expand_aliases(nodes, alias).collect()}[5] == ["A", "X", "Y"]
    assert [r["node_id"] for r in graph.no_inheritance(nodes, edges).collect()] == []


def test_flatten_shapes(spark):
    doc = ('[{"A_name": "T", "B_kind": "class", "G_members": [{"A_name": "m", "isException": 1}, {"B_kind": "none", "G_members": [{"A_name": "deep"}]}]},'
           '{"node": {"A_name": "W"}, "children": [{"node": {"A_name": "c"}}], "extension": []}]')
    got = {(r["path"], r["depth"], r["is_exception"]) for r in graph.flatten(spark.createDataFrame([(1, doc)], "doc_id int, value string")).collect()}
    assert got == {("T", 0, 0), ("T.m", 1, 1), ("T.deep", 2, 0), ("W", 0, 0), ("W.c", 1, 0)}


def test_renameable_cross_kinds(spark):
    rows = [("a", "variable", 1), ("a", "function", 0), ("b", "class", 1), ("b", "struct", 0), ("`a`", "case", 0), ("c", "extension", 0), ("d", "case", 0), ("d", "case", 1)]
    nodes = spark.createDataFrame(rows, "name string, kind string, is_exception int")
    assert {tuple(r) for r in flags.renameable(nodes).select("kind", "name").collect()} == {("struct", "b")}


def test_lock_keeps_inner_matches_untouched(spark):
    rows = [(1, "A", "class", [], [], 0), (2, "f", "function", ["A"], [1], 0), (3, "f", "function", [], [], None), (4, "f", "variable", ["B", "A"], [9, 8], 1)]
    nodes = (spark.createDataFrame(rows, "node_id int, name string, kind string, parents array<string>, ancestor_ids array<int>, is_exception int")
             .withColumn("has_flag", F.col("is_exception").isNotNull()))
    specs = spark.createDataFrame([("A",), ("f",)], "spec string")
    locked = {r["node_id"]: r["status"] for r in flags.set_flags(nodes, specs, 1).collect()}
    assert locked == {1: "changed", 2: None, 3: "changed", 4: "unchanged"}
    open_ = {r["node_id"]: r["status"] for r in flags.set_flags(nodes, specs, 1, lock_children=False, only_explicit_zero=True).collect()}
    assert open_ == {1: "changed", 2: "changed", 3: "unchanged", 4: "unchanged"}
    kinds = {r["node_id"]: r["status"] for r in flags.set_flags(nodes, specs, 0, allowed_kinds=["Variable"]).collect()}
    assert kinds == {1: None, 2: None, 3: None, 4: "changed"}
    path = spark.createDataFrame([("A.f",), ("variable:B.A.f",)], "spec string")
    assert {r["node_id"] for r in flags.match_specs(nodes, path).collect()} == {2, 4}


def test_dumps_and_declarations_of_any_depth(spark):
    import json

    from symloom.operators.catalog import parse_sdk

    node, sdk = {"A_name": "n20", "B_kind": "class"}, {"kind": "TypeDecl", "declKind": "Class", "name": "t20", "children": []}
    for i in reversed(range(20)):
        node = {"A_name": f"n{i}", "B_kind": "class", "G_members": [node]}
        sdk = {"kind": "TypeDecl", "declKind": "Class", "name": f"t{i}", "children": [sdk]}
    docs = spark.createDataFrame([(1, json.dumps([node])), (2, None)], "doc_id int, value string")
    rows = graph.flatten(docs).collect()
    assert sorted(r["depth"] for r in rows) == list(range(21)) and {r["doc_id"] for r in rows} == {1}
    dump = spark.createDataFrame([(json.dumps({"ABIRoot": {"name": "K", "children": [sdk]}}),)], "value string")
    assert {r["type_name"] for r in parse_sdk(dump).collect()} == {f"t{i}" for i in range(21)}


def test_names_link_within_their_project(spark):
    nodes = spark.createDataFrame([("A", 1, "Base", "class", []), ("B", 2, "Base", "class", []), ("B", 3, "Kid", "class", ["Base"]), ("C", 4, "Kid", "class", ["Base"])],
                                  "project string, node_id long, name string, kind string, adopted array<string>")
    got = {r["child_id"]: r["parent_id"] for r in graph.link_parents(graph.edges(nodes), nodes).collect()}
    assert got == {3: 2, 4: None}
    flagged = nodes.withColumn("is_exception", (F.col("node_id") == 1).cast("int"))
    assert {tuple(r) for r in flags.renameable(flagged).collect()} == {("B", "class", "Base"), ("B", "class", "Kid"), ("C", "class", "Kid")}


def test_reachable_has_a_row_per_root_and_node(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "x"), ("a", "d")], "parent string, child string")
    starts = spark.createDataFrame([("a",), ("a",), ("x",), ("lone",)], "node string")
    got = sorted(map(tuple, graph.reachable(e, starts).collect()))
    assert got == [("a", "a", 0, None), ("a", "b", 1, "a"), ("a", "c", 2, "b"), ("a", "d", 1, "a"), ("lone", "lone", 0, None), ("x", "x", 0, None)]
    assert graph.reachable(e, starts.limit(0)).count() == 0


def test_long_chains_take_few_rounds(spark):
    n = 2000
    chain = spark.range(n).select("id", F.when(F.col("id") > 0, F.col("id") - 1).alias("parent_id"), F.lit("n").alias("name"))
    rounds = []
    got = graph.ancestor_path(chain, rounds=rounds)
    assert got.agg(F.sum("depth"), F.max("depth"), F.count("*")).first()[:] == (n * (n - 1) // 2, n - 1, n)
    assert len(rounds) <= math.ceil(math.log2(n)) + 1


def test_climbs_into_cycles_equal_plain_climbs(spark):
    rng = random.Random(4)
    up = {i: rng.choice([None, rng.randrange(60), rng.randrange(60), 99]) for i in range(60)}
    g = spark.createDataFrame([(i, u, f"n{i}") for i, u in up.items()], "id int, parent_id int, name string")
    want = {}
    for i in up:
        seen, at = [], i
        while at in up and at not in seen:
            seen.append(at)
            at = up[at]
        want[i] = [f"n{x}" for x in reversed(seen)]
    assert {r["id"]: r["path"] for r in graph.ancestor_path(g).collect()} == want

"""Joins of tables that grow with the input send neither side through the driver, however small they look."""

from pyspark.sql import functions as F

from symloom.operators import graph, mapping as mp, policy as pol, review, rewrite, rules as rl, scopes
from symloom.plans import classify as plan


def _joins(df) -> str:
    """The joins of the plan that ran."""
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    return "\n".join(line for line in df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].splitlines() if "Join" in line)


def test_closest_symbol(spark):
    idents = spark.createDataFrame([("f", "titel12"), ("f", "load(x:)"), ("g", "zzz")], "f string, ident string")
    symbols = spark.createDataFrame([("f", "title12", 0), ("f", "load(id: Int)", 1), ("g", "other", 0)], "f string, name string, ordinal int")
    got = mp.closest_symbol(idents, symbols, ["f"])
    assert "Broadcast" not in _joins(got)
    assert {(r.ident, r.symbol, r.tier) for r in got.collect()} == {("titel12", "title12", 3), ("load(x:)", "load(id: Int)", 2)}


def test_exclude_candidates(spark, tmp_path):
    """Only the caller's few patterns are sent out, not the runs of letters of all names."""
    spark.range(300).write.parquet(str(tmp_path / "t"))
    names = spark.read.parquet(str(tmp_path / "t")).select(F.concat(F.lit("m"), F.col("id")).alias("name"))
    got = pol.exclude_candidates(["m1*", "m2?"], names, names.where("name like '%5'"))
    joins = _joins(got)
    assert "BuildLeft" not in joins and "BroadcastHashJoin [name" not in joins
    assert {r.name for r in got.collect() if r.in_nodes} == {"m25"} | {f"m{i}" for i in range(300) if str(i)[0] == "1" and i % 10 == 5}


def test_rules_on_functions(spark):
    funcs = spark.createDataFrame([(i, f"load{i}" if i % 2 else f"free{i}", "P") for i in range(20)] + [(99, None, None)], "id int, name string, parent_type string")
    rules = spark.createDataFrame([("load*", "function"), ("free2", None)], "name string, kind string")
    hits, parted = rl.match_rules(funcs, rules, ["id"]), rl.partition_by_rules(funcs, rules, ["id"])
    joins = _joins(hits) + _joins(parted)
    assert "BroadcastHashJoin [side" not in joins and "BroadcastHashJoin [id" not in joins and "BuildLeft" not in joins
    assert {(r.id, r.rule) for r in hits.collect()} == {(i, "load*") for i in range(1, 20, 2)} | {(2, "free2")}
    assert {r.id for r in parted.collect() if r.excluded} == {2, *range(1, 20, 2)} and parted.count() == 21


def test_declaration_sites(spark):
    files = spark.createDataFrame([("a", "let title = 1\nfunc load() {}"), ("b", "uses title and lone")], "path string, text string")
    idents = spark.createDataFrame([("title",), ("load",), ("lone",)], "name string")
    got = review.declaration_sites(idents, files, "path")
    assert "Broadcast" not in _joins(got)
    assert {(r.name, r.path, r.decl_line) for r in got.collect()} == {("title", "a", 1), ("load", "a", 2), ("lone", "b", None)}


def test_protocol_impl_and_parents(spark):
    funcs = spark.createDataFrame([("p", 1, "draw", "draw/0", ["Proto"], "Store", True, "extension", False), ("p", 2, "x", "x/0", ["Out"], None, False, "", True)],
                                  "project string, line_no int, name string, func_key string, parent_conforms array<string>, parent_type string, "
                                  "is_parent_extension boolean, parent_kind string, parent_has_actor_attr boolean")
    asked = spark.createDataFrame([("p", "Proto", "draw/0")], "project string, protocol string, func_key string")
    got = scopes.protocol_impl(funcs, asked, ["line_no"])
    assert "Broadcast" not in _joins(got)
    assert {r.line_no: (r.matched_internal_protocols, r.has_external_protocols_in_scope) for r in got.collect()} == {1: (["Proto"], False), 2: ([], True)}
    actors, local = spark.createDataFrame([("Store",)], "name string"), spark.createDataFrame([("p", "Store"), ("q", "Out")], "project string, name string")
    flagged = scopes.resolve_parents(funcs, actors, local.where("project = 'q'"), local)
    assert "Broadcast" not in _joins(flagged)
    assert {r.line_no: (r.is_parent_actor, r.is_parent_global_actor, r.is_parent_declared_in_project) for r in flagged.collect()} == {1: (True, False, True), 2: (False, True, False)}


def test_resolve_parents_shuffles_functions_once(spark):
    funcs = spark.createDataFrame([(1, "f", "T", False, "class", False)], "line_no int, name string, parent_type string, is_parent_extension boolean, parent_kind string, parent_has_actor_attr boolean")
    types = spark.createDataFrame([("T",)], "name string")
    assert _joins(scopes.resolve_parents(funcs, types, types, types)).count("Join") == 1


def test_classify_reads_texts_once_for_nodes(spark, monkeypatch):
    """Declarations are written before the joins that read them several times."""
    files = spark.createDataFrame([("p", 1, "a.swift", "class A: B {\n}\nextension A: C {\n}")], "project string, file_id int, rel_path string, text string")
    seen, expand = [], graph.expand_aliases
    monkeypatch.setattr(graph, "expand_aliases", lambda nodes, aliases: seen.append(nodes) or expand(nodes, aliases))
    ext = spark.createDataFrame([], "node_id long, name string, kind string, params array<string>")
    members = spark.createDataFrame([], "parent_id long, name string, kind string")
    sdk = spark.createDataFrame([], "type_name string, kind string, member string, member_kind string, member_type string")
    got = plan.classify(files, ext, members, sdk, spark.createDataFrame([("A",)], "name string"))
    assert "Broadcast" not in _joins(got)
    assert sorted((r.kind, r.is_exception) for r in got.collect()) == [("class", 1), ("extension", 1)]
    assert seen[0].inputFiles()


def test_pseudonymize(spark):
    files = spark.createDataFrame([(1, "let a = b"), (2, "none"), (3, None)], "id int, text string")
    got = rewrite.pseudonymize(files, spark.createDataFrame([("a", "x"), ("b", "y")], "target string, replacement string"), "id")
    assert "Broadcast" not in _joins(got)
    assert {r.id: r.text for r in got.collect()} == {1: "let x = y", 2: "none", 3: None}

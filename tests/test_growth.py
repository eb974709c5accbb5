"""Steps whose tasks, rounds or repeated tables must not grow faster than the input."""

from pyspark.sql import functions as F

from symloom.operators import catalog, graph, literals, mapping, rules, scopes
from symloom.plans import classify, rename
from symloom.session import parts_for, salted_join


def test_rewrite_window_gathers_nothing(spark):
    lits = spark.createDataFrame([(1, '"a"', 3, 0), (1, '"a"', 3, 1), (1, '"b"', 5, 0), (2, '"a"', 9, 0), (None, '"a"', 3, 0)],
                                 "file_id long, value string, line_no int, ordinal int")
    hits = spark.createDataFrame([(1, '"a"', 3, "x"), (1, '"a"', 4, "y"), (1, '"a"', 4, "y"), (1, '"a"', 5, "z"), (1, '"b"', 4, "z"), (2, '"a"', 10, "w"),
                                  (None, '"a"', 3, "n")], "file_id long, value string, line_no int, note string")
    out = literals.rewrite_window(lits, hits, ["file_id"])
    assert "Aggregate" not in out._jdf.queryExecution().toString()
    assert sorted(r.note for r in out.collect()) == ["w", "x", "y", "y"]
    assert parts_for(spark, 0) < parts_for(spark, 10 ** 9) == 5000


def test_mapping_repeats_no_table_of_candidates(spark, monkeypatch):
    used = []

    def counted(big, small, key, spread, how="inner", salts=16):
        used.append(salts)
        return salted_join(big, small, key, spread, how, salts)

    monkeypatch.setattr(mapping, "salted_join", counted)
    names = [("class", f"{a}{b}{i}") for i, a in enumerate("qwertyuiop") for b in ("zebra", "quartz", "willow")]
    members = spark.createDataFrame([("class", i, n[1]) for i, n in enumerate(names)], "kind string, cluster_id int, name string")
    waiting = spark.createDataFrame([("class", "class", f"mm{i}", "lower", "mmx", i) for i in range(5)], "kind string, pool string, target string, style string, pre string, cursor int")
    offers = members.selectExpr("kind AS pool", "cluster_id AS cursor", "name", "'lower' AS style", "substr(name, 1, 3) AS pre")
    asks, stuck = mapping._propose(waiting, offers, ["pool", "cursor", "style"], 42, 1)
    assert asks.count() == 5 and stuck.count() == 0 and set(used) == {1}


def test_lookups_of_functions_move_few_columns(spark, monkeypatch):
    """Types and requirements, about as many as functions, are not repeated, and what is looked up goes without parameters and texts."""
    text = "protocol P1 {\n    func go()\n}\nactor A {\n    func go(a: Int) { }\n    nonisolated func stay() { }\n}\nclass B: P1, Q {\n    func go() { }\n}\nextension B {\n    func more(x: Odd) { }\n}\n"
    files = spark.createDataFrame([("p", 1, text), ("p", 2, "func free() { }\n"), (None, 3, text)], "project string, file_id long, text string")
    seen = []
    for name in ("protocol_impl", "resolve_parents"):
        real = getattr(scopes, name)
        monkeypatch.setattr(scopes, name, lambda funcs, *rest, real=real: seen.append(set(funcs.columns)) or real(funcs, *rest))
    salted = []
    monkeypatch.setattr(scopes, "salted_join", lambda big, small, *rest: salted.append(small.columns) or salted_join(big, small, *rest))
    rows = rename.wrappable(files).collect()
    assert all(not {"params_src", "param_types", "route_key", "parent_qual"} & columns for columns in seen) and len(seen) == 2
    assert salted == [["project", "protocol", "_known"]]
    got = sorted((r.file_id, r.name, r.line_no, r.blocked_by or "") for r in rows)
    blocked = [(5, "go", "actor_isolated"), (6, "stay", ""), (9, "go", "protocol_requirement")]
    assert got == sorted([(f, n, at, b) for f in (1, 3) for at, n, b in blocked]
                         + [(1, "more", 12, "unknown_type"), (3, "more", 12, "external_extension"), (2, "free", 1, "")])


def test_classification_repeats_no_table_as_large_as_its_nodes(spark, monkeypatch):
    text = "class A: B, P {\n    func go() { }\n}\nprotocol Q { }\ntypealias P = Q & R\nenum E: String {\n    case on\n}\nextension A: S { }\n"
    files = spark.createDataFrame([("p", f, f"f{f}", text) for f in (1, 2)], "project string, file_id long, rel_path string, text string")
    salted = []
    for module in (graph, catalog, rules):
        monkeypatch.setattr(module, "salted_join", lambda big, small, key, spread, how="inner", salts=16: salted.append((tuple(key) if isinstance(key, list) else key, salts))
                            or salted_join(big, small, key, spread, how, salts))
    ext = spark.createDataFrame([(1, "B", "class", [])], "node_id long, name string, kind string, params array<string>")
    members = spark.createDataFrame([(1, "go", "function")], "parent_id long, name string, kind string")
    sdk = spark.createDataFrame([("String", "Struct", "count", "Var", "count")], "type_name string, kind string, member string, member_kind string, member_type string")
    rows = classify.classify(files, ext, members, sdk, spark.createDataFrame([("Q",)], "name string")).collect()
    assert {s for k, s in salted if k in ("node_id", "parent_id") or "parent" in k or ("project", "_a") == k} == {1}
    got = {(r.file_id, r.name, r.kind): (sorted(r.adopted), r.is_exception) for r in rows}
    assert got[1, "A", "class"] == (["B", "Q", "R", "S"], 0) and got[2, "on", "case"] == ([], 1) and got[1, "Q", "protocol"] == ([], 1)


def test_rename_classifies_once(spark):
    """Whatever makes the nodes runs once, though their names are read several times."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("int")
    def flag(n):
        seen.add(1)
        return int(n % 5 == 0)

    names = [("p", "class" if n % 2 else "variable", f"{'Mine' if n % 2 else 'mine'}{n}", n) for n in range(1, 21)]
    nodes = spark.createDataFrame(names, "project string, kind string, name string, n int").withColumn("is_exception", flag("n"))
    pool = spark.createDataFrame([(k, f"{p}{i}") for k in ("class", "variable") for p in ("Zebu", "zebu") for i in range(30)], "kind string, name string")
    clusters = spark.createDataFrame([(k, 0, "wyvern", ["wyvern"]) for k in ("class", "variable")], "kind string, cluster_id int, rep string, tokens array<string>")
    members = pool.where("name like '%1'").selectExpr("kind", "0 AS cluster_id", "name")
    files = spark.createDataFrame([(1, "let mine2 = Mine3() // mine2\nMine5(mine4)")], "file_id long, text string")
    done = rename.rename(files, nodes, nodes.select("name").limit(0), clusters, members, pool)
    table = {r.target: r.replacement for r in done.mapping.collect()}
    assert [r.text for r in done.files.collect()] == [f"let {table['mine2']} = {table['Mine3']}()\nMine5({table['mine4']})"]
    assert done.audit.first().n == len(table) == 16
    assert seen.value == len(names)


def test_small_lookups_are_sent_out_with_the_same_mapping(spark, monkeypatch):
    names = [("class", f"{p}{i}") for p in ("Zebu", "zebu", "Tarn") for i in range(20)]
    pool = spark.createDataFrame(names, "kind string, name string")
    clusters = spark.createDataFrame([("class", 0, "wyvern", ["wyvern"]), ("class", 1, "jjjjjjjjjjjj", ["j"])], "kind string, cluster_id int, rep string, tokens array<string>")
    members = pool.selectExpr("kind", "cast(length(name) % 2 as int) AS cluster_id", "name").where("name like '%1'")
    targets = spark.createDataFrame([("class", f"{'Mine' if i % 3 else 'mine'}{i}") for i in range(70)], "kind string, target string")
    got, salted = [], []
    monkeypatch.setattr(mapping, "salted_join", lambda *a, **k: salted.append(a[2]) or salted_join(*a, **k))
    for many, sent in ((1 << 60, 0), (0, 100_000), (0, 0)):
        monkeypatch.setattr(mapping, "MANY", many)
        monkeypatch.setattr(mapping, "SENT", sent)
        salted.clear()
        got.append(sorted(map(tuple, mapping.create_mapping(targets, clusters, members, pool, pool.select("name").limit(0)).collect())))
        assert ("_gbp" in salted) == (sent == 0)
    assert got[0] == got[1] == got[2] and len(got[0]) == 60

import json

import pytest
from pyspark.sql import functions as F

from symloom.operators import manifest, policy as pol, reports, review
from symloom.sources import files as src, lists as ls, nodes as nd, sinks


def test_scan_files(spark, tmp_path):
    root = tmp_path / "App"
    for rel in ("a.swift", "Sub/b.swift", "Pods/x.swift", ".build/checkouts/y.swift", "Sub/c.txt"):
        (root / rel).parent.mkdir(parents=True, exist_ok=True)
        (root / rel).write_text("let a = 1\nlet b = 2\n")
    got = {r["rel_path"]: r["text"] for r in src.scan_files(spark, str(root)).collect()}
    assert set(got) == {"a.swift", "Sub/b.swift"} and got["a.swift"] == "let a = 1\nlet b = 2\n"


def test_read_lists(spark, tmp_path):
    (tmp_path / "n.txt").write_text(" a \n\n# c\nb\n  # d\n")
    assert sorted(r[0] for r in ls.read_names(spark, str(tmp_path / "n.txt")).collect()) == ["a", "b"]
    (tmp_path / "r1.json").write_text('[{"A_name": "x", "B_kind": "CLASS"}]')
    (tmp_path / "r2.json").write_text('{"rules": [\n {"name": "y", "kind": "file", "path": "A\\\\B"}]}')
    rules = ls.read_rules(spark, str(tmp_path / "r1.json"), str(tmp_path / "r2.json"))
    assert sorted((r["name"], r["kind"]) for r in rules.collect()) == [("x", "class"), ("y", "file")]
    assert {r[0] for r in ls.rule_file_globs(rules).collect()} == {"a/b", "y"}


@pytest.mark.parametrize("doc, want", [
    ('{"class": ["A"], "function": ["f"], "bad": ["n"]}', {("class", "A"), ("function", "f")}),
    ('{"type": "Enum", "list": ["E"]}', {("enum", "E")}), ('{"names": ["f", "g"]}', {("function", "f"), ("function", "g")}), ('["q"]', {("function", "q")})])
def test_target_shapes(spark, tmp_path, doc, want):
    (tmp_path / "t.json").write_text(doc)
    assert {tuple(r) for r in ls.read_targets(spark, str(tmp_path / "t.json")).collect()} == want
    assert {r[0] for r in ls.read_forbidden(spark, str(tmp_path / "t.json")).collect()} >= {n for _, n in want}


def test_pool_and_clusters(spark, tmp_path):
    (tmp_path / "safe_pool_variable.txt").write_text("a\n b \n\n")
    (tmp_path / "buckets_pool_class.txt").write_text("C\n")
    (tmp_path / "cluster_index_variable.json").write_text('[{"rep": "a", "tokens": ["a"], "members": ["a", "b"]}, {"rep": "z"}]')
    assert sorted(map(tuple, ls.read_pool(spark, str(tmp_path), ["property", "class"]).collect())) == [("class", "C"), ("property", "a"), ("property", "b")]
    got = [tuple(r) for r in ls.read_clusters(spark, str(tmp_path), ["property"]).orderBy("cluster_id").collect()]
    assert got == [("property", 0, "a", ["a"], ["a", "b"]), ("property", 1, "z", None, None)]


CONFIG = {"project": [], "_comment": 1, "extra": 2, "include": {"obfuscation": [" a ", "", "a", 7, "w*", None], "encryption": "one", "odd": ["n"]}, "exclude": {"obfuscation": {"x": 1}}}


def test_policy_edges(spark, tmp_path):
    docs = spark.createDataFrame([(1, json.dumps(CONFIG)), (2, "not json"), (3, "{}")], "config_id int, value string")
    rows = {(r["section"], r["category"], r["pattern"], r["is_wildcard"]) for r in ls.policy_table(docs).collect()}
    assert rows == {("include", "obfuscation", "a", False), ("include", "obfuscation", "w*", True), ("include", "encryption", "one", False)}
    found = {(r["finding"], r["item"]) for r in ls.policy_findings(docs).collect()}
    assert found == {("unknown_key", "extra"), ("not_an_object", "project"), ("not_a_list", "exclude.obfuscation")}
    path = tmp_path / "c.json"
    path.write_text(json.dumps({**CONFIG, "exclude": {}}))
    loaded = {(r["section"], r["category"], r["position"], r["pattern"]) for r in ls.load_policy(spark, str(path)).collect()}
    assert loaded == {("include", "obfuscation", 0, "a"), ("include", "obfuscation", 3, "w*"), ("include", "encryption", 0, "one")}


def test_globs_follow_fnmatch(spark):
    import fnmatch

    names = ["foo", "Foo", "fo.o", "f", "foo1", "a[b]", "a-b", "^x", "bar\nbaz", "x\\y", "(a)", ""]
    patterns = ["*", "f*", "f?o", "[fF]oo", "[!f]oo", "a[[]b]", "[^x]x", "*.o", "a-?", "bar*baz", "foo", "x\\y", "(a)", "[a-c]*", "[", "f[", "[]a]"] + [f"none{i}*" for i in range(450)]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    got = {tuple(r) for r in pol.glob_match(df, patterns).collect()}
    assert got == {(n, p) for n in names for p in patterns if fnmatch.fnmatchcase(n, p)}


def test_nested_files_and_sdk(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"A_name": "T", "B_kind": "class",\n "G_members": [{"A_name": "m", "B_kind": "function"}]}]')
    assert {(r["path"], r["depth"]) for r in nd.read_nodes(spark, str(tmp_path)).collect()} == {("T", 0), ("T.m", 1)}
    sdk = tmp_path / "sdk"
    sdk.mkdir()
    (sdk / "k.json").write_text(json.dumps({"ABIRoot": {"name": "K", "children": [{"kind": "TypeDecl", "declKind": "Class", "name": "V", "children": [
        {"kind": "Function", "declKind": "Func", "name": "f", "printedName": "f(a:_:)"}]}, {"kind": "Var", "name": "global"}]}}))
    assert [tuple(r)[:6] for r in nd.read_sdk(spark, str(sdk)).collect()] == [("V", "Class", None, None, "f", "Func")]


def test_layouts(spark):
    rows = [("a", "Package.swift"), ("a", "x.swift"), ("b", "Project.swift"), ("c", "C.xcodeproj/project.pbxproj"), ("d", "Sub/Package.swift"), ("d", "q.m"), ("e", "only.swift")]
    got = dict(map(tuple, src.project_layout(spark.createDataFrame(rows, "project string, rel_path string")).collect()))
    assert got == {"a": "spm", "b": "tuist", "c": "xcode", "d": "unknown", "e": "file"}


def test_manifest_groups_and_choice(spark):
    groups = spark.createDataFrame([("g", "App", ["h", "r1"]), ("h", None, ["i"]), ("i", "UI", ["r2"])], "id string, path string, children array<string>")
    refs = spark.createDataFrame([("r1", "a.swift"), ("r2", "b.swift"), ("r3", "c.swift"), ("r4", "d.m")], "file_ref string, path string")
    t = spark.createDataFrame([("T", "p1")], "target string, phase_id string")
    p = manifest.links(spark.createDataFrame([("p1", ["b1", "b2", "b3", "b4"])], "id string, files array<string>"), "id", "files", "phase_id", "build_id")
    b = spark.createDataFrame([(f"b{i}", f"r{i}") for i in range(1, 5)], "build_id string, file_ref string")
    assert {tuple(r) for r in manifest.resolve_targets(t, p, b, refs, groups).collect()} == {("T", "App/a.swift"), ("T", "App/UI/b.swift"), ("T", "c.swift")}
    names = spark.createDataFrame([("App",), ("app",), ("AppTests",), ("Other",)], "name string")
    pick = lambda want: [r["name"] for r in manifest.choose_target(names, want).collect()]
    assert pick("App") == ["App"] and pick("APP") == ["App"] and pick("tests") == ["AppTests"] and pick("e") == [] and pick("zzz") == []


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(i, f"n{i}", "ok") for i in range(20)], "i int, name string, status string")
    sinks.write_splits(df, str(tmp_path / "s"), F.when(F.col("i") < 15, "risky").otherwise("safe"), spread=3)
    got = {(r["split"], r["count"]) for r in spark.read.parquet(str(tmp_path / "s")).groupBy("split").count().collect()}
    assert got == {("risky", 15), ("safe", 5)}
    for _ in range(2):
        sinks.log_decisions(df.limit(3), str(tmp_path / "d"), "exclude", "review")
    assert spark.read.json(str(tmp_path / "d")).where("kind = 'exclude' and basis = 'review'").count() == 6


def test_reports_and_scores(spark):
    edits = spark.createDataFrame([("p", "a", 2), ("p", "a", 3), ("q", "b", 1)], "project string, file string, n_edits int")
    got = {(r["project"], r["file"], r["n_files"], r["n_edits"]) for r in reports.edit_summary(edits).collect()}
    assert got == {("p", "a", 1, 5), ("q", "b", 1, 1), ("p", None, 1, 5), ("q", None, 1, 1), (None, None, 2, 6)}
    rows = spark.createDataFrame([("a", "s", "y"), ("b", "s", "y")], "name string, snippet string, symbol string")
    scored = review.score_candidates(rows, lambda n, s, y: '{"exclude": false}' if n == "a" else "{broken")
    assert {(r["name"], r["exclude"]) for r in scored.collect()} == {("a", False), ("b", True)}

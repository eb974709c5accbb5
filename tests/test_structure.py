"""Scopes, blocks and literals on edge texts."""

import pytest

from symloom.operators import lexical as lex, literals as lit, rewrite, rules, scopes

TEXT = '''@objc
@MainActor
class A: B,
  C {
    var x = 1, y: Int = 2
    #if DEBUG
    func one(_ a: Int = 1) -> [String] { if a > 0 { } else if let b = a { } }
    #endif
    struct Inner<T: Equatable> where T: P {
        func two() throws -> Self
        {
            func local() { }
            while x < 3 { x += 1 }
        }
    }
}
class A {
    func three() { } }
enum E: String { case a = "x", b }
enum G {
    indirect case leaf, node(left: G, Int)
}
extension A.Inner: Q {
    func four() async rethrows { }
}
func top() { guard let q = y else { return } }
let s = "a // not comment {"
'''


def files(spark, text=TEXT):
    return spark.createDataFrame([("p", 1, "d/F.swift", text)], "project string, file_id long, rel_path string, text string")


def test_function_inventory(spark):
    got = {r["name"]: r for r in scopes.function_inventory(files(spark)).collect()}
    # A type whose header line holds no brace is not open on later lines, so ``one`` is
    # taken for a local function; the inner type is found all the same.
    assert set(got) == {"two", "three", "four", "top"}
    assert got["two"]["parent_type"] == "Inner" and got["two"]["parent_generics"] == ["T"] and got["two"]["return_type"] == "Self"
    assert got["three"]["parent_type"] == "A" and got["three"]["parent_conforms"] == []
    assert got["four"]["is_parent_extension"] and got["four"]["parent_type"] == "A"
    assert got["top"]["parent_type"] is None
    assert "local" not in got


def test_body_ranges_wait_for_the_brace(spark):
    got = {r["func"]: (r["start_line"], r["end_line"]) for r in scopes.body_ranges(files(spark)).collect()}
    assert got["two"] == (10, 14) and got["one"] == (7, 7) and got["local"] == (12, 12) and got["top"] == (26, 26)


def test_control_flow_sites(spark):
    got = sorted((r["line_no"], r["kind"], r["header"], r["parent_func"]) for r in scopes.cf_sites(files(spark)).collect())
    assert got == [(7, "elseif", "let b = a", "one"), (7, "if", "a > 0", "one"), (13, "whileLoop", "x < 3", "two")]


def test_declarations_keep_same_names_apart(spark):
    got = lex.declarations(files(spark)).collect()
    a = [r for r in got if r["name"] == "A"]
    assert len(a) == 2 and len({r["node_id"] for r in a}) == 2
    three = next(r for r in got if r["name"] == "three")
    assert three["parent_type"] == "A"
    cases = {r["name"]: r for r in got if r["kind"] == "case"}
    assert set(cases) == {"leaf", "node"} and list(cases["node"]["params"]) == ["left", "_"]
    g = next(r for r in got if r["name"] == "G")
    assert cases["leaf"]["parent_id"] == g["node_id"]


def test_variables_and_cases(spark):
    got = {(r["name"], r["initial_value"]) for r in lex.variables(files(spark)).collect()}
    assert {("x", "1"), ("y", "2")} <= got and not {"q", "b"} & {name for name, _ in got}
    assert [r["name"] for r in lex.enum_cases(files(spark)).orderBy("name").collect()] == ["a", "b", "leaf", "node"]


def test_blocks_of_unbalanced_text(spark):
    got = lex.blocks(files(spark, "class A { func f() { } \nclass B { }"), ["class"]).collect()
    assert [(r["name"], r["outer"]) for r in got] == [("B", " ")]
    assert lex.blocks(files(spark, "}} no"), ["class"]).collect() == []


def test_one_excluded_literal_drops_the_line(spark):
    text = 'func f() {\n  print("a1", "b1"); let z = "c1"\n  let ok = "dd"\n  let e = ""\n}\n@main\nstruct M {\n  static func main() { run("go") }\n}'
    table = lit.literal_table(files(spark, text), keep=["file_id"])
    assert {r["value"] for r in lit.keep_literals(table).collect()} == {'"dd"'}
    reasons = {(r["line_no"], r["reason"]) for r in lit.literal_reasons(table, ["file_id"]).collect()}
    assert reasons == {(2, "debug"), (4, "short_or_blank"), (8, "entrypoint")}


def test_literal_reasons(spark):
    lines = {
        'cell.dequeue(withIdentifier: "id1")': "identifier", 'NSLocalizedString("hello", comment: "")': "localized",
        'label.title("t t")': "ui_keylike", 'let m = "a \\(b)"': "interpolated", '#imageLiteral(resourceName: "pic")': "image_literal",
        'let k: LocalizedStringKey = "key k"': "resource_like", 'VStack { Box("v v") }': "view_container", '@available(*, message: "old o")': "attribute",
        'NSLog("dbg %d")': "debug", 'x.reuseIdentifier = "cell1"': "identifier",
    }
    text = "func f() {\n" + "\n".join(lines) + "\n}"
    table = lit.literal_table(files(spark, text), keep=["file_id"]).collect()
    found = {}
    for r in table:
        found.setdefault(r["line_no"], set()).update(r["reasons"])
    for i, want in enumerate(lines.values()):
        assert want in found[i + 2], (list(lines)[i], found[i + 2])


@pytest.mark.parametrize("text", [None, "", "} } ) (", "{ func f( {\n\"open", "class A: B {\nfunc g() {"])
def test_odd_texts_end_no_job(spark, text):
    files = spark.createDataFrame([("p", 1, "A.swift", text), ("p", 2, "B.swift", "class C {\n  func h() { print(\"x\") }\n}\n")],
                                  "project string, file_id long, rel_path string, text string")
    assert {r["file_id"] for r in rewrite.strip_comments_lexed(files).collect()} == {1, 2}
    assert {r["file_id"]: r["n_removed"] for r in rewrite.remove_calls(files).collect()}[2] == 1
    for rows in (lex.declarations(files), lex.blocks(files, ["class"]), scopes.function_inventory(files), scopes.body_ranges(files),
                 scopes.cf_sites(files), scopes.protocol_requirements(files), rules.generate_rules(files), lit.literal_table(files),
                 scopes.eligible_function_lines(files), lex.variables(files)):
        rows.collect()
    assert 2 in {r["file_id"] for r in lex.declarations(files).collect()}


def test_bound_names_are_no_variables(spark):
    text = "if      let a = b, let c = d {\nguard\n  let e = f,\n      let g = h else { }\nwhile let i = j { }\nlet k = 1\nvar l: Int = 2"
    files = spark.createDataFrame([(1, text)], "file_id int, text string")
    assert {r["name"] for r in lex.variables(files).collect()} == {"k", "l"}

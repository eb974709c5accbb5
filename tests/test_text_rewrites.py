import pytest

from symloom.functions import calls as cl
from symloom.functions.comments import strip_comments
from symloom.operators import rewrite


@pytest.mark.parametrize("before, after", [
    ("a // c\nb", "a\nb"),
    ("// only\nb", "b"),
    ("  /* x */\nb", "b"),
    ("a /* x /* nested */ y */ b", "a b"),
    ('let s = "no // comment" // yes', 'let s = "no // comment"'),
    ('let s = "\\(f("//") /* in */) // out"', 'let s = "\\(f("//")) // out"'),
    ('#"raw // "quote" \\" "# // c', '#"raw // "quote" \\" "#'),
    ('"""\n// kept\n""" // gone', '"""\n// kept\n"""'),
    ("let r = /a\\/\\/b/ // c", "let r = /a\\/\\/b/"),
    ("a / b // c", "a / b"),
    ("x /* open", "x"),
    ("", ""),
])
def test_strip_comments(before, after):
    assert strip_comments(before) == after
    assert strip_comments(after) == after


def remove(text, names=cl.DEBUG_NAMES):
    return cl.remove_calls(text, names, cl.QUIET_NAMES)


def test_inline_and_multiline_calls():
    assert remove('a(); print("x)"); b()') == ("a(); b()", 1)
    assert remove('{ print(1) }') == ("{  }", 1)
    assert remove('print(\n  "a (",\n  f(1)\n) ; next()') == ("next()", 1)
    assert remove("x.print(1); my_print(2)") == ("x.print(1); my_print(2)", 0)
    assert remove("Swift.print(1)") == ("", 1)


def test_calls_and_closures_of_any_length():
    long_call = "print(\n" + "1,\n" * 450 + "2)"
    assert remove(long_call) == ("", 1)
    assert cl.call_spans(long_call, cl.DEBUG_NAMES) == [("print", False, 1, 452)]
    closure = "xs.map {\n" + "a\n" * 450 + "print($0)\n}"
    assert remove(closure) == (closure, 0)
    assert remove("print(\n1") == ("print(\n1", 0)


def test_null_texts():
    assert remove(None) == (None, 0) and cl.call_spans(None, cl.DEBUG_NAMES) == [] and strip_comments(None) is None


def test_statement_is_kept_in_case_and_guard():
    assert remove("case .a:\n    print(1)")[0] == 'case .a:\n    print("")'
    assert remove("guard let x = y else {\n    assert(x)\n}")[0].splitlines()[1] == "    assert(true)"
    assert remove("case .a:\nfunc f() {\n  print(1)\n}")[0] == "case .a:\nfunc f() {\n\n}"


def test_trailing_closure_block_is_left_alone():
    text = "xs.forEach {\n  print($0)\n}"
    assert remove(text) == (text, 0)
    assert remove("let s = Thread.callStackSymbols\nThread.callStackSymbols.count")[0] == 'let s = ""\n[].count'


def test_call_spans():
    text = "// print(1)\nfunc print(x: Int) {\n  dump(x)\n}\nprint(\n 1)\nThread.callStackSymbols\na.dump(2)\nSwift.assert(true)"
    assert cl.call_spans(text, cl.DEBUG_NAMES) == [
        ("print", False, 5, 6), ("Thread.callStackSymbols", False, 7, 7), ("assert", True, 9, 9)]


def test_own_functions_are_not_debug_calls(spark):
    files = spark.createDataFrame([(1, "func dump(x: Int) { }\ndump(1)\nprint(2)"), (2, "dump(3)\nSwift.dump(4)")], "file_id int, text string")
    got = rewrite.debug_calls(files, rewrite.user_defined(files)).select("file_id", "name", "start_line").collect()
    assert sorted(map(tuple, got)) == [(1, "print", 3), (2, "dump", 2)]


def test_pseudonymize_paths_agree(spark):
    files = spark.createDataFrame([(1, 'let url = "url" // url\nf($url, `url`, url2, naïve)'), (2, None), (3, "nothing")], "file_id int, text string")
    pairs = spark.createDataFrame([("url", "addr"), ("naïve", "clever")], "target string, replacement string")
    for profile, want in (("swift", 'let addr = "url" // url\nf($addr, `addr`, url2, clever)'), ("plain", 'let addr = "addr" // addr\nf($addr, `addr`, url2, clever)')):
        for out in (rewrite.pseudonymize(files, pairs, "file_id", profile=profile),
                    rewrite.pseudonymize_by_table(files, dict(map(tuple, pairs.collect())), profile=profile)):
            assert dict(map(tuple, out.collect())) == {1: want, 2: None, 3: "nothing"}

import random

import pytest
from pyspark.sql import functions as F

from symloom.functions import names as nm, similarity as sim, text as tx


def rows(spark, values, **cols):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [tuple(r)[1:] for r in df.select("i", *[c.alias(n) for n, c in cols.items()]).orderBy("i").collect()]


def split_by_hand(name):
    """Independent statement of the rule: walk the letters, remember the current token."""
    out = []
    for chunk in name.replace("-", "_").split("_"):
        token = ""
        for ch in chunk:
            lone_capital = len(token) > 1 and token[-1].isupper() and not token[-2].isupper()
            if token and ch.isupper() and (token[-1].islower() or lone_capital):
                out.append(token)
                token = ""
            token += ch
        if token:
            out.append(token)
    return out


def test_split_edges_and_random(spark):
    rng = random.Random(7)
    edges = ["a1BCDfooBar", "URLSession", "snake_case", "SCREAMING_CASE", "kebab-name", "`tick`", "$name", "", "___", "aB", "ABc", "1A2B"]
    names = edges + ["".join(rng.choice("abAB1_-é") for _ in range(rng.randint(1, 9))) for _ in range(400)]
    got = rows(spark, names, t=nm.split_ident("v"), n=nm.normalize("v"))
    for name, (tokens, normal) in zip(names, got):
        # A lone capital is judged within its token, which restarts after each cut.
        assert tokens == split_by_hand(name), name
        assert normal == ("".join(t.lower() for t in split_by_hand(name)) or name.lower())


def test_casing(spark):
    got = rows(spark, ["fooBar", "FooBar", "foo_bar", "FOO_BAR", "_", "9x", "", "`a"], c=nm.casing("v"))
    assert [g[0] for g in got] == ["camel", "pascal", "snake", "screaming", "snake", "any", "any", "any"]


def test_params(spark):
    got = rows(spark, ["", "a: Int", "_ b: [A, B] = [1, 2], with c: (Int, Int) -> Void", "x: Map<K, V>, _: Int", ","],
               s=nm.split_params("v"), l=nm.param_labels("v"), n=nm.param_names("v"), d=nm.has_default("v"))
    assert got[0] == ([], [], [], False)
    assert got[1] == (["a: Int"], ["a"], ["a"], False)
    assert got[2] == (["_ b: [A, B] = [1, 2]", " with c: (Int, Int) -> Void"], ["_", "with"], ["b", "c"], True)
    assert got[3] == (["x: Map<K, V>", " _: Int"], ["x", "_"], ["x", "arg"], False)
    assert got[4] == ([], [], [], False)


def test_unescape(spark):
    values = [r'"a\nb"', r'"\\n"', r'"\u{1F600}x"', r'"\u{110000}"', r'"tab\t\0"', '"plain"', r'"\q"', '"""\nx\n"""', '"end\\"']
    got = [g[0] for g in rows(spark, values, p=nm.unescape(nm.unquote("v")))]
    assert got == ["a\nb", "\\n", "\U0001F600x", r"\u{110000}", "tab\t\0", "plain", r"\q", "\nx\n", "end\\"]


def test_specs_and_types(spark):
    got = rows(spark, ["function:A.B.c", "x", " : y ", "a..b", "", "kind:"], s=nm.parse_spec("v"))
    assert [tuple(g[0]) for g in got] == [("function", ["A", "B"], "c"), (None, [], "x"), (None, [], "y"), (None, ["a"], "b"), (None, [], ""), ("kind", [], "")]
    got = rows(spark, ["[Int]?", "Map<K, V>!", "A.B", None, "[String: Int]"], t=nm.type_base("v"))
    assert [g[0] for g in got] == ["Int", "Map", "A.B", "", "String: Int"]


@pytest.mark.parametrize("a, b, want", [
    ("", "", 1.0), ("a", "", 0.0), ("", "a", 0.0), ("a", "a", 1.0), ("a", "b", 0.0), ("martha", "marhta", 0.9611111),
    ("dixon", "dicksonx", 0.8133333), ("abcd", "bcda", 0.8333333), ("crate", "trace", 0.7333333)])
def test_jaro_winkler_values(a, b, want):
    assert sim.jaro_winkler_value(a, b) == pytest.approx(want, abs=1e-6)


def test_jaro_winkler_random():
    def by_hand(s, t):
        if s == t:
            return 1.0
        if not s or not t:
            return 0.0
        reach = max(len(s), len(t)) // 2 - 1
        pairs, used = [], set()
        for i, ch in enumerate(s):
            for j in range(max(0, i - reach), min(len(t), i + reach + 1)):
                if j not in used and t[j] == ch:
                    used.add(j)
                    pairs.append(i)
                    break
        m = len(pairs)
        if not m:
            return 0.0
        odd = sum(s[i] != t[j] for i, j in zip(pairs, sorted(used))) / 2
        jaro = (m / len(s) + m / len(t) + (m - odd) / m) / 3
        p = 0
        while p < min(4, len(s), len(t)) and s[p] == t[p]:
            p += 1
        return jaro + p * 0.1 * (1 - jaro)

    rng = random.Random(3)
    for _ in range(3000):
        a, b = ("".join(rng.choice("abcde") for _ in range(rng.randint(0, 10))) for _ in range(2))
        assert sim.jaro_winkler_value(a, b) == pytest.approx(by_hand(a, b), abs=1e-12)


def test_token_jaccard_empty(spark):
    got = rows(spark, ["", "view", "fooBar"], j=sim.token_jaccard("v", F.lit("barFoo")), e=sim.token_jaccard("v", F.lit("Manager")))
    assert [tuple(g) for g in got] == [(0.0, 0.0), (0.0, 0.0), (1.0, 0.0)]


def test_text_helpers(spark):
    got = rows(spark, ["a /* x\ny */ b // c\nd", "\n\na  \n\n\n\nb\t\n\n"], s=tx.strip_comments("v"), b=tx.blank_comments("v"), q=tx.squeeze("v"))
    assert got[0][0] == "a  b \nd" and got[0][1] == "a     \n     b     \nd"
    assert got[1][2] == "a\n\nb"
    got = rows(spark, ["no", 'x {"a": {"b": 1}} y {"c": 2}', "```json\n{\"k\": \"}\"}\n```", "{bad} {\"ok\": []}", None], j=tx.first_json("v"))
    assert [g[0] for g in got] == [None, '{"a": {"b": 1}}', '{"k": "}"}', '{"ok": []}', None]

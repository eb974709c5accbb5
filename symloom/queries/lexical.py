"""Queries that turn texts into rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from symloom.operators import lexical as lex, rewrite, scopes
from symloom.queries.derived import SWIFT, render, swift_files, table
from symloom.queries.registry import query
from symloom.sources.lists import clean_names

_K = "CAST(p_partkey AS STRING)"
_S = "CAST(p_size AS STRING)"


def _pages(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.col("html").alias("text"))


@query("identifiers_markup", r"""
    SELECT DISTINCT unnest(regexp_extract_all(html, '<([a-z][a-z0-9]*)', 1) || regexp_extract_all(html, '\b([A-Za-z_][A-Za-z0-9_]*)\([0-9]+\)', 1)
      || regexp_extract_all(html, '\bvar\s+([A-Za-z_][A-Za-z0-9_]*)', 1)) AS name FROM pages""")
def identifiers_markup(spark, sf):
    return lex.identifiers(_pages(spark, sf), "markup")


@query("identifiers_code", f"""
    SELECT DISTINCT unnest(['Hidden' || {_K}, 'commented' || {_K}, 'Part' || {_K}, 'title' || {_K}, 'count' || {_K}, 'load' || {_K}, 'url', 'other',
      'draw' || {_K}, 'Mode' || {_K}, 'nested' || {_K}, 'inner' || {_K}, 'Part' || CAST(p_partkey % 50 AS STRING), 'extra' || {_K},
      'Proto' || CAST(p_partkey % 11 AS STRING), 'Store' || {_K}, 'peek' || {_K}, 'poke' || {_K}, 'Pair' || {_K}, 'free' || {_K}, 'top' || {_K}]) AS name FROM part""")
def identifiers_code(spark, sf):
    return lex.identifiers(swift_files(spark, sf), "swift")


@query("symbols_markup", r"""
    SELECT DISTINCT * FROM (SELECT page_id, unnest(list_transform(regexp_extract_all(html, '<([a-z][a-z0-9]*)', 1), lambda x: {'kind': 'element', 'name': x})
      || list_transform(regexp_extract_all(html, 'class="([^"]+)"', 1), lambda x: {'kind': 'class', 'name': x})
      || list_transform(regexp_extract_all(html, '\b([A-Za-z_][A-Za-z0-9_]*\([^)]*\))', 1), lambda x: {'kind': 'method', 'name': x})
      || list_transform(regexp_extract_all(html, '\bvar\s+([A-Za-z_][A-Za-z0-9_]*)', 1), lambda x: {'kind': 'variable', 'name': x}), recursive := true) FROM pages)""")
def symbols_markup(spark, sf):
    return lex.symbols(_pages(spark, sf), "markup").select("page_id", "kind", "name")


@query("symbols_code", f"""
    SELECT p_partkey AS file_id, unnest([
      {{'kind': 'class', 'name': 'Hidden' || {_K}}}, {{'kind': 'class', 'name': 'Part' || {_K}}}, {{'kind': 'enum', 'name': 'Mode' || {_K}}},
      {{'kind': 'method', 'name': 'commented' || {_K} || '()'}}, {{'kind': 'method', 'name': 'load' || {_K} || '(with id: Int, _ flag: [String: Int])'}},
      {{'kind': 'method', 'name': 'draw' || {_K} || '(rect: Rect' || CAST(p_partkey % 3 AS STRING) || ' = zero)'}}, {{'kind': 'method', 'name': 'nested' || {_K} || '()'}},
      {{'kind': 'method', 'name': 'inner' || {_K} || '()'}}, {{'kind': 'method', 'name': 'extra' || {_K} || '(cb: @escaping (Int)'}},
      {{'kind': 'method', 'name': 'draw' || {_K} || '(rect: Int)'}}, {{'kind': 'method', 'name': 'peek' || {_K} || '()'}},
      {{'kind': 'method', 'name': 'poke' || {_K} || '(_ x: inout Int, y: Mode' || {_K} || ')'}}, {{'kind': 'method', 'name': 'free' || {_K} || '()'}},
      {{'kind': 'variable', 'name': 'title' || {_K}}}, {{'kind': 'variable', 'name': 'count' || {_K}}}, {{'kind': 'variable', 'name': 'url'}},
      {{'kind': 'variable', 'name': 'other'}}, {{'kind': 'variable', 'name': 'top' || {_K}}}], recursive := true) FROM part""")
def symbols_code(spark, sf):
    return lex.symbols(swift_files(spark, sf), "swift").select("file_id", "kind", "name")


def _decl(name, kind, line, access="internal", attrs="''", adopted="''", params="''", types="''", ret="NULL", init="NULL", parent="NULL"):
    return (f"{{'name': {name}, 'kind': '{kind}', 'line': {line}, 'access': '{access}', 'attributes': {attrs}, 'adopted': {adopted}, 'params': {params}, "
            f"'param_types': {types}, 'return_type': {ret}, 'initial_value': {init}, 'parent': {parent}}}")


_P = f"'Part' || {_K}"
_DECLS = ", ".join([
    _decl(_P, "class", 7, "public", "CASE WHEN p_size % 5 = 0 THEN 'MainActor|final' ELSE 'final' END",
          "'Base' || CAST(p_size % 9 AS STRING) || '|Proto' || CAST(p_partkey % 11 AS STRING)"),
    _decl(f"'title' || {_K}", "variable", 8, "private", init="'\"' || p_name || '\"'", parent=_P),
    _decl(f"'count' || {_K}", "variable", 9, attrs="'objc'", init=_S, parent=_P),
    _decl(f"'load' || {_K}", "function", 10, attrs="'static'", params="'with|_'", types="'Int|[String: Int]'", ret="'String'", parent=_P),
    _decl("'url'", "variable", 11, init="'\"' || p_type || '\"'", parent=_P),
    _decl(f"'draw' || {_K}", "function", 24, attrs="'override'", params="'rect'", types="'Rect' || CAST(p_partkey % 3 AS STRING)", parent=_P),
    _decl(f"'Mode' || {_K}", "enum", 25, adopted="'String'", parent=_P),
    _decl(f"'on' || {_K}", "case", 26, parent=f"'Mode' || {_K}"),
    _decl("'off'", "case", 26, params="'level|_'", types="'Int|Double'", parent=f"'Mode' || {_K}"),
    _decl(f"'nested' || {_K}", "function", 28, ret="'some View'", parent=_P),
    _decl(f"'inner' || {_K}", "function", 29, parent=_P),
    _decl("'Part' || CAST(p_partkey % 50 AS STRING)", "extension", 33, adopted="'Printable' || CAST(p_partkey % 4 AS STRING)"),
    _decl(f"'extra' || {_K}", "function", 34, params="'cb'", types="'@escaping (Int) -> Void'", parent="'Part' || CAST(p_partkey % 50 AS STRING)"),
    _decl("'Proto' || CAST(p_partkey % 11 AS STRING)", "protocol", 36),
    _decl(f"'draw' || {_K}", "function", 37, params="'rect'", types="'Int'", parent="'Proto' || CAST(p_partkey % 11 AS STRING)"),
    _decl(f"'Store' || {_K}", "actor", 39),
    _decl(f"'peek' || {_K}", "function", 40, attrs="'nonisolated'", parent=f"'Store' || {_K}"),
    _decl(f"'poke' || {_K}", "function", 41, params="'_|y'", types=f"'inout Int|Mode' || {_K}", parent=f"'Store' || {_K}"),
    _decl(f"'Pair' || {_K}", "typealias", 43),
    _decl(f"'free' || {_K}", "function", 44, ret="'Self'"),
    _decl(f"'top' || {_K}", "variable", 45, init="'\"' || p_brand || '\"'"),
])


@query("declarations_code", f"""
    SELECT p_partkey AS file_id, unnest([{_DECLS}], recursive := true) FROM part""")
def declarations_code(spark, sf):
    d = lex.declarations(swift_files(spark, sf))
    joined = [F.array_join(c, "|").alias(c) for c in ("attributes", "adopted", "params", "param_types")]
    return d.select("file_id", "name", "kind", F.col("loc.line").alias("line"), "access", *joined, "return_type", "initial_value",
                    F.col("parent_type").alias("parent"))


@query("variables_markup", r"""
    SELECT page_id, regexp_extract(d, '\bvar\s+([A-Za-z_][A-Za-z0-9_]*)', 1) AS name, trim(regexp_extract(d, '=\s*("[^"]*"|[^;"]*)', 1)) AS initial_value
    FROM (SELECT page_id, unnest(regexp_extract_all(html, '\bvar\s+[A-Za-z_][A-Za-z0-9_]*\s*=\s*(?:"[^"]*"|[^;"]*)')) AS d FROM pages)""")
def variables_markup(spark, sf):
    return lex.variables(_pages(spark, sf), "markup")


@query("variables_code", f"""
    SELECT p_partkey AS file_id, unnest([{{'name': 'title' || {_K}, 'initial_value': '"' || p_name || '"'}}, {{'name': 'count' || {_K}, 'initial_value': {_S}}},
      {{'name': 'url', 'initial_value': '"' || p_type || '"'}}, {{'name': 'top' || {_K}, 'initial_value': '"' || p_brand || '"'}}],
      recursive := true) FROM part""")
def variables_code(spark, sf):
    return lex.variables(swift_files(spark, sf), keep=["file_id"])


@query("enum_cases_code", f"""
    SELECT p_partkey AS file_id, unnest([{{'name': 'on' || {_K}, 'labels': '', 'types': ''}}, {{'name': 'off', 'labels': 'level|_', 'types': 'Int|Double'}}], recursive := true) FROM part""")
def enum_cases_code(spark, sf):
    c = lex.enum_cases(swift_files(spark, sf), keep=["file_id"])
    return c.select("file_id", "name", F.array_join("labels", "|").alias("labels"), F.array_join("types", "|").alias("types"))


@query("imports_code", """
    SELECT p_partkey AS file_id, unnest(['Foundation', 'Kit' || CAST(p_size % 7 AS STRING)]) AS module FROM part""")
def imports_code(spark, sf):
    return lex.imports(swift_files(spark, sf), keep=["file_id"])


@query("import_list", """
    SELECT DISTINCT unnest(['Swift', 'Foundation', 'Kit' || CAST(p_size % 7 AS STRING)]) AS module FROM part""")
def import_list(spark, sf):
    from symloom.operators.catalog import import_list as merged

    return merged(lex.imports(swift_files(spark, sf), keep=["file_id"]))


@query("aliases_code", f"""
    SELECT p_partkey AS file_id, 'Pair' || {_K} AS alias, 'Proto' || CAST(p_partkey % 11 AS STRING) || '|Proto' || CAST((p_partkey + 1) % 11 AS STRING) AS protocols FROM part""")
def aliases_code(spark, sf):
    a = lex.aliases(swift_files(spark, sf), keep=["file_id"])
    return a.select("file_id", "alias", F.array_join("protocols", "|").alias("protocols"))


def _fn(name, line, parent, kind, params, types, ret="NULL", mods="''", static="false", conforms="''", ext="false", actor="false"):
    return (f"{{'name': {name}, 'line_no': {line}, 'parent_type': {parent}, 'parent_kind': '{kind}', 'params_src': {params}, 'param_types': {types}, "
            f"'return_type': {ret}, 'modifiers': {mods}, 'is_static': {static}, 'parent_conforms': {conforms}, 'is_parent_extension': {ext}, 'parent_actor': {actor}}}")


_CONF = "'Base' || CAST(p_size % 9 AS STRING) || '|Proto' || CAST(p_partkey % 11 AS STRING)"
_MAIN = "p_size % 5 = 0"
_FUNCS = ", ".join([
    _fn(f"'load' || {_K}", 10, _P, "class", "'with id: Int, _ flag: [String: Int]'", "'Int|[String: Int]'", "'String'", "'static'", "true", _CONF, actor=_MAIN),
    _fn(f"'draw' || {_K}", 24, _P, "class", "'rect: Rect' || CAST(p_partkey % 3 AS STRING) || ' = zero'", "'Rect' || CAST(p_partkey % 3 AS STRING)", mods="'override'", conforms=_CONF, actor=_MAIN),
    _fn(f"'nested' || {_K}", 28, _P, "class", "''", "''", "'some View'", conforms=_CONF, actor=_MAIN),
    _fn(f"'extra' || {_K}", 34, "'Part' || CAST(p_partkey % 50 AS STRING)", "extension", "'cb: @escaping (Int) -> Void'", "'@escaping (Int) -> Void'", "NULL", conforms="'Printable' || CAST(p_partkey % 4 AS STRING)", ext="true"),
    _fn(f"'peek' || {_K}", 40, f"'Store' || {_K}", "actor", "''", "''", mods="'nonisolated'"),
    _fn(f"'poke' || {_K}", 41, f"'Store' || {_K}", "actor", f"'_ x: inout Int, y: Mode' || {_K}", f"'inout Int|Mode' || {_K}"),
    _fn(f"'free' || {_K}", 44, "NULL", "", "''", "''", "'Self'"),
])


@query("function_inventory", f"SELECT p_partkey AS file_id, unnest([{_FUNCS}], recursive := true) FROM part")
def function_inventory(spark, sf):
    f = scopes.function_inventory(swift_files(spark, sf))
    return f.select("file_id", "name", "line_no", "parent_type", "parent_kind", "params_src", F.array_join("param_types", "|").alias("param_types"),
                    "return_type", F.array_join("modifiers", "|").alias("modifiers"), "is_static", F.array_join("parent_conforms", "|").alias("parent_conforms"),
                    "is_parent_extension", F.col("parent_has_actor_attr").alias("parent_actor"))


@query("functions_with_members", f"""
    SELECT p_partkey AS file_id, unnest([{{'func': 'load' || {_K}, 'variable': 'url', 'value': '"' || p_type || '"'}}], recursive := true) FROM part""")
def functions_with_members(spark, sf):
    """Variables declared directly in a function's body."""
    files = swift_files(spark, sf).select("file_id", "text")
    bodies = lex.blocks(files.withColumn("text", F.regexp_replace("text", r"\bfunc\s+(\w+)\s*\([^{]*\{", "func $1 {")), ["func"], keep=["file_id"], parts=("outer",))
    inner = lex.variables(bodies.select("file_id", F.col("name").alias("func"), F.col("outer").alias("text")))
    return inner.select("file_id", "func", F.col("name").alias("variable"), F.col("initial_value").alias("value"))


@query("blocks_code", f"""
    SELECT p_partkey AS file_id, unnest([{{'kind': 'class', 'name': 'Part' || {_K}}}, {{'kind': 'enum', 'name': 'Mode' || {_K}}},
      {{'kind': 'extension', 'name': 'Part' || CAST(p_partkey % 50 AS STRING)}}, {{'kind': 'protocol', 'name': 'Proto' || CAST(p_partkey % 11 AS STRING)}},
      {{'kind': 'actor', 'name': 'Store' || {_K}}}], recursive := true) FROM part""")
def blocks_code(spark, sf):
    from symloom.functions.text import strip_comments

    files = swift_files(spark, sf).withColumn("text", strip_comments("text"))
    return lex.blocks(files, ["class", "struct", "enum", "protocol", "actor", "extension"], keep=["file_id"], parts=()).select("file_id", "kind", "name")


@query("top_level_functions", f"""
    SELECT p_partkey AS file_id, unnest([{{'name': 'Part' || {_K}, 'func': 'load' || {_K}, 'mods': 'static'}}, {{'name': 'Part' || {_K}, 'func': 'draw' || {_K}, 'mods': 'override'}},
      {{'name': 'Part' || {_K}, 'func': 'nested' || {_K}, 'mods': ''}}, {{'name': 'Part' || CAST(p_partkey % 50 AS STRING), 'func': 'extra' || {_K}, 'mods': ''}},
      {{'name': 'Proto' || CAST(p_partkey % 11 AS STRING), 'func': 'draw' || {_K}, 'mods': ''}}, {{'name': 'Store' || {_K}, 'func': 'peek' || {_K}, 'mods': 'nonisolated'}},
      {{'name': 'Store' || {_K}, 'func': 'poke' || {_K}, 'mods': ''}}], recursive := true) FROM part""")
def top_level_functions(spark, sf):
    from symloom.functions.text import strip_comments

    files = swift_files(spark, sf).withColumn("text", strip_comments("text"))
    found = lex.blocks(files, ["class", "struct", "enum", "protocol", "actor", "extension"], keep=["file_id"], parts=("outer_lines",))
    return lex.top_level_funcs(found).select("file_id", "name", "func", "mods")


@query("body_ranges", f"""
    SELECT p_partkey AS file_id, unnest([{{'func': 'load' || {_K}, 'start_line': 10, 'end_line': 23}}, {{'func': 'draw' || {_K}, 'start_line': 24, 'end_line': 24}},
      {{'func': 'nested' || {_K}, 'start_line': 28, 'end_line': 31}}, {{'func': 'inner' || {_K}, 'start_line': 29, 'end_line': 29}},
      {{'func': 'extra' || {_K}, 'start_line': 34, 'end_line': 34}}, {{'func': 'peek' || {_K}, 'start_line': 40, 'end_line': 40}},
      {{'func': 'poke' || {_K}, 'start_line': 41, 'end_line': 41}}, {{'func': 'free' || {_K}, 'start_line': 44, 'end_line': 44}}], recursive := true) FROM part""")
def body_ranges(spark, sf):
    from symloom.functions.text import blank_comments

    files = swift_files(spark, sf).select("file_id", blank_comments("text").alias("text"))
    return scopes.body_ranges(files)


@query("control_flow_sites", f"""
    SELECT p_partkey AS file_id, unnest([{{'line_no': 12, 'kind': 'if', 'header': 'count' || {_K} || ' > 3', 'parent_func': 'load' || {_K}}},
      {{'line_no': 14, 'kind': 'elseif', 'header': 'let other = url', 'parent_func': 'load' || {_K}}},
      {{'line_no': 19, 'kind': 'forIn', 'header': '(a, b) in pairs', 'parent_func': 'load' || {_K}}}], recursive := true) FROM part""")
def control_flow_sites(spark, sf):
    return scopes.cf_sites(swift_files(spark, sf).select("file_id", "text"))


_LEXED = render(SWIFT.replace("// class Hidden<<p_partkey>>: Nothing { }\n", "").replace("/* block func commented<<p_partkey>>() {\n*/\n", ""))


@query("strip_comments_lexed", f"SELECT p_partkey AS file_id, md5({_LEXED}) AS digest FROM part")
def strip_comments_lexed(spark, sf):
    return rewrite.strip_comments_lexed(swift_files(spark, sf).select("file_id", "text")).select("file_id", F.md5("text").alias("digest"))


@query("literals_markup", r"""
    SELECT page_id, line_no, v AS value, count(*) AS n FROM (
      SELECT page_id, line_no, unnest(regexp_extract_all(line, '"[^"<>]*"')) AS v FROM (
        SELECT page_id, unnest(string_split(html, chr(10))) AS line, generate_subscripts(string_split(html, chr(10)), 1) AS line_no FROM pages))
    GROUP BY ALL""")
def literals_markup(spark, sf):
    rows = lex.literals(_pages(spark, sf), "markup", keep=["page_id"])
    return rows.groupBy("page_id", F.col("line_no").cast("long").alias("line_no"), "value").agg(F.count("*").alias("n"))


@query("literals_code", f"""
    SELECT p_partkey AS file_id, unnest([{{'line_no': 8, 'value': '"' || p_name || '"'}}, {{'line_no': 11, 'value': '"' || p_type || '"'}}, {{'line_no': 13, 'value': '"load ' || {_K} || '"'}},
      {{'line_no': 16, 'value': '"x)"'}}, {{'line_no': 30, 'value': '"hi ' || p_name || '"'}}, {{'line_no': 45, 'value': '"' || p_brand || '"'}}], recursive := true) FROM part""")
def literals_code(spark, sf):
    return lex.literals(swift_files(spark, sf), "swift", keep=["file_id"]).select("file_id", "line_no", "value")


@query("text_literals", f"""
    SELECT p_partkey AS file_id, unnest([{{'line_no': 2, 'value': '"a"'}}, {{'line_no': 2, 'value': '\"\"\"' || chr(10) || p_name || ' "q" ' || chr(10) || '\"\"\"'}},
      {{'line_no': 5, 'value': '"b' || chr(92) || '"' || {_K} || '"'}}], recursive := true) FROM part""")
def text_literals(spark, sf):
    text = F.expr(render('\nf("a", """\n<<p_name>> "q" \n""")\nlet z = "b<<chr(92)>>"<<p_partkey>>"'))
    return lex.text_literals(table(spark, sf, "part").select(F.col("p_partkey").alias("file_id"), text.alias("text"))).select("file_id", "line_no", "value")


_UNDER = render("let _a<<p_size>> = _b<<p_partkey % 97>> + _c<<p_size % 10>>\nvar _c<<p_size % 20>>: Int = _9x")


def _underscored(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.expr(_UNDER).alias("text"))


@query("underscore_names", f"""
    SELECT DISTINCT * FROM (SELECT unnest([{{'role': 'use', 'name': 'a' || {_S}}}, {{'role': 'use', 'name': 'b' || CAST(p_partkey % 97 AS STRING)}}, {{'role': 'use', 'name': 'c' || CAST(p_size % 10 AS STRING)}},
      {{'role': 'use', 'name': 'c' || CAST(p_size % 20 AS STRING)}}, {{'role': 'use', 'name': '9x'}}, {{'role': 'declared', 'name': 'a' || {_S}}},
      {{'role': 'declared', 'name': 'c' || CAST(p_size % 20 AS STRING)}}], recursive := true) FROM part)""")
def underscore_names(spark, sf):
    return lex.underscore_names(_underscored(spark, sf))


@query("wrapper_candidates", f"""
    SELECT DISTINCT unnest(['a' || {_S}, 'b' || CAST(p_partkey % 97 AS STRING), 'c' || CAST(p_size % 10 AS STRING), 'c' || CAST(p_size % 20 AS STRING), '9x']) AS name FROM part
    EXCEPT SELECT unnest(['a' || {_S}, 'c' || CAST(p_size % 20 AS STRING)]) FROM part""")
def wrapper_candidates(spark, sf):
    return lex.wrapper_candidates(_underscored(spark, sf))


@query("read_name_lines", r"""
    SELECT name, count(*) AS n FROM (SELECT trim(unnest(string_split(text, chr(10)))) AS name FROM documents) WHERE name <> '' AND name NOT LIKE '#%' GROUP BY name""")
def read_name_lines(spark, sf):
    raw = table(spark, sf, "documents").select(F.explode(F.split("text", "\n")).alias("value"))
    return clean_names(raw).groupBy("name").agg(F.count("*").alias("n"))

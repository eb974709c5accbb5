"""Queries over the token index, rewrites and review records."""

from __future__ import annotations

from pyspark.sql import functions as F

from symloom.functions.text import strip_comments
from symloom.operators import review, rewrite, tokens as tok
from symloom.queries.derived import SWIFT, SWIFT_2, SWIFT_PATH, render, second_files, swift_files, table
from symloom.queries.registry import query

_K = "CAST(p_partkey AS STRING)"
_WORD = r"[\p{L}_][\p{L}\p{N}_]*"

# Lines and words of documents, shared by several oracles.
_LINES = "lines AS (SELECT doc_id, lpad(CAST(doc_id AS STRING), 9, '0') AS path, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents)"
_WORDS = f"bench AS (SELECT DISTINCT unnest(regexp_extract_all(text, '{_WORD}')) AS name FROM benchmark)"
_HITS = f"hits AS (SELECT name, min({{'path': path, 'line_no': line_no}}) AS spot FROM (SELECT path, line_no, unnest(regexp_extract_all(line, '{_WORD}')) AS name FROM lines) SEMI JOIN bench USING (name) GROUP BY name)"


def _docs(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", F.lpad(F.col("doc_id").cast("string"), 9, "0").alias("path"), "text")


def _bench_words(spark, sf):
    return table(spark, sf, "benchmark").select(F.explode(tok.words("text")).alias("name")).distinct()


@query("first_file_of_names", f"WITH {_LINES}, {_WORDS}, {_HITS} SELECT name, spot.path AS path, spot.line_no AS line_no FROM hits")
def first_file_of_names(spark, sf):
    return tok.first_file(_bench_words(spark, sf), _docs(spark, sf), "path")


@query("body_references", f"""
    WITH sym AS (SELECT token, min(item_id) AS ordinal FROM (SELECT item_id, unnest(regexp_extract_all(text, '{_WORD}')) AS token FROM benchmark) GROUP BY token),
    used AS (SELECT DISTINCT doc_id, lang, unnest(regexp_extract_all(text, '{_WORD}')) AS token FROM documents),
    hit AS (SELECT doc_id, token, row_number() OVER (PARTITION BY doc_id ORDER BY ordinal, token) AS rn FROM used JOIN sym USING (token) WHERE token <> lang)
    SELECT doc_id, string_agg(token, '|' ORDER BY rn) AS refs FROM hit GROUP BY doc_id""")
def body_references(spark, sf):
    symbols = table(spark, sf, "benchmark").select(F.col("item_id").alias("ordinal"), F.explode(tok.words("text")).alias("name"))
    bodies = table(spark, sf, "documents").select("doc_id", F.col("lang").alias("name"), F.col("text").alias("body"))
    return tok.body_refs(bodies, symbols, ["doc_id"]).select("doc_id", F.array_join("refs", "|").alias("refs"))


@query("context_snippets", f"""
    WITH {_LINES}, {_WORDS}, {_HITS}, cut AS (
      SELECT name, spot.path AS path, greatest(spot.line_no - 2, 1) AS start_line, least(spot.line_no + 2, len(string_split(text, chr(10)))) AS end_line, string_split(text, chr(10)) AS l
      FROM hits JOIN documents ON spot.path = lpad(CAST(doc_id AS STRING), 9, '0'))
    SELECT name, path, start_line, end_line, array_to_string(l[start_line:end_line], chr(10)) AS snippet FROM cut""")
def context_snippets(spark, sf):
    docs = _docs(spark, sf)
    hits = tok.first_file(_bench_words(spark, sf), docs, "path")
    return tok.snippets(docs, hits, "path", context=2)


_OCC = ", ".join(f"{{'name': {n}, 'line_no': {line}, 'role': '{role}'}}" for n, line, role in [
    (f"'Part' || {_K}", 7, "definition"), (f"'title' || {_K}", 8, "definition"), (f"'count' || {_K}", 9, "definition"), (f"'count' || {_K}", 12, "reference"),
    (f"'load' || {_K}", 10, "definition"), ("'print'", 13, "call"), ("'url'", 11, "definition"), ("'url'", 13, "reference"), ("'url'", 14, "reference"),
    ("'url'", 17, "reference"), ("'url'", 22, "reference"), (f"'Mode' || {_K}", 25, "definition"), (f"'Mode' || {_K}", 41, "reference"),
    ("'helper' || CAST(p_size % 5 AS STRING)", 20, "call"), ("'helper' || CAST(p_size % 5 AS STRING)", 24, "call")])


@query("symbol_occurrences", f"""
    SELECT DISTINCT * FROM (SELECT p_partkey AS file_id, unnest([{_OCC}], recursive := true) FROM part)
    UNION SELECT p_partkey, 'Part' || CAST(p_partkey % 50 AS STRING), 33, 'reference' FROM part""")
def symbol_occurrences(spark, sf):
    k = F.col("p_partkey").cast("string")
    symbols = table(spark, sf, "part").select(F.explode(F.array(*[F.concat(F.lit(n), k) for n in ("Part", "title", "count", "load", "Mode")],
                                                                F.lit("print"), F.lit("url"), F.concat(F.lit("helper"), (F.col("p_size") % 5).cast("string")))).alias("name"))
    return tok.occurrences(swift_files(spark, sf), symbols, ["file_id"]).select("file_id", "name", "line_no", "role")


_NAMED = ("CASE p_partkey % 7 WHEN 0 THEN 'load' WHEN 1 THEN 'title' WHEN 2 THEN 'Part' WHEN 3 THEN 'Mode' WHEN 4 THEN 'Store' WHEN 5 THEN 'nothing' ELSE 'poke' END || CAST(p_partkey AS STRING)")


@query("inferred_kinds", """
    SELECT p_partkey AS file_id, CASE p_partkey % 7 WHEN 0 THEN 'method' WHEN 1 THEN 'variable' WHEN 2 THEN 'class' WHEN 3 THEN 'enum' WHEN 4 THEN 'unknown' WHEN 5 THEN 'unknown' ELSE 'method' END AS kind FROM part""")
def inferred_kinds(spark, sf):
    files = swift_files(spark, sf).withColumn("name", F.expr(_NAMED.replace("p_partkey", "file_id")))
    return files.select("file_id", tok.infer_kind("text", "name").alias("kind"))


@query("declaration_sites", f"""
    SELECT name, path, decl_line FROM (SELECT {SWIFT_PATH} AS path, unnest([{{'name': 'count' || {_K}, 'decl_line': 9}}, {{'name': 'poke' || {_K}, 'decl_line': 41}},
      {{'name': 'Hidden' || {_K}, 'decl_line': 3}}], recursive := true) FROM part)
    UNION ALL SELECT 'helper' || CAST(p_size % 5 AS STRING), min({SWIFT_PATH}), NULL FROM part GROUP BY 1""")
def declaration_sites(spark, sf):
    k = F.col("p_partkey").cast("string")
    idents = table(spark, sf, "part").select(F.explode(F.array(*[F.concat(F.lit(n), k) for n in ("count", "poke", "Hidden")],
                                                               F.concat(F.lit("helper"), (F.col("p_size") % 5).cast("string")))).alias("name"))
    return review.declaration_sites(idents, swift_files(spark, sf), "rel_path")


@query("payload_records", """
    SELECT doc_id, json_extract_string(j, '$.instruction') AS instruction, md5(json_extract_string(j, '$.input')) AS input_digest, json_extract_string(j, '$.output') AS output FROM (
    SELECT doc_id, json_object('instruction', 'In the following Swift code, find all identifiers related to sensitive logic. Provide the names and reasoning as a JSON object.',
      'input', '**Swift Source Code:**' || chr(10) || '```swift' || chr(10) || rtrim(text, ' ') || chr(10) || '```' || chr(10) || chr(10) || '**AST Symbol Information (Target: `' || lang || '`):**' || chr(10) || '```json' || chr(10) ||
        '{' || chr(10) || '  "symbolName": "' || lang || '",' || chr(10) || '  "symbolKind": "' || source || '",' || chr(10) || '  "typeSignature": "(' || CAST(n_chars AS STRING) || ') -> \\"' || lang || '\\"",' || chr(10) ||
          CASE WHEN doc_id % 2 = 0 THEN '  "references": [' || chr(10) || '    "' || source || '",' || chr(10) || '    "' || lang || '"' || chr(10) || '  ],' || chr(10) ELSE '' END || '  "calls_out": []' || chr(10) || '}' || chr(10) || '```' || chr(10) || chr(10) || '**Target Identifier:** `' || lang || '`',
      'output', '{' || chr(10) || '  "is_sensitive": true|false,' || chr(10) || '  "reasoning": "<explanation>"' || chr(10) || '}') AS j FROM documents)""")
def payload_records(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.col("lang").alias("name"), F.col("source").alias("kind"), F.col("text").alias("code"),
                                                F.concat(F.lit("("), F.col("n_chars").cast("string"), F.lit(') -> "'), "lang", F.lit('"')).alias("typeSignature"),
                                                F.when(F.col("doc_id") % 2 == 0, F.array("source", "lang")).alias("references"), F.array().cast("array<string>").alias("calls_out"))
    p = review.payloads(rows)
    field = lambda n: F.get_json_object("payload", f"$.{n}")
    return p.select("doc_id", field("instruction").alias("instruction"), F.md5(field("input")).alias("input_digest"), field("output").alias("output"))


@query("scored_candidates", """
    SELECT p_name || ' ' || CAST(p_partkey AS STRING) AS name, p_partkey % 3 <> 0 AS exclude, CASE p_partkey % 3 WHEN 2 THEN '' ELSE 'size ' || CAST(p_size AS STRING) END AS reason FROM part""")
def scored_candidates(spark, sf):
    def scorer(name, snippet, symbol):
        turn = int(symbol) % 3
        if turn == 0:
            return 'answer: {"exclude": false, "reason": "size %s"} done' % snippet
        return '{"reason": "size %s"}' % snippet if turn == 1 else "no object"

    rows = table(spark, sf, "part").select(F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string")).alias("name"),
                                           F.col("p_size").cast("string").alias("snippet"), F.col("p_partkey").cast("string").alias("symbol"))
    return review.score_candidates(rows, scorer)


_PSEUDO = f"""
    WITH {_WORDS}, pieces AS (SELECT doc_id, unnest(regexp_split_to_array(text, '{_WORD}')) AS sep, unnest(list_append(regexp_extract_all(text, '{_WORD}'), '')) AS w,
      generate_subscripts(regexp_split_to_array(text, '{_WORD}'), 1) AS i FROM documents)
    SELECT doc_id, md5(string_agg(sep || CASE WHEN bench.name IS NULL THEN w ELSE 'w_' || w || '_x' END, '' ORDER BY i)) AS digest FROM pieces LEFT JOIN bench ON w = bench.name GROUP BY doc_id"""


def _pseudo_mapping(spark, sf):
    return _bench_words(spark, sf).select(F.col("name").alias("target"), F.concat(F.lit("w_"), "name", F.lit("_x")).alias("replacement"))


@query("pseudonymize_by_join", _PSEUDO)
def pseudonymize_by_join(spark, sf):
    out = rewrite.pseudonymize(table(spark, sf, "documents").select("doc_id", "text"), _pseudo_mapping(spark, sf), "doc_id")
    return out.select("doc_id", F.md5("text").alias("digest"))


@query("pseudonymize_by_table", _PSEUDO)
def pseudonymize_by_table(spark, sf):
    """The benchmark's words, a list of fixed length in the given tables, are held by the caller."""
    held = {r["target"]: r["replacement"] for r in _pseudo_mapping(spark, sf).collect()}
    out = rewrite.pseudonymize_by_table(table(spark, sf, "documents").select("doc_id", "text"), held)
    return out.select("doc_id", F.md5("text").alias("digest"))


_RENAMED = render(SWIFT.replace("url", "addr").replace("Int", "Num"))


@query("pseudonymize_code", f"SELECT p_partkey AS file_id, md5({_RENAMED}) AS digest FROM part")
def pseudonymize_code(spark, sf):
    """Names in comments and strings (``load``, ``x``, ``block``) stay."""
    pairs = spark.createDataFrame([("url", "addr"), ("Int", "Num"), ("load", "never"), ("hi", "never"), ("block", "never")], "target string, replacement string")
    out = rewrite.pseudonymize(swift_files(spark, sf).select("file_id", "text"), pairs, "file_id", profile="swift")
    return out.select("file_id", F.md5("text").alias("digest"))


@query("changed_files", """
    SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda l: contains(l, 'e'))) AS n_changed FROM documents WHERE doc_id % 3 = 0 AND contains(text, 'e')""")
def changed_files(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    both = docs.withColumn("after", F.when(F.col("doc_id") % 3 == 0, F.replace("text", F.lit("e"), F.lit("E"))).otherwise(F.col("text")))
    return rewrite.diff_rows(both, "doc_id", "text", "after").select("doc_id", F.col("n_changed").cast("long").alias("n_changed"))


@query("changed_tables", """
    SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda l: contains(l, 'e'))) AS n_changed FROM documents WHERE doc_id % 5 = 0 AND contains(text, 'e')""")
def changed_tables(spark, sf):
    """Both texts come from tables of their own."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    after = docs.withColumn("text", F.when(F.col("doc_id") % 5 == 0, F.replace("text", F.lit("e"), F.lit("E"))).otherwise(F.col("text")))
    return rewrite.diff_files(docs, after, "doc_id").select("doc_id", F.col("n_changed").cast("long").alias("n_changed"))


@query("unified_diffs")
def unified_diffs(spark, sf):
    files = swift_files(spark, sf).select("file_id", "text").withColumn("after", strip_comments("text"))
    diffs = rewrite.diff_rows(files, "file_id", "text", "after")
    return rewrite.unified_diff(diffs, "file_id").select("file_id", "n_changed", "diff")


@query("remove_statements_pages", r"""
    SELECT page_id, len(regexp_extract_all(html, '\btrack\([0-9]*\);')) AS n_removed, md5(regexp_replace(html, '\btrack\([0-9]*\);', '', 'g')) AS digest FROM pages""")
def remove_statements_pages(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", F.col("html").alias("text"))
    out = rewrite.remove_statements(pages, "track")
    return out.select("page_id", F.col("n_removed").cast("long").alias("n_removed"), F.md5("text").alias("digest"))


_QUIET = render(SWIFT.replace('            print("load <<p_partkey>>", url)\n', "\n").replace('            debugPrint(\n                "x)",\n                url)\n', "\n"))


@query("remove_calls_code", f"SELECT p_partkey AS file_id, 2 AS n_removed, md5({_QUIET}) AS digest FROM part")
def remove_calls_code(spark, sf):
    out = rewrite.remove_calls(swift_files(spark, sf).select("file_id", "text"))
    return out.select("file_id", "n_removed", F.md5("text").alias("digest"))


_QUIET_2 = render(SWIFT_2.replace('print("a")', 'print("")').replace("assert(false)", "assert(true)"))
_ODD = "CASE p_partkey % 7 WHEN 1 THEN NULL WHEN 2 THEN '' WHEN 3 THEN '} ) { func x( {' || chr(10) || '\"open'"


@query("remove_calls_second", f"SELECT p_partkey AS file_id, CASE WHEN p_partkey % 7 IN (1, 2, 3) THEN 0 ELSE 2 END AS n_removed, md5({_ODD} ELSE {_QUIET_2} END) AS digest FROM part")
def remove_calls_second(spark, sf):
    """Calls in case and guard blocks are made harmless; no row is lost, whatever its text."""
    out = rewrite.remove_calls(second_files(spark, sf).select("file_id", "text"))
    return out.select("file_id", "n_removed", F.md5("text").alias("digest"))


@query("strip_comments_second", f"""
    SELECT p_partkey AS file_id, md5({_ODD} ELSE {render(SWIFT_2.replace("    /* func commented() {" + chr(10) + "    */" + chr(10), ""))} END) AS digest FROM part""")
def strip_comments_second(spark, sf):
    return rewrite.strip_comments_lexed(second_files(spark, sf)).select("file_id", F.md5("text").alias("digest"))


@query("debug_calls_code", """
    SELECT p_partkey AS file_id, unnest([{'name': 'print', 'start_line': 13, 'end_line': 13}, {'name': 'debugPrint', 'start_line': 15, 'end_line': 17}], recursive := true) FROM part""")
def debug_calls_code(spark, sf):
    files = swift_files(spark, sf).select("file_id", "text")
    return rewrite.debug_calls(files, rewrite.user_defined(files)).select("file_id", "name", "start_line", "end_line")


@query("calls_in_pages", r"""
    SELECT page_id, 'track' AS name, 1 AS start_line, 1 AS end_line FROM pages WHERE regexp_matches(html, '\btrack\s*\(')""")
def calls_in_pages(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", F.col("html").alias("text"))
    none = spark.createDataFrame([], "name string")
    return rewrite.debug_calls(pages, none, ["track"]).select("page_id", "name", "start_line", "end_line")


@query("user_defined_calls", """
    SELECT DISTINCT CASE p_size % 8 WHEN 0 THEN 'dump' WHEN 4 THEN 'NSLog' WHEN 5 THEN 'assertionFailure' WHEN 6 THEN 'debugPrint' ELSE 'assert' END AS name FROM part WHERE p_size % 8 NOT IN (2, 3)""")
def user_defined_calls(spark, sf):
    text = F.expr(render("class A {\n  <<CASE p_size % 8 WHEN 0 THEN 'static func dump' WHEN 1 THEN 'private func assert' WHEN 2 THEN 'func other' WHEN 4 THEN 'open func NSLog' WHEN 5 THEN 'override func assertionFailure' WHEN 6 THEN '@objc static func debugPrint' WHEN 7 THEN 'static public func assert' ELSE '// func print' END>>(x: Int) { }\n}"))
    return rewrite.user_defined(table(spark, sf, "part").select(text.alias("text")))


@query("debug_report", """
    SELECT p_type AS path, 2 * count(*) AS n_calls, 13 AS first_line, 17 AS last_line FROM part GROUP BY p_type""")
def debug_report(spark, sf):
    files = swift_files(spark, sf).select(F.split("rel_path", "/")[1].alias("path"), "text")
    return rewrite.debug_report(rewrite.debug_calls(files, rewrite.user_defined(files)), "path")

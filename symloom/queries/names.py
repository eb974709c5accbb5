"""Queries over identifier names and parameter lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from symloom.functions import names as nm, text as tx
from symloom.operators.tokens import words
from symloom.queries.derived import ident_names, render, table
from symloom.queries.registry import query

_W1 = "split_part(p_name, ' ', 1)"
_W2 = "split_part(p_name, ' ', 2)"
_CAP1 = f"upper(substr({_W1}, 1, 1)) || substr({_W1}, 2)"
_CAP2 = f"upper(substr({_W2}, 1, 1)) || substr({_W2}, 2)"


@query("split_identifiers", f"""
    SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN {_W1} || '|' || {_CAP2} WHEN 1 THEN {_CAP1} || '|' || {_CAP2}
      WHEN 2 THEN {_W1} || '|' || {_W2} ELSE upper({_W1}) || '|' || upper({_W2}) END AS tokens FROM part""")
def split_identifiers(spark, sf):
    return ident_names(spark, sf).select("p_partkey", F.array_join(nm.split_ident("name"), "|").alias("tokens"))


@query("casing_styles", """
    SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'camel' WHEN 1 THEN 'pascal' WHEN 2 THEN 'snake' ELSE 'screaming' END AS style FROM part""")
def casing_styles(spark, sf):
    return ident_names(spark, sf).select("p_partkey", nm.casing("name").alias("style"))


@query("casing_of_words", r"""
    SELECT style, count(*) AS n FROM (
      SELECT CASE WHEN w LIKE '%\_%' ESCAPE '\' THEN CASE WHEN regexp_matches(w, '\p{Lu}') AND NOT regexp_matches(w, '[\p{Ll}\p{Lt}]') THEN 'screaming' ELSE 'snake' END WHEN regexp_matches(w, '^\p{Lu}') THEN 'pascal' WHEN regexp_matches(w, '^\p{Ll}') THEN 'camel' ELSE 'any' END AS style FROM (
        SELECT DISTINCT unnest(regexp_extract_all(text, '[\p{L}_][\p{L}\p{N}_]*')) AS w FROM documents)) GROUP BY style""")
def casing_of_words(spark, sf):
    found = table(spark, sf, "documents").select(F.explode(F.array_distinct(words("text"))).alias("w")).distinct()
    return found.groupBy(nm.casing("w").alias("style")).agg(F.count("*").alias("n"))


@query("normalized_names", f"SELECT p_partkey, lower({_W1} || {_W2}) AS normal FROM part")
def normalized_names(spark, sf):
    return ident_names(spark, sf).select("p_partkey", nm.normalize("name").alias("normal"))


_GENERIC = render("<<split_part(p_name, ' ', 1)>>_<<CASE p_size % 4 WHEN 0 THEN 'View' WHEN 1 THEN 'manager' WHEN 2 THEN 'Zone' ELSE 'ITEM' END>>_<<split_part(p_name, ' ', 2)>>")


@query("tokens_without_stop_words", f"""
    SELECT p_partkey, {_W1} || CASE WHEN p_size % 4 = 2 THEN '|Zone' ELSE '' END || '|' || {_W2} AS tokens FROM part""")
def tokens_without_stop_words(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.array_join(nm.tokens_no_stop(F.expr(_GENERIC)), "|").alias("tokens"))


_SIGNATURE = render("Kit.Part<<p_size>>.save<<p_partkey>>(x:y:)")


@query("base_names", """
    SELECT p_partkey, 'Kit.Part' || CAST(p_size AS STRING) || '.save' || CAST(p_partkey AS STRING) AS base, 'save' || CAST(p_partkey AS STRING) AS leaf FROM part""")
def base_names(spark, sf):
    base = nm.basename(F.expr(_SIGNATURE))
    return table(spark, sf, "part").select("p_partkey", base.alias("base"), nm.leaf(base).alias("leaf"))


_QUOTED = render("<<CASE p_partkey % 3 WHEN 0 THEN chr(96) WHEN 1 THEN '$' ELSE '' END>>n<<p_partkey>><<CASE p_partkey % 3 WHEN 0 THEN chr(96) ELSE '' END>>")
_QUOTED_SPARK = _QUOTED.replace("chr(96)", "'`'")


@query("clean_names", "SELECT p_partkey, 'n' || CAST(p_partkey AS STRING) AS name FROM part")
def clean_names(spark, sf):
    return table(spark, sf, "part").select("p_partkey", nm.clean_name(F.expr(_QUOTED_SPARK)).alias("name"))


_SPEC = render("<<CASE p_partkey % 3 WHEN 0 THEN 'Function: ' WHEN 1 THEN ':' ELSE '' END>><<CASE WHEN p_size % 2 = 0 THEN 'Kit..Part.' ELSE '' END>>n<<p_partkey>>")


@query("parse_specs", """
    SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'function' END AS kind, CASE WHEN p_size % 2 = 0 THEN 'Kit|Part' ELSE '' END AS parents,
           'n' || CAST(p_partkey AS STRING) AS leaf FROM part""")
def parse_specs(spark, sf):
    spec = nm.parse_spec(F.expr(_SPEC))
    return (table(spark, sf, "part").select("p_partkey", spec.alias("s"))
            .select("p_partkey", "s.kind", F.array_join("s.parents", "|").alias("parents"), "s.leaf"))


_TYPE = render("<<CASE p_partkey % 4 WHEN 0 THEN '[' ELSE ' ' END>>T<<p_partkey>><<CASE p_partkey % 4 WHEN 0 THEN ']?' WHEN 1 THEN '<Int, [String]>!' WHEN 2 THEN '??' ELSE '' END>>")


@query("type_bases", "SELECT p_partkey, 'T' || CAST(p_partkey AS STRING) AS base FROM part")
def type_bases(spark, sf):
    return table(spark, sf, "part").select("p_partkey", nm.type_base(F.expr(_TYPE)).alias("base"))


_PARAMS = render("with id<<p_partkey>>: [Int: (A, B<<p_size>>)], _ flag: Map<K, V<<p_size>>>, name<<p_partkey>>: String<<CASE WHEN p_partkey % 3 = 0 THEN ' = f' ELSE '' END>>, _: Int")
_S = "CAST(p_size AS STRING)"
_K = "CAST(p_partkey AS STRING)"


def _params(spark, sf):
    return table(spark, sf, "part").select("p_partkey", "p_size", F.expr(_PARAMS).alias("params"))


@query("split_params", f"""
    SELECT p_partkey, 'with id' || {_K} || ': [Int: (A, B' || {_S} || ')]| _ flag: Map<K, V' || {_S} || '>| name' || {_K} || ': String' ||
      CASE WHEN p_partkey % 3 = 0 THEN ' = f' ELSE '' END || '| _: Int' AS parts FROM part""")
def split_params(spark, sf):
    return _params(spark, sf).select("p_partkey", F.array_join(nm.split_params("params"), "|").alias("parts"))


@query("param_labels", f"SELECT p_partkey, 'with|_|name' || {_K} || '|_' AS labels FROM part")
def param_labels(spark, sf):
    return _params(spark, sf).select("p_partkey", F.array_join(nm.param_labels("params"), "|").alias("labels"))


@query("param_names", f"SELECT p_partkey, 'id' || {_K} || '|flag|name' || {_K} || '|arg' AS locals FROM part")
def param_names(spark, sf):
    return _params(spark, sf).select("p_partkey", F.array_join(nm.param_names("params"), "|").alias("locals"))


@query("param_defaults", f"""
    SELECT p_partkey, p_partkey % 3 = 0 AS has_default, 'with id' || {_K} || ': [Int: (A, B' || {_S} || ')], _ flag: Map<K, V' || {_S} || '>, name' || {_K} || ': String' ||
      CASE WHEN p_partkey % 3 = 0 THEN ' ' ELSE '' END || ', _: Int' AS stripped FROM part""")
def param_defaults(spark, sf):
    return _params(spark, sf).select("p_partkey", nm.has_default("params").alias("has_default"), nm.strip_defaults("params").alias("stripped"))


@query("func_keys", f"SELECT p_partkey, 'f' || {_S} AS name, 4 AS arity, 'with|_|name' || {_K} || '|_' AS labels FROM part")
def func_keys(spark, sf):
    key = nm.func_key(F.concat(F.lit("f"), F.col("p_size").cast("string")), "params")
    return _params(spark, sf).select("p_partkey", key.alias("k")).select("p_partkey", "k.name", "k.arity", F.array_join("k.labels", "|").alias("labels"))


@query("route_keys", f"""
    SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'P' || {_S} || '.' ELSE '' END || 'f' || {_K} || '(Int, T' || {_S} || ')' || CASE WHEN p_size % 3 = 0 THEN ' -> Int' ELSE '' END AS route FROM part""")
def route_keys(spark, sf):
    size = F.col("p_size").cast("string")
    return table(spark, sf, "part").select("p_partkey", nm.route_key(
        F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("P"), size)), F.concat(F.lit("f"), F.col("p_partkey").cast("string")),
        nm.param_types(F.concat(F.lit("a: Int = 3, b: T"), size)), F.when(F.col("p_size") % 3 == 0, "Int")).alias("route"))


_ESCAPED = render("\"a<<CASE p_partkey % 5 WHEN 0 THEN chr(92) || 'n' WHEN 1 THEN chr(92) || 'u{e9}' WHEN 2 THEN chr(92) || chr(92) || 'n' WHEN 3 THEN chr(92) || 't' ELSE chr(92) || 'u{1F600}' END>>b<<p_partkey>>\"")


@query("unescape_literals", f"""
    SELECT p_partkey, 'a' || CASE p_partkey % 5 WHEN 0 THEN chr(10) WHEN 1 THEN chr(233) WHEN 2 THEN chr(92) || 'n' WHEN 3 THEN chr(9) ELSE chr(128512) END || 'b' || {_K} AS plain FROM part""")
def unescape_literals(spark, sf):
    return table(spark, sf, "part").select("p_partkey", nm.unescape(nm.unquote(F.expr(_ESCAPED))).alias("plain"))


@query("first_json_objects", """
    SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL ELSE props END AS object FROM events""")
def first_json_objects(spark, sf):
    events = table(spark, sf, "events")
    noisy = (F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("answer {broken "), "props", F.lit(" and {\"z\": 1}")))
             .when(F.col("event_id") % 4 == 1, F.concat(F.lit("```json\n"), "props", F.lit("\n```")))
             .when(F.col("event_id") % 4 == 2, F.col("props")).otherwise("no object {here"))
    return events.select("event_id", tx.first_json(noisy).alias("object"))


@query("condition_kinds", f"""
    SELECT p_partkey, p_partkey % 3 = 0 AS pure, CASE p_size % 3 WHEN 0 THEN 'case' WHEN 1 THEN 'tuple' ELSE 'ident' END AS kind,
      CASE p_size % 3 WHEN 0 THEN 'some|v' || {_K} WHEN 1 THEN 'a|b' || {_K} ELSE 'item' || {_K} END AS idents FROM part""")
def condition_kinds(spark, sf):
    condition = F.expr("CASE p_partkey % 3 WHEN 0 THEN 'letter > 3' WHEN 1 THEN 'let x = y' ELSE 'case .a = b' END")
    pattern = F.expr(render("<<CASE p_size % 3 WHEN 0 THEN 'case let .some(v' WHEN 1 THEN '(a, b' ELSE 'item' END>><<p_partkey>><<CASE WHEN p_size % 3 < 2 THEN ')' ELSE '' END>>"))
    return table(spark, sf, "part").select("p_partkey", tx.is_pure_bool(condition).alias("pure"), tx.pattern_kind(pattern).alias("kind"),
                                           F.array_join(tx.pattern_idents(pattern), "|").alias("idents"))

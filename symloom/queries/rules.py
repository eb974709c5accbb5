"""Queries over exception rules, functions, regions and literals."""

from __future__ import annotations

from pyspark.sql import functions as F

from symloom.operators import literals as lit, rules as rl, scopes
from symloom.plans.rename import wrappable
from symloom.queries.derived import NODES_CTE, SWIFT_PATH, dealt, node_rows, second_files, swift_files, table
from symloom.queries.registry import query
from symloom.session import cut_lineage

_K = "CAST(p_partkey AS STRING)"


def _rule(reason: str, where: str) -> str:
    return f"SELECT node_id, '{reason}' AS reason FROM n WHERE {where}"


_MEMBER = "SELECT m.node_id, '{0}' FROM nodes m JOIN nodes p ON m.parent_id = p.node_id WHERE {1}"


@query("rule_exceptions", f"""
    WITH {NODES_CTE}, n AS (SELECT * FROM nodes)
    {_rule('entry_point', "list_has_any(attributes, ['main', 'UIApplicationMain']) OR list_has_any(adopted, ['UIApplicationDelegate', 'UIWindowSceneDelegate', 'App'])")}
    UNION {_rule('ui_attribute', "list_has_any(attributes, ['IBOutlet', 'State'])")} UNION {_rule('runtime', "list_contains(attributes, 'objc')")}
    UNION {_rule('objc_members', "list_contains(attributes, 'objcMembers')")} UNION {_rule('model', "list_contains(attributes, 'Model')")}
    UNION {_rule('global_actor', "list_contains(attributes, 'globalActor')")} UNION {_rule('accessor', "name = 'init'")}
    UNION {_MEMBER.format('entry_member', "list_contains(p.attributes, 'main') AND ((m.kind = 'variable' AND m.name = 'body') OR (m.kind = 'function' AND m.name = 'main'))")}
    UNION {_MEMBER.format('objc_member', "list_contains(p.attributes, 'objcMembers')")}
    UNION {_MEMBER.format('model_member', "list_contains(p.attributes, 'Model') AND m.kind = 'variable'")}
    UNION {_MEMBER.format('actor_shared', "list_contains(p.attributes, 'globalActor') AND m.name = 'shared' AND m.kind = 'variable'")}
    UNION {_rule('listed_name', "name IN (SELECT 'm' || CAST(n_nationkey * 3 AS STRING) FROM nation)")}
    UNION {_rule('external_name', "replace(name, chr(96), '') IN (SELECT 'keep' || CAST(n_nationkey AS STRING) FROM nation)")}""")
def rule_exceptions(spark, sf):
    n = F.col("n_nationkey")
    nation = table(spark, sf, "nation")
    return rl.rule_exceptions(node_rows(spark, sf), nation.select(F.concat(F.lit("m"), (n * 3).cast("string")).alias("name")),
                              nation.select(F.concat(F.lit("keep"), n.cast("string")).alias("name")))


@query("keyword_set", f"WITH {NODES_CTE} SELECT kind AS name FROM nodes UNION SELECT access FROM nodes UNION SELECT unnest(attributes) FROM nodes")
def keyword_set(spark, sf):
    return rl.keyword_set(node_rows(spark, sf))


def _funcs(spark, sf):
    return scopes.function_inventory(swift_files(spark, sf))


_RISKS = f"""risks AS (SELECT p_partkey AS file_id, unnest([{{'name': 'load' || {_K}, 'reasons': ''}}, {{'name': 'draw' || {_K}, 'reasons': 'param_default|override_method'}}, {{'name': 'nested' || {_K}, 'reasons': 'opaque_return_some'}},
    {{'name': 'extra' || {_K}, 'reasons': 'closure_param_or_escaping'}}, {{'name': 'peek' || {_K}, 'reasons': ''}}, {{'name': 'poke' || {_K}, 'reasons': 'inout_param'}}, {{'name': 'free' || {_K}, 'reasons': 'return_Self'}}], recursive := true) FROM part)"""


@query("function_risks", f"WITH {_RISKS} SELECT * FROM risks")
def function_risks(spark, sf):
    return rl.risk_reasons(_funcs(spark, sf)).select("file_id", "name", F.array_join("risk_reasons", "|").alias("reasons"))


@query("safe_functions", f"WITH {_RISKS} SELECT reasons = '' AS is_safe, count(*) AS n FROM risks GROUP BY 1")
def safe_functions(spark, sf):
    return rl.risk_reasons(_funcs(spark, sf)).groupBy("is_safe").agg(F.count("*").alias("n"))


_BASE = f"'Part' || {_K} || '.swift'"
_SOFT = ", ".join(f"{{'name': {n}, 'kind': '{k}', 'comment': {c}, 'step': {s}, 'pos': {a}}}" for n, k, c, s, a in [
    (f"'draw' || {_K}", "function", f"'Protocol requirement (' || {_BASE} || ')'", 1, 0), (f"'poke' || {_K}", "function", f"'Actor isolated instance method (Store' || {_K} || ')'", 2, 0),
    (f"'extra' || {_K}", "function", f"'Declared in extension (' || {_BASE} || ')'", 4, 0)])
_TYPED = ", ".join(f"{{'name': {n}, 'kind': '{k}', 'comment': 'File with compiler directives (' || {_BASE} || ')', 'step': 5, 'pos': {a}}}" for a, (n, k) in enumerate([
    (f"'Part' || {_K}", "class"), (f"'Mode' || {_K}", "enum"), ("'Part' || CAST(p_partkey % 50 AS STRING)", "extension"), ("'Proto' || CAST(p_partkey % 11 AS STRING)", "protocol"), (f"'Store' || {_K}", "actor")]))
_HARD = ", ".join(f"{{'name': '{n}' || {_K}, 'comment': '{c}'}}" for n, c in [
    ("draw", "Unsafe due to ''default parameter value'' keyword"), ("nested", "Opaque return (''some'') not supported"), ("extra", "Unsafe due to ''@escaping'' keyword"), ("poke", "Unsafe due to ''inout'' keyword")])


@query("generated_rules", f"""
    WITH src AS (SELECT *, {SWIFT_PATH} AS path, p_brand AS project FROM part), soft AS (SELECT project, path, unnest([{_SOFT}], recursive := true) FROM src UNION ALL SELECT project, path, unnest([{_TYPED}], recursive := true) FROM src WHERE p_partkey % 6 = 0),
    hard AS (SELECT project, unnest([{_HARD}], recursive := true) FROM src WHERE p_partkey % 6 <> 0),
    first AS (SELECT project, name, arg_min({{'kind': kind, 'comment': comment}}, {{'path': path, 'step': step, 'pos': pos}}) AS r FROM soft GROUP BY project, name)
    SELECT project, name, 'function' AS kind, comment FROM hard UNION ALL SELECT project, name, r.kind, r.comment FROM first WHERE (project, name) NOT IN (SELECT (project, name) FROM hard)""")
def generated_rules(spark, sf):
    files = swift_files(spark, sf).withColumn("text", F.when(F.col("file_id") % 6 == 0, F.concat("text", F.lit("#if DEBUG\n#endif\n"))).otherwise(F.col("text")))
    return rl.generate_rules(files, extensions=True, actors=True, global_actors=True)


_RULES = [("load*", "function"), ("Store*", "actor"), ("Part7", "class"), ("Part7", "extension"), ("draw1?", "function"), ("free3", None), ("peek5", "class"), ("[np]e*9", "")]
_MATCH = f"""fn AS (SELECT p_partkey AS file_id, unnest([{{'name': 'load' || {_K}, 'parent': 'Part' || {_K}}}, {{'name': 'draw' || {_K}, 'parent': 'Part' || {_K}}}, {{'name': 'nested' || {_K}, 'parent': 'Part' || {_K}}},
    {{'name': 'extra' || {_K}, 'parent': 'Part' || CAST(p_partkey % 50 AS STRING)}}, {{'name': 'peek' || {_K}, 'parent': 'Store' || {_K}}}, {{'name': 'poke' || {_K}, 'parent': 'Store' || {_K}}}, {{'name': 'free' || {_K}, 'parent': ''}}], recursive := true) FROM part),
    m AS (SELECT file_id, name, r AS rule FROM fn, (SELECT unnest(['load*', 'Store*', 'Part7', 'draw1?', 'free3', '[np]e*9']) AS r)
      WHERE CASE r WHEN 'load*' THEN name LIKE 'load%' WHEN 'Store*' THEN parent LIKE 'Store%' WHEN 'Part7' THEN parent = 'Part7' WHEN 'draw1?' THEN regexp_matches(name, '^draw1.$')
        WHEN 'free3' THEN name = 'free3' ELSE regexp_matches(name, '^[np]e.*9$') OR regexp_matches(parent, '^[np]e.*9$') END)"""


def _rules(spark):
    return spark.createDataFrame(_RULES, "name string, kind string")


@query("matched_rules", f"WITH {_MATCH} SELECT file_id, name, rule FROM m")
def matched_rules(spark, sf):
    return rl.match_rules(_funcs(spark, sf), _rules(spark), ["file_id", "name"])


@query("rule_partition", f"WITH {_MATCH} SELECT file_id, name, (file_id, name) IN (SELECT (file_id, name) FROM m) AS excluded FROM fn")
def rule_partition(spark, sf):
    return rl.partition_by_rules(_funcs(spark, sf), _rules(spark), ["file_id", "name"]).select("file_id", "name", "excluded")


_PROTO = "'Proto' || CAST(p_partkey % 11 AS STRING)"


@query("protocol_requirements", f"SELECT DISTINCT p_brand AS project, {_PROTO} AS protocol, 'draw' || {_K} || '/1/rect' AS func_key FROM part")
def protocol_requirements(spark, sf):
    return scopes.protocol_requirements(swift_files(spark, sf))


@query("protocol_implementations", f"""
    SELECT p_partkey AS file_id, unnest([{{'name': 'load' || {_K}, 'matched': '', 'outside': true}}, {{'name': 'draw' || {_K}, 'matched': {_PROTO}, 'outside': true}}, {{'name': 'nested' || {_K}, 'matched': '', 'outside': true}},
      {{'name': 'extra' || {_K}, 'matched': '', 'outside': true}}, {{'name': 'peek' || {_K}, 'matched': '', 'outside': false}}, {{'name': 'poke' || {_K}, 'matched': '', 'outside': false}}, {{'name': 'free' || {_K}, 'matched': '', 'outside': false}}], recursive := true) FROM part""")
def protocol_implementations(spark, sf):
    out = scopes.protocol_impl(cut_lineage(_funcs(spark, sf)), scopes.protocol_requirements(swift_files(spark, sf)), ["file_id", "name", "line_no"])
    return out.select("file_id", "name", F.array_join("matched_internal_protocols", "|").alias("matched"), F.col("has_external_protocols_in_scope").alias("outside"))


@query("local_types", f"SELECT DISTINCT p_brand AS project, unnest(['Part' || {_K}, 'Mode' || {_K}, 'Store' || {_K}]) AS name FROM part")
def local_types(spark, sf):
    return scopes.local_types(swift_files(spark, sf))


@query("actor_types", f"SELECT p_brand AS project, 'Store' || {_K} AS name FROM part")
def actor_types(spark, sf):
    return scopes.actor_types(swift_files(spark, sf))


@query("global_actor_types", f"SELECT p_brand AS project, 'Part' || {_K} AS name FROM part WHERE p_size % 5 = 0")
def global_actor_types(spark, sf):
    return scopes.global_actor_types(swift_files(spark, sf))


@query("wrap_eligibility", f"""
    SELECT p_partkey AS file_id, unnest([{{'name': 'load' || {_K}, 'blocked_by': 'unknown_type'}}, {{'name': 'draw' || {_K}, 'blocked_by': 'protocol_requirement'}},
      {{'name': 'nested' || {_K}, 'blocked_by': CASE WHEN p_size % 5 = 0 THEN 'actor_isolated' END}}, {{'name': 'extra' || {_K}, 'blocked_by': 'external_protocol_extension'}},
      {{'name': 'peek' || {_K}, 'blocked_by': NULL}}, {{'name': 'poke' || {_K}, 'blocked_by': 'actor_isolated'}}, {{'name': 'free' || {_K}, 'blocked_by': NULL}}], recursive := true) FROM part""")
def wrap_eligibility(spark, sf):
    return wrappable(swift_files(spark, sf)).select("file_id", "name", "blocked_by")


@query("carried_attributes", """
    SELECT event_id, CASE WHEN prev = 'signup' THEN prev_value END AS carried FROM (
      SELECT event_id, event_type, lag(event_type) OVER w AS prev, lag(CAST(user_id AS STRING) || ':' || CAST(event_id AS STRING)) OVER w AS prev_value FROM events WHERE event_type IN ('signup', 'purchase', 'error')
      WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) WHERE event_type IN ('purchase', 'error')""")
def carried_attributes(spark, sf):
    events = table(spark, sf, "events").select("user_id", "event_id", "event_type")
    kind = F.col("event_type")
    return scopes.carry_attrs(events, ["user_id"], "event_id", kind == "signup", F.concat_ws(":", F.col("user_id").cast("string"), F.col("event_id").cast("string")),
                              kind.isin("purchase", "error"), block=F.floor(F.col("event_id") / 1000)).select("event_id", "carried")


@query("region_depths", r"""
    SELECT page_id, pos, sum(CASE WHEN tag LIKE '</%' THEN -1 ELSE 1 END) OVER (PARTITION BY page_id ORDER BY pos) AS region_depth FROM (
      SELECT page_id, unnest(t) AS tag, generate_subscripts(t, 1) AS pos FROM (SELECT page_id, regexp_extract_all(html, '</?(?:ul|li|article|nav)\b') AS t FROM pages))""")
def region_depths(spark, sf):
    tags = F.regexp_extract_all("html", F.lit(r"</?(?:ul|li|article|nav)\b"), F.lit(0))
    rows = table(spark, sf, "pages").select("page_id", F.posexplode(tags).alias("i", "tag")).select("page_id", (F.col("i") + 1).alias("pos"), "tag")
    closing = F.col("tag").startswith("</")
    return scopes.regions(rows, ["page_id"], "pos", F.when(closing, 0).otherwise(1), F.when(closing, 1).otherwise(0)).select("page_id", "pos", "region_depth")


_LITS = r"""lits AS (SELECT page_id, i, v, t[i] AS before FROM (SELECT page_id, unnest(x) AS v, generate_subscripts(x, 1) AS i, t FROM (
      SELECT page_id, regexp_extract_all(html, '"[^"<>]*"') AS x, regexp_split_to_array(html, '"[^"<>]*"') AS t FROM pages))),
    why AS (SELECT page_id, unnest(list_filter([CASE WHEN length(trim(v, '" ')) <= 1 THEN 'short_or_blank' END, CASE WHEN regexp_matches(before, '\b(class|id|name)=$') THEN 'identifier' END,
      CASE WHEN regexp_matches(before, '\b(href|src)=$') THEN 'resource_like' END], lambda r: r IS NOT NULL)) AS reason FROM lits)"""


def _page_literals(spark, sf):
    """Pages cut into one line per tag, so that lines differ in their reasons."""
    text = F.replace("html", F.lit("><"), F.lit(">\n<"))
    return lit.literal_table(table(spark, sf, "pages").select("page_id", text.alias("text")), "markup", keep=["page_id"])


@query("literal_reasons_markup", f"WITH {_LITS} SELECT DISTINCT page_id, 1 AS line_no, reason FROM why")
def literal_reasons_markup(spark, sf):
    rows = lit.literal_table(table(spark, sf, "pages").select("page_id", F.col("html").alias("text")), "markup", keep=["page_id"])
    return lit.literal_reasons(rows, ["page_id"])


@query("kept_literals_markup", r"""
    WITH l AS (SELECT page_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS line_no FROM (SELECT page_id, replace(html, '><', '>' || chr(10) || '<') AS t FROM pages)),
    v AS (SELECT page_id, line_no, unnest(regexp_extract_all(line, '"[^"<>]*"')) AS value, line FROM l),
    x AS (SELECT page_id, line_no, value, i, t[i] AS before FROM (SELECT page_id, line_no, unnest(x) AS value, generate_subscripts(x, 1) AS i, t FROM (
      SELECT page_id, line_no, regexp_extract_all(line, '"[^"<>]*"') AS x, regexp_split_to_array(line, '"[^"<>]*"') AS t FROM l WHERE contains(line, '"'))))
    SELECT page_id, line_no, value FROM x WHERE (page_id, line_no) NOT IN (SELECT (page_id, line_no) FROM x WHERE length(trim(value, '" ')) <= 1 OR regexp_matches(before, '\b(class|id|name|href|src)=$'))""")
def kept_literals_markup(spark, sf):
    return lit.keep_literals(_page_literals(spark, sf)).select("page_id", "line_no", "value")


@query("literal_reasons_code", """
    SELECT p_partkey AS file_id, unnest([{'line_no': 13, 'reason': 'debug'}, {'line_no': 16, 'reason': 'debug'}, {'line_no': 30, 'reason': 'ui_keylike'}, {'line_no': 30, 'reason': 'view_container'}, {'line_no': 45, 'reason': 'global'}], recursive := true) FROM part""")
def literal_reasons_code(spark, sf):
    return lit.literal_reasons(lit.literal_table(swift_files(spark, sf), "swift", keep=["file_id"]), ["file_id"])


@query("kept_literals_code", """
    SELECT p_partkey AS file_id, unnest([{'line_no': 8, 'value': '"' || p_name || '"'}, {'line_no': 11, 'value': '"' || p_type || '"'}], recursive := true) FROM part""")
def kept_literals_code(spark, sf):
    return lit.keep_literals(lit.literal_table(swift_files(spark, sf), "swift", keep=["file_id"])).select("file_id", "line_no", "value")


_POLICY = "pol AS (SELECT DISTINCT CASE p_size % 3 WHEN 0 THEN 'include' ELSE 'exclude' END AS section, CASE p_partkey % 10 WHEN 0 THEN 'gone ' || p_name WHEN 1 THEN 'hi ' || p_name WHEN 2 THEN p_brand ELSE p_name END AS pattern FROM part)"
_EFFECT = "eff AS (SELECT pattern, CASE WHEN bool_or(section = 'include') AND bool_or(section = 'exclude') THEN 'conflict_excluded' WHEN bool_or(section = 'exclude') THEN 'excluded' ELSE 'included' END AS effect FROM pol GROUP BY pattern)"


def _literal_policy(spark, sf):
    pattern = F.expr("CASE p_partkey % 10 WHEN 0 THEN concat('gone ', p_name) WHEN 1 THEN concat('hi ', p_name) WHEN 2 THEN p_brand ELSE p_name END")
    return table(spark, sf, "part").select(F.when(F.col("p_size") % 3 == 0, "include").otherwise("exclude").alias("section"), F.lit("encryption").alias("category"), pattern.alias("pattern"))


@query("literal_policy", f"WITH {_POLICY}, {_EFFECT} SELECT * FROM eff")
def literal_policy(spark, sf):
    return lit.literal_policy(_literal_policy(spark, sf))


@query("literal_policy_report", f"""
    WITH {_POLICY}, {_EFFECT}, v AS (SELECT unnest([{{'pattern': p_name, 'reason': ''}}, {{'pattern': p_type, 'reason': ''}}, {{'pattern': 'x)', 'reason': 'debug'}}, {{'pattern': 'load ' || {_K}, 'reason': 'debug'}},
      {{'pattern': 'hi ' || p_name, 'reason': 'ui_keylike'}}, {{'pattern': p_brand, 'reason': 'global'}}], recursive := true) FROM part),
    c AS (SELECT pattern, reason, count(*) AS n FROM v GROUP BY ALL)
    SELECT pattern, CASE WHEN n > 0 THEN 'excluded_occurrences' ELSE 'unused_exclusion' END AS finding, CAST(n AS BIGINT) AS n FROM (SELECT e.pattern, coalesce(sum(c.n) FILTER (c.reason = ''), 0) AS n FROM eff e LEFT JOIN c USING (pattern) WHERE effect <> 'included' GROUP BY e.pattern)
    UNION ALL SELECT e.pattern, 'include_absent', 0 FROM eff e WHERE effect = 'included' AND pattern NOT IN (SELECT pattern FROM c)
    UNION ALL SELECT e.pattern, CASE reason WHEN '' THEN 'encryptable' ELSE 'blocked_' || reason END, c.n FROM eff e JOIN c USING (pattern) WHERE effect = 'included'""")
def literal_policy_report(spark, sf):
    rows = lit.literal_table(swift_files(spark, sf), "swift", keep=["file_id"])
    return lit.literal_policy_report(rows, lit.literal_policy(_literal_policy(spark, sf)))


@query("rewrite_window", """
    SELECT p_partkey AS file_id, '"' || p_name || '"' AS value, 8 + p_partkey % 3 AS line_no FROM part WHERE p_partkey % 3 < 2""")
def rewrite_window(spark, sf):
    kept = lit.keep_literals(lit.literal_table(swift_files(spark, sf), "swift", keep=["file_id"]))
    hits = table(spark, sf, "part").select(F.col("p_partkey").alias("file_id"), F.concat(F.lit('"'), "p_name", F.lit('"')).alias("value"),
                                           (8 + F.col("p_partkey") % 3).cast("int").alias("line_no"))
    return lit.rewrite_window(kept, hits, ["file_id"]).select("file_id", "value", "line_no")


@query("encrypted_literals", r"""
    SELECT p_partkey AS file_id, p_name || chr(10) || 'é' AS plain, true AS hidden FROM part""")
def encrypted_literals(spark, sf):
    """Encrypt, decrypt, compare; the key would come from the caller."""
    value = F.concat(F.lit('"'), "p_name", F.lit('\\n\\u{e9}"'))
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("file_id"), value.alias("value"))
    key = F.lit(bytearray(b"0123456789abcdef0123456789abcdef"))
    out = lit.decrypt_literals(lit.encrypt_literals(rows, key), key)
    return out.select("file_id", "plain", (~F.col("cipher").contains("plain") & (F.length("cipher") > 20)).alias("hidden"))


_WHOLE = "p_partkey % 7 NOT IN (1, 2, 3)"
_REASONS = ", ".join(f"{{'line_no': {n}, 'reason': '{r}'}}" for n, r in [
    (2, "global"), (5, "entrypoint"), (9, "attribute"), (9, "ui_keylike"), (11, "identifier"), (12, "debug"), (14, "localized"), (16, "ui_keylike"),
    (18, "short_or_blank"), (20, "interpolated"), (21, "image_literal"), (22, "resource_like"), (33, "debug"), (33, "short_or_blank"), (35, "view_container")])


@query("literal_reasons_second", f"SELECT p_partkey AS file_id, unnest([{_REASONS}], recursive := true) FROM part WHERE {_WHOLE}")
def literal_reasons_second(spark, sf):
    """All twelve reasons; null, empty and unbalanced texts among the files."""
    rows = lit.literal_table(second_files(spark, sf).select("file_id", "text"), "swift", keep=["file_id"])
    return lit.literal_reasons(rows, ["file_id"])


@query("kept_literals_second", f"""SELECT p_partkey AS file_id, 19 AS line_no, '"kept ' || p_type || '"' AS value FROM part WHERE {_WHOLE}""")
def kept_literals_second(spark, sf):
    return lit.keep_literals(lit.literal_table(second_files(spark, sf).select("file_id", "text"), "swift", keep=["file_id"])).select("file_id", "line_no", "value")


@query("eligible_function_lines", f"""
    SELECT p_partkey AS file_id, unnest([{{'line_no': 10, 'name': 'show' || {_K}, 'insert_before': false}}, {{'line_no': 30, 'name': 'after' || {_K}, 'insert_before': false}},
      {{'line_no': 42, 'name': 'marked' || {_K}, 'insert_before': false}}], recursive := true) FROM part WHERE {_WHOLE}""")
def eligible_function_lines(spark, sf):
    return scopes.eligible_function_lines(second_files(spark, sf).select("file_id", "text")).select("file_id", "line_no", "name", "insert_before")


@query("nested_call_reasons", """
    SELECT p_partkey AS file_id, 2 AS line_no, 'debug' AS reason FROM part""")
def nested_call_reasons(spark, sf):
    """Literals behind calls nested up to fourteen deep, each with the reason of the call that is still open."""
    nest = F.concat(F.expr("repeat('f(', cast(p_partkey % 15 as int))"), F.expr("repeat(')', cast(p_partkey % 15 as int))"))
    text = F.concat(F.lit("func g() {\n  print("), nest, F.lit(', "some text")\n  print('), nest, F.lit('); h("other text")\n}'))
    files = dealt(table(spark, sf, "part"), "p_partkey").select(F.col("p_partkey").alias("file_id"), text.alias("text"))
    return lit.literal_reasons(lit.literal_table(files, "swift", keep=["file_id"]), ["file_id"])

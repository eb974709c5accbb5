"""Queries over policies, lists and flags."""

from __future__ import annotations

from pyspark.sql import functions as F

from symloom.operators import flags as fl, lexical as lex, policy as pol, reports
from symloom.queries.derived import IDENT, NODES_CTE, ident_names, node_rows, render, table
from symloom.queries.registry import query
from symloom.sources import files as src, lists as ls

# A small policy; such lists live in config files.
_POLICY = {
    "include.obfuscation": ["*", "hot*", "small_gear", "zz?none*", "noSuchName"],
    "exclude.obfuscation": ["Blue[BG]*", "*Ring", "cold_bolt", "absentOne", "absentTwo", "absent3", "absent4", "absent5", "absent6", "q*q*"],
    "include.encryption": ["ad", "t", "missing one", "x*x*x"],
    "exclude.encryption": ["track", "*rticle", "h?"],
}


def _like(name: str) -> str:
    """The policy's wildcard tests, written out for the oracle."""
    return (f"({name} LIKE 'hot%' AND pattern = 'hot*') OR (regexp_matches({name}, '^Blue[BG]') AND pattern = 'Blue[BG]*') OR ({name} LIKE '%Ring' AND pattern = '*Ring') "
            f"OR ({name} LIKE '%rticle' AND pattern = '*rticle') OR (regexp_matches({name}, '^h.$') AND pattern = 'h?') OR (regexp_matches({name}, '^q.*q') AND pattern = 'q*q*') "
            f"OR (regexp_matches({name}, '^zz.none') AND pattern = 'zz?none*') OR (regexp_matches({name}, '^x.*x.*x$') AND pattern = 'x*x*x') OR pattern = '*' OR {name} = pattern")


_POLICY_ROWS = "pol AS (SELECT category, unnest(ps) AS pattern FROM (VALUES " + ", ".join(
    f"('{c}', [{', '.join(repr(p) for p in ps)}])" for c, ps in _POLICY.items()) + ") t(category, ps))"


@query("policy_presence", rf"""
    WITH {_POLICY_ROWS}, names AS (
      SELECT DISTINCT unnest(regexp_extract_all(html, 'class="([^"]*)"', 1) || regexp_extract_all(html, '<([a-z][a-z0-9]*)', 1)
        || regexp_extract_all(html, '\b([A-Za-z_][A-Za-z0-9_]*)\([0-9]+\)', 1) || regexp_extract_all(html, '\bvar\s+([A-Za-z_][A-Za-z0-9_]*)', 1)) AS name FROM pages),
    f AS (SELECT category, pattern, CASE WHEN pattern = '*' THEN 'bare_star' WHEN regexp_matches(pattern, '[*?\[]') THEN 'wildcard_without_match' ELSE 'literal_absent' END AS finding
      FROM pol WHERE pattern = '*' OR NOT EXISTS (SELECT 1 FROM names WHERE name <> '' AND ({_like('name')})))
    SELECT DISTINCT category, finding, pattern FROM f""")
def policy_presence(spark, sf):
    pages = table(spark, sf, "pages").select(F.col("html").alias("text"))
    names = pol.name_lists(src.attr_values(pages, "class").withColumnRenamed("value", "name"), lex.identifiers(pages, "markup"))
    return pol.policy_presence(names, _POLICY)


_WILD = ["hot*", "Blue[BG]*", "*Ring", "small_gear", "cold_bolt", "?old*", "[!a-z]*-GEAR_", "new(*"]


@query("glob_matches", rf"""
    SELECT DISTINCT name, pattern FROM (SELECT {IDENT} AS name FROM part), (SELECT unnest(['hot*', 'Blue[BG]*', '*Ring', 'small_gear', 'cold_bolt', '?old*', '[!a-z]*-GEAR_']) AS pattern)
    WHERE CASE pattern WHEN 'hot*' THEN name LIKE 'hot%' WHEN 'Blue[BG]*' THEN regexp_matches(name, '^Blue[BG]') WHEN '*Ring' THEN name LIKE '%Ring'
      WHEN '?old*' THEN regexp_matches(name, '^.old') WHEN '[!a-z]*-GEAR_' THEN regexp_matches(name, '^[^a-z].*-GEAR_$') ELSE name = pattern END""")
def glob_matches(spark, sf):
    return pol.glob_match(ident_names(spark, sf), _WILD)


_ROWS = "rows AS (SELECT CASE p_size % 2 WHEN 0 THEN 'include' ELSE 'exclude' END AS section, CASE p_partkey % 3 WHEN 0 THEN 'encryption' ELSE 'obfuscation' END AS category, p_name AS pattern FROM part)"


def _rows(spark, sf):
    return table(spark, sf, "part").select(F.when(F.col("p_size") % 2 == 0, "include").otherwise("exclude").alias("section"),
                                           F.when(F.col("p_partkey") % 3 == 0, "encryption").otherwise("obfuscation").alias("category"), F.col("p_name").alias("pattern"))


@query("policy_conflicts", f"""
    WITH {_ROWS} SELECT category, pattern FROM rows WHERE section = 'include' INTERSECT SELECT category, pattern FROM rows WHERE section = 'exclude'""")
def policy_conflicts(spark, sf):
    return pol.policy_conflicts(_rows(spark, sf))


@query("policy_overlap", f"""
    WITH {_ROWS} SELECT DISTINCT section, category, pattern AS name FROM rows WHERE pattern IN (SELECT p_name FROM part WHERE p_size = 7)""")
def policy_overlap(spark, sf):
    exceptions = table(spark, sf, "part").where("p_size = 7").select(F.col("p_name").alias("name"))
    return pol.policy_overlap(_rows(spark, sf), exceptions)


@query("include_conflicts", f"""
    WITH {NODES_CTE} SELECT DISTINCT name FROM nodes WHERE is_exception = 1 AND (name LIKE 'm1%' OR name LIKE 'keep%' OR name = 'body')""")
def include_conflicts(spark, sf):
    return pol.resolve_conflicts(["m1*", "keep*", "body", "none?"], node_rows(spark, sf), "ask")[0]


@query("include_conflicts_forced", f"""
    WITH {NODES_CTE}, c AS (SELECT DISTINCT name FROM nodes WHERE is_exception = 1 AND (name LIKE 'm1%' OR name LIKE 'keep%'))
    SELECT node_id, CASE WHEN kind = 'function' AND name IN (SELECT name FROM c) THEN 0 ELSE is_exception END AS is_exception FROM nodes""")
def include_conflicts_forced(spark, sf):
    return pol.resolve_conflicts(["m1*", "keep*"], node_rows(spark, sf), "force")[1].select("node_id", "is_exception")


@query("exclude_candidates", f"""
    WITH {NODES_CTE}, corpus AS (SELECT DISTINCT 'm' || CAST(p_partkey AS STRING) AS name FROM part)
    SELECT name, name IN (SELECT name FROM nodes) AS in_nodes FROM corpus WHERE name LIKE 'm1%' OR regexp_matches(name, '^m[23]5.?$') OR name = 'm7'""")
def exclude_candidates(spark, sf):
    corpus = table(spark, sf, "part").select(F.concat(F.lit("m"), F.col("p_partkey").cast("string")).alias("name"))
    return pol.exclude_candidates(["m1*", "m[23]5", "m[23]5?", "m7", "zzz"], corpus, node_rows(spark, sf))


@query("name_lists_union", "SELECT DISTINCT name FROM (SELECT c_name AS name FROM customer UNION ALL SELECT s_name FROM supplier UNION ALL SELECT p_name FROM part)")
def name_lists_union(spark, sf):
    return pol.name_lists(*[table(spark, sf, t).select(F.col(c).alias("name")) for t, c in (("customer", "c_name"), ("supplier", "s_name"), ("part", "p_name"))])


_RULE_DOC = render("<<CASE WHEN p_partkey % 2 = 0 THEN '[' ELSE '{\"rules\": [' END>>{\"name\": \"r<<p_partkey>>\", \"kind\": \"Function\"}, {\"A_name\": \"q<<p_size>>\", \"B_kind\": \"file\", \"glob\": \"Gen/*<<p_size>>\"}]<<CASE WHEN p_partkey % 2 = 0 THEN '' ELSE '}' END>>")


@query("parsed_rules", """
    SELECT unnest([{'name': 'r' || CAST(p_partkey AS STRING), 'kind': 'function', 'glob': NULL}, {'name': 'q' || CAST(p_size AS STRING), 'kind': 'file', 'glob': 'Gen/*' || CAST(p_size AS STRING)}], recursive := true) FROM part""")
def parsed_rules(spark, sf):
    return ls.parse_rules(table(spark, sf, "part").select(F.expr(_RULE_DOC).alias("value"))).select("name", "kind", "glob")


@query("rule_file_patterns", """
    SELECT DISTINCT unnest(['gen/*' || CAST(p_size AS STRING), 'q' || CAST(p_size AS STRING)]) AS pattern FROM part""")
def rule_file_patterns(spark, sf):
    return ls.rule_file_globs(ls.parse_rules(table(spark, sf, "part").select(F.expr(_RULE_DOC).alias("value"))))


_TARGET_DOC = render("<<CASE p_partkey % 4 WHEN 0 THEN '{\"class\": [\"A' WHEN 1 THEN '{\"kind\": \"Struct\", \"names\": [\"A' WHEN 2 THEN '{\"names\": [\"A' ELSE '[\"A' END>><<p_partkey>>\", \"B\"]<<CASE p_partkey % 4 WHEN 0 THEN ', \"other\": [\"skip\"]}' WHEN 3 THEN '' ELSE '}' END>>")


@query("parsed_targets", """
    SELECT kind, name, count(*) AS n FROM (SELECT CASE p_partkey % 4 WHEN 0 THEN 'class' WHEN 1 THEN 'struct' ELSE 'function' END AS kind, unnest(['A' || CAST(p_partkey AS STRING), 'B']) AS name FROM part) GROUP BY ALL""")
def parsed_targets(spark, sf):
    rows = ls.parse_targets(table(spark, sf, "part").select(F.expr(_TARGET_DOC).alias("value")))
    return rows.groupBy("kind", "name").agg(F.count("*").alias("n"))


@query("parsed_forbidden", """
    SELECT DISTINCT name FROM (SELECT unnest(['A' || CAST(p_partkey AS STRING), 'B']) AS name FROM part UNION ALL SELECT 'skip' FROM part WHERE p_partkey % 4 = 0)""")
def parsed_forbidden(spark, sf):
    return ls.parse_forbidden(table(spark, sf, "part").select(F.expr(_TARGET_DOC).alias("value")))


_CONFIG = render('{"project": <<CASE WHEN p_size % 5 = 0 THEN \'"flat"\' ELSE \'{}\' END>>, "_comment": 1, "extra<<p_size % 3>>": [], "include": {"obfuscation": [" a<<p_partkey>> ", "b*", 7, "", "b*"], "encryption": "lone<<p_size>>", "other": ["x"]}, '
                 '"exclude": {"obfuscation": <<CASE WHEN p_size % 4 = 0 THEN \'{"a": 1}\' ELSE \'["c?"]\' END>>}}')


def _configs(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("config_id"), F.expr(_CONFIG).alias("value"))


@query("policy_table", """
    SELECT config_id, unnest([{'section': 'include', 'category': 'obfuscation', 'pattern': 'a' || CAST(config_id AS STRING), 'is_wildcard': false}, {'section': 'include', 'category': 'obfuscation', 'pattern': 'b*', 'is_wildcard': true},
      {'section': 'include', 'category': 'encryption', 'pattern': 'lone' || CAST(p_size AS STRING), 'is_wildcard': false}], recursive := true) FROM (SELECT p_partkey AS config_id, p_size FROM part)
    UNION ALL SELECT p_partkey, 'exclude', 'obfuscation', 'c?', true FROM part WHERE p_size % 4 <> 0""")
def policy_table(spark, sf):
    rows = ls.policy_table(_configs(spark, sf))
    return rows.select("config_id", "section", "category", "pattern", "is_wildcard")


@query("policy_findings", """
    SELECT p_partkey AS config_id, 'unknown_key' AS finding, 'extra' || CAST(p_size % 3 AS STRING) AS item FROM part
    UNION ALL SELECT p_partkey, 'not_an_object', 'project' FROM part WHERE p_size % 5 = 0
    UNION ALL SELECT p_partkey, 'not_a_list', 'exclude.obfuscation' FROM part WHERE p_size % 4 = 0""")
def policy_findings(spark, sf):
    return ls.policy_findings(_configs(spark, sf))


@query("first_seen_order", "SELECT p_brand, p_name, min(p_partkey) AS p_partkey FROM part GROUP BY p_brand, p_name")
def first_seen_order(spark, sf):
    return ls.first_seen(table(spark, sf, "part").select("p_brand", "p_name", "p_partkey"), ["p_brand"], "p_name", "p_partkey")


@query("sample_of_sorted_names", "SELECT DISTINCT c_name FROM customer ORDER BY c_name LIMIT 20")
def sample_of_sorted_names(spark, sf):
    return ls.sample_sorted(table(spark, sf, "customer"), "c_name", 20)


@query("latest_rules", "SELECT p_name AS name, arg_max(p_brand, p_partkey) AS kind, arg_max(p_type, p_partkey) AS comment FROM part GROUP BY p_name")
def latest_rules(spark, sf):
    rules = table(spark, sf, "part").select(F.col("p_name").alias("name"), F.col("p_brand").alias("kind"), F.col("p_type").alias("comment"), "p_partkey")
    return ls.latest_rule_by_name(rules, "p_partkey").select("name", "kind", "comment")


# Flags on nodes.

@query("merged_exceptions", """
    SELECT location, arg_min(source, r) AS source FROM (SELECT CAST(c_custkey AS STRING) AS location, 'external' AS source, 0 AS r FROM customer WHERE c_mktsegment = 'BUILDING'
      UNION ALL SELECT CAST(o_custkey AS STRING), 'internal', 1 FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT CAST(s_suppkey AS STRING), 'sdk', 2 FROM supplier) GROUP BY location""")
def merged_exceptions(spark, sf):
    def part(name, column, where, source):
        return table(spark, sf, name).where(where).select(F.col(column).cast("string").alias("location"), F.lit(source).alias("source"))
    return fl.merge_exceptions(part("customer", "c_custkey", "c_mktsegment = 'BUILDING'", "external"), part("orders", "o_custkey", "o_orderstatus = 'F'", "internal"),
                               part("supplier", "s_suppkey", "true", "sdk"))


@query("tagged_documents", "SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) THEN 1 ELSE 0 END AS is_exception FROM documents")
def tagged_documents(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.lit(0).alias("is_exception"))
    return fl.tag_exceptions(docs, table(spark, sf, "labels").where("toxic = 1"), "doc_id").select("doc_id", "is_exception")


@query("tagged_names", f"""
    WITH {NODES_CTE} SELECT node_id, CASE WHEN name IN (SELECT 'm' || CAST(p_partkey AS STRING) FROM part WHERE p_size < 10) THEN 1 ELSE is_exception END AS is_exception FROM nodes""")
def tagged_names(spark, sf):
    scored = table(spark, sf, "part").where("p_size < 10").select(F.concat(F.lit("m"), F.col("p_partkey").cast("string")).alias("name"))
    return fl.tag_names(node_rows(spark, sf), scored).select("node_id", "is_exception")


_RENAMEABLE = f"""WITH {NODES_CTE}, flagged AS (SELECT DISTINCT name, kind, CASE WHEN kind IN ('variable', 'case', 'function') THEN 'value' ELSE kind END AS grp FROM nodes WHERE is_exception = 1),
    ok AS (SELECT DISTINCT kind, name FROM nodes n WHERE is_exception = 0 AND kind <> 'extension' AND NOT EXISTS (SELECT 1 FROM flagged f WHERE f.name = n.name AND f.kind = n.kind)
      AND NOT (kind IN ('variable', 'case', 'function') AND EXISTS (SELECT 1 FROM flagged f WHERE f.grp = 'value' AND f.name = CASE WHEN n.name LIKE '`%`' THEN n.name[2:-2] ELSE n.name END)))"""


@query("renameable_names", f"{_RENAMEABLE} SELECT kind, name FROM ok")
def renameable_names(spark, sf):
    return fl.renameable(node_rows(spark, sf))


@query("merged_kinds", f"{_RENAMEABLE} SELECT DISTINCT CASE kind WHEN 'case' THEN 'variable' WHEN 'actor' THEN 'class' ELSE kind END AS kind, name FROM ok")
def merged_kinds(spark, sf):
    return fl.merge_kinds(fl.renameable(node_rows(spark, sf)))


@query("all_names", f"WITH {NODES_CTE} SELECT name FROM nodes UNION SELECT p_name FROM part")
def all_names(spark, sf):
    return fl.all_names(node_rows(spark, sf), table(spark, sf, "part").select(F.col("p_name").alias("name")))


_MAP = "mapping AS (SELECT 'm' || CAST(p_partkey AS STRING) AS target, 'm' || CAST(p_partkey * 3 % 500 AS STRING) AS replacement FROM part)"


def _mapping(spark, sf):
    return table(spark, sf, "part").select(F.concat(F.lit("m"), F.col("p_partkey").cast("string")).alias("target"),
                                           F.concat(F.lit("m"), (F.col("p_partkey") * 3 % 500).cast("string")).alias("replacement"))


@query("mapping_dump", f"{_RENAMEABLE}, {_MAP} SELECT kind AS category, name AS original, replacement FROM ok JOIN mapping ON name = target")
def mapping_dump(spark, sf):
    return fl.mapping_dump(fl.renameable(node_rows(spark, sf)), _mapping(spark, sf))


@query("mapping_audit", f"""
    WITH {NODES_CTE}, {_MAP} SELECT count(*) AS n, count(*) FILTER (target IN (SELECT name FROM nodes)) AS targets_found, count(*) FILTER (replacement IN (SELECT name FROM nodes)) AS replacements_found,
      (SELECT count(*) FROM (SELECT replacement FROM mapping GROUP BY replacement HAVING count(*) > 1)) AS replacements_reused FROM mapping""")
def mapping_audit(spark, sf):
    return fl.audit_mapping(_mapping(spark, sf), node_rows(spark, sf))


# Members as tree nodes: region, nation and customer above each order.
_TREE_ROWS = """tree AS (SELECT o_orderkey AS node_id, 'o' || CAST(o_orderkey % 50 AS STRING) AS name, CASE o_orderkey % 2 WHEN 0 THEN 'function' ELSE 'variable' END AS kind,
    ['R' || CAST(n_regionkey AS STRING), 'N' || CAST(n_nationkey AS STRING), 'C' || CAST(c_custkey % 10 AS STRING)] AS parents, [-1 - n_regionkey, -100 - n_nationkey, -1000 - c_custkey] AS ancestor_ids,
    CASE WHEN o_orderkey % 9 = 0 THEN 1 WHEN o_orderkey % 9 = 1 THEN NULL ELSE 0 END AS is_exception FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT -1000 - c_custkey, 'C' || CAST(c_custkey % 10 AS STRING), 'class', ['R' || CAST(n_regionkey AS STRING), 'N' || CAST(n_nationkey AS STRING)], [-1 - n_regionkey, -100 - n_nationkey], 0
    FROM customer JOIN nation ON c_nationkey = n_nationkey)"""
_SPECS = ["function:o7", "o11", "N3.C4.o12", "R1.N1.C2", "variable:o14", "C5.o15", "nothing", "N2.o16"]
_SPEC_SQL = """(name = 'o7' AND kind = 'function') OR name = 'o11' OR (name = 'o12' AND parents[-2:] = ['N3', 'C4']) OR (name = 'C2' AND parents[-2:] = ['R1', 'N1'])
    OR (name = 'o14' AND kind = 'variable') OR (name = 'o15' AND parents[-1] = 'C5') OR (name = 'o16' AND parents[-1] = 'N2')"""


def _tree(spark, sf):
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(
        table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    s = lambda prefix, col: F.concat(F.lit(prefix), col.cast("string"))
    r, n, k = s("R", F.col("n_regionkey")), s("N", F.col("n_nationkey")), s("C", F.col("c_custkey") % 10)
    ids = [(-1 - F.col("n_regionkey")).cast("long"), (-100 - F.col("n_nationkey")).cast("long"), (-1000 - F.col("c_custkey")).cast("long")]
    key = F.col("o_orderkey")
    members = o.select(key.alias("node_id"), s("o", key % 50).alias("name"), F.when(key % 2 == 0, "function").otherwise("variable").alias("kind"),
                       F.array(r, n, k).alias("parents"), F.array(*ids).alias("ancestor_ids"),
                       F.when(key % 9 == 0, 1).when(key % 9 == 1, None).otherwise(0).alias("is_exception"))
    types = c.select(ids[2].alias("node_id"), k.alias("name"), F.lit("class").alias("kind"), F.array(r, n).alias("parents"), F.array(*ids[:2]).alias("ancestor_ids"), F.lit(0).alias("is_exception"))
    return members.unionByName(types).withColumn("has_flag", F.col("is_exception").isNotNull())


def _specs(spark):
    return spark.createDataFrame([(s,) for s in _SPECS], "spec string")


@query("matched_specs", f"WITH {_TREE_ROWS} SELECT node_id FROM tree WHERE {_SPEC_SQL}")
def matched_specs(spark, sf):
    return fl.match_specs(_tree(spark, sf), _specs(spark)).select("node_id").distinct()


@query("updated_flags", f"""
    WITH {_TREE_ROWS}, m AS (SELECT *, ({_SPEC_SQL}) AS hit FROM tree), h AS (SELECT node_id FROM m WHERE hit),
    v AS (SELECT *, hit AND NOT EXISTS (SELECT 1 FROM h WHERE list_contains(ancestor_ids, h.node_id)) AS visited FROM m)
    SELECT node_id, CASE WHEN visited AND is_exception = 0 THEN 'changed' WHEN visited THEN 'unchanged' END AS status, CASE WHEN visited AND is_exception = 0 THEN 1 ELSE is_exception END AS is_exception FROM v""")
def updated_flags(spark, sf):
    return fl.set_flags(_tree(spark, sf), _specs(spark), 1, only_explicit_zero=True).select("node_id", "status", "is_exception")


@query("unmatched_specs", f"""
    WITH {_TREE_ROWS}, m AS (SELECT *, ({_SPEC_SQL}) AS hit FROM tree), h AS (SELECT node_id FROM m WHERE hit)
    SELECT leaf AS name FROM (SELECT unnest(['o7', 'o11', 'o12', 'C2', 'o14', 'o15', 'nothing', 'o16']) AS leaf)
    WHERE leaf NOT IN (SELECT name FROM m WHERE hit AND NOT EXISTS (SELECT 1 FROM h WHERE list_contains(ancestor_ids, h.node_id)))""")
def unmatched_specs(spark, sf):
    tree = _tree(spark, sf)
    return fl.missing_specs(tree, _specs(spark), fl.set_flags(tree, _specs(spark), 0))


@query("compared_exclusions", f"""
    WITH {_TREE_ROWS}, n AS (SELECT name, array_to_string(list_append(parents, name), '.') AS path, coalesce(is_exception, 0) AS f FROM tree), w AS (
      SELECT DISTINCT CASE p_partkey % 5 WHEN 0 THEN 'o' || CAST(p_size AS STRING) WHEN 1 THEN 'R1.N1.C' || CAST(p_size AS STRING) WHEN 2 THEN 'O' || CAST(p_size AS STRING)
        WHEN 3 THEN 'r1.n1.c' || CAST(p_size AS STRING) ELSE 'none' || CAST(p_size AS STRING) END AS name FROM part)
    SELECT name, CASE best WHEN 1 THEN 'one' WHEN 0 THEN 'zero' ELSE 'missing' END AS status FROM (SELECT name, coalesce((SELECT max(f) FROM n WHERE n.name = w.name), (SELECT max(f) FROM n WHERE n.path = w.name),
      (SELECT max(f) FROM n WHERE lower(n.name) = lower(w.name)), (SELECT max(f) FROM n WHERE lower(n.path) = lower(w.name))) AS best FROM w)""")
def compared_exclusions(spark, sf):
    nodes = _tree(spark, sf).withColumn("path", F.array_join(F.array_append("parents", F.col("name")), "."))
    name = F.expr("CASE p_partkey % 5 WHEN 0 THEN concat('o', p_size) WHEN 1 THEN concat('R1.N1.C', p_size) WHEN 2 THEN concat('O', p_size) WHEN 3 THEN concat('r1.n1.c', p_size) ELSE concat('none', p_size) END")
    return fl.compare_exclusions(table(spark, sf, "part").select(name.alias("name")), nodes)


@query("edit_summary", """
    SELECT project, file, count(*) AS n_files, CAST(sum(n) AS BIGINT) AS n_edits FROM (SELECT l_returnflag AS project, l_suppkey AS file, CAST(sum(l_quantity) AS BIGINT) AS n FROM lineitem GROUP BY ALL) GROUP BY ROLLUP (project, file)""")
def edit_summary(spark, sf):
    edits = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("project"), F.col("l_suppkey").alias("file"), F.col("l_quantity").cast("long").alias("n_edits"))
    return reports.edit_summary(edits)


@query("group_status", """
    SELECT user_id, CASE WHEN bool_or(event_type = 'purchase') THEN 'Done' ELSE 'Skipped' END AS status, count(DISTINCT event_type) AS n_steps FROM events GROUP BY user_id""")
def group_status(spark, sf):
    return reports.group_status(table(spark, sf, "events"), ["user_id"], "event_type", "event_type", "purchase")

"""Whole plans as queries: classified nodes, renamed texts, policies, literals, calls."""

from __future__ import annotations

from pyspark.sql import functions as F


from symloom.plans.classify import classify
from symloom.plans.preflight import preflight
from symloom.plans.quiet import protect_literals, remove_debug_calls
from symloom.plans.rename import functions_to_wrap, rename
from symloom.queries.derived import render, swift_files, table
from symloom.queries.lexical import _DECLS
from symloom.queries.registry import query
from symloom.queries.tokens import _QUIET

_K = "CAST(p_partkey AS STRING)"


def _catalogs(spark, sf):
    """Classes Base0..8 and protocols Printable0..3, each with members; an SDK that knows String."""
    n = F.col("n_nationkey")
    nation = table(spark, sf, "nation")

    def types(prefix, by, kind, base_id, member):
        name = F.concat(F.lit(prefix), (n % by).cast("string"))
        ext = nation.select((n % by + base_id).cast("long").alias("node_id"), name.alias("name"), F.lit(kind).alias("kind"),
                            F.array().cast("array<string>").alias("params")).distinct()
        members = nation.select((n % by + base_id).cast("long").alias("parent_id"), F.concat(F.lit(member), n.cast("string")).alias("name"),
                                F.lit("function").alias("kind"))
        return ext, members

    a, am = types("Base", 9, "class", 0, "draw")
    b, bm = types("Printable", 4, "protocol", 100, "extra")
    sdk = spark.createDataFrame([("String", "Struct", "count", "Var", "count")], "type_name string, kind string, member string, member_kind string, member_type string")
    return a.unionByName(b), am.unionByName(bm), sdk


def _classified(spark, sf):
    ext, members, sdk = _catalogs(spark, sf)
    listed = table(spark, sf, "nation").select(F.concat(F.lit("top"), F.col("n_nationkey").cast("string")).alias("name"))
    return classify(swift_files(spark, sf), ext, members, sdk, listed)


@query("classified_nodes", f"""
    WITH d AS (SELECT p_partkey, p_size, unnest([{_DECLS}], recursive := true) FROM part)
    SELECT p_partkey AS file_id, line, name, CAST(name IN ('draw' || {_K}, 'extra' || {_K}) AND p_partkey < 25 OR name = 'on' || {_K} OR name = 'off' OR name = 'count' || {_K}
      OR (name = 'top' || {_K} AND p_partkey < 25) AS INT) AS is_exception FROM d""")
def classified_nodes(spark, sf):
    """``draw`` and ``extra`` by external name, enum cases by raw value, ``count`` by attribute, ``top`` by list."""
    return _classified(spark, sf).select("file_id", F.col("loc.line").alias("line"), "name", "is_exception")


@query("renamed_texts")
def renamed_texts(spark, sf):
    part = table(spark, sf, "part")
    kinds = F.explode(F.array(*[F.lit(k) for k in ("class", "struct", "enum", "protocol", "function", "variable", "typealias")]))
    label = F.concat(F.expr(render("<<CASE p_partkey % 2 WHEN 0 THEN 'zq' ELSE 'Zq' END>><<p_partkey>>")), F.lit("x"))
    pool = part.select(label.alias("name"), kinds.alias("kind"))
    clusters = spark.createDataFrame([(k, 0, "wyvern", ["wyvern"]) for k in ("class", "enum", "protocol", "function", "variable", "typealias")],
                                     "kind string, cluster_id int, rep string, tokens array<string>")
    members = pool.where("name like '%1x'").select("kind", F.lit(0).alias("cluster_id"), "name")
    nodes = _classified(spark, sf)
    return rename(swift_files(spark, sf), nodes, nodes.select("name").limit(0), clusters, members, pool).files.select("file_id", F.md5("text").alias("digest"))


@query("functions_to_wrap", f"""
    SELECT p_partkey AS file_id, unnest([{{'name': 'load' || {_K}, 'excluded': true, 'is_safe': true, 'blocked_by': 'unknown_type'}}, {{'name': 'draw' || {_K}, 'excluded': false, 'is_safe': false, 'blocked_by': 'protocol_requirement'}},
      {{'name': 'nested' || {_K}, 'excluded': false, 'is_safe': false, 'blocked_by': CASE WHEN p_size % 5 = 0 THEN 'actor_isolated' END}}, {{'name': 'extra' || {_K}, 'excluded': false, 'is_safe': false, 'blocked_by': 'external_protocol_extension'}},
      {{'name': 'peek' || {_K}, 'excluded': true, 'is_safe': true, 'blocked_by': NULL}}, {{'name': 'poke' || {_K}, 'excluded': true, 'is_safe': false, 'blocked_by': 'actor_isolated'}},
      {{'name': 'free' || {_K}, 'excluded': false, 'is_safe': false, 'blocked_by': NULL}}], recursive := true) FROM part""")
def wrapped_functions(spark, sf):
    rules = spark.createDataFrame([("load*", "function"), ("Store*", "actor")], "name string, kind string")
    return functions_to_wrap(swift_files(spark, sf), rules).select("file_id", "name", "excluded", "is_safe", "blocked_by")


@query("protected_literals", f"""
    SELECT p_partkey AS file_id, unnest([{{'line_no': 8, 'value': '"' || p_name || '"'}}], recursive := true) FROM part""")
def protected_literals(spark, sf):
    """Part types are excluded by policy; what is left is encrypted."""
    policy = table(spark, sf, "part").select(F.lit("exclude").alias("section"), F.lit("encryption").alias("category"), F.col("p_type").alias("pattern")).distinct()
    out = protect_literals(swift_files(spark, sf), policy, F.lit(bytearray(b"0123456789abcdef")))
    return out.encrypted.where(F.length("cipher") > 0).select("file_id", "line_no", "value")


@query("quiet_files", f"SELECT p_partkey AS file_id, 2 AS n_removed, md5({_QUIET}) AS digest FROM part")
def quiet_files(spark, sf):
    return remove_debug_calls(swift_files(spark, sf)).files.select("file_id", "n_removed", F.md5("text").alias("digest"))


@query("preflight_flags", r"""
    SELECT p_partkey AS node_id, CASE WHEN p_name LIKE 'hot%' AND p_partkey % 3 = 0 THEN 'unchanged' WHEN p_name LIKE 'hot%' THEN 'changed' END AS status FROM part""")
def preflight_flags(spark, sf):
    part = table(spark, sf, "part")
    empty = F.array()
    nodes = part.select(F.col("p_partkey").alias("node_id"), F.col("p_name").alias("name"), F.lit("class").alias("kind"), F.col("p_name").alias("path"),
                        empty.cast("array<string>").alias("parents"), empty.cast("array<bigint>").alias("ancestor_ids"),
                        (F.col("p_partkey") % 3 == 0).cast("int").alias("is_exception"), F.lit(True).alias("has_flag"))
    done = preflight(part.select(F.col("p_name").alias("name")), nodes, {"exclude.obfuscation": ["hot*", "gone"]}, part.select(F.col("p_type").alias("name")))
    return done.nodes.select("node_id", "status")

"""Queries over paths, markup and project files."""

from __future__ import annotations

from pyspark.sql import functions as F

from symloom.functions import text as tx
from symloom.queries.derived import SWIFT, render, swift_files, table
from symloom.queries.registry import query
from symloom.session import new_folder
from symloom.sources import files as src

_KEYWORDS = ["blog", "/fr/", ".org"]


@query("filter_paths", """
    SELECT page_id, url FROM pages
    WHERE NOT contains(lower(regexp_replace(url, '[^/]*$', '')), 'blog')
      AND NOT contains(lower(regexp_replace(url, '[^/]*$', '')), '/fr/')
      AND NOT contains(lower(regexp_replace(url, '[^/]*$', '')), '.org')
      AND split_part(url, '/', -1) NOT IN ('176.html', '25')""")
def filter_paths(spark, sf):
    return src.filter_paths(table(spark, sf, "pages").select("page_id", "url"), "url", _KEYWORDS, ["176.html", "25"])


_PATH = render("App/<<p_type>>/<<CASE p_size % 7 WHEN 0 THEN 'Views' WHEN 1 THEN 'Pods' WHEN 2 THEN '.build/checkouts' "
               "WHEN 3 THEN 'frameworks' WHEN 4 THEN 'Kit.framework' WHEN 5 THEN 'screens' ELSE 'Podsy' END>>/"
               "<<replace(p_name, ' ', '')>><<p_partkey>><<CASE p_partkey % 8 WHEN 0 THEN '.xib' WHEN 1 THEN '.storyboard' WHEN 2 THEN '.plist' "
               "WHEN 3 THEN '.swift' WHEN 4 THEN 'View.swift' WHEN 5 THEN 'Cell.swift' WHEN 6 THEN 'Theme.swift' ELSE '.imageset.json' END>>")


def _paths(spark, sf):
    return table(spark, sf, "part").select("p_partkey", "p_size", F.expr(_PATH).alias("path"))


@query("sidecar_files", f"""
    SELECT p_partkey, path FROM (SELECT p_partkey, {_PATH} AS path FROM part) WHERE p_partkey % 8 IN (0, 1, 2, 7)""")
def sidecar_files(spark, sf):
    return src.sidecars(_paths(spark, sf), "path").select("p_partkey", "path")


@query("file_origin", """
    SELECT p_partkey, CASE WHEN p_size % 7 IN (1, 2, 3, 4) THEN 'external' ELSE 'internal' END AS origin FROM part""")
def file_origin(spark, sf):
    return _paths(spark, sf).select("p_partkey", src.file_origin("path").alias("origin"))


@query("ui_paths", """
    SELECT p_partkey, p_size % 7 = 0 OR p_partkey % 8 = 4 AS short_rule,
           p_size % 7 IN (0, 5) OR p_partkey % 8 IN (4, 5, 6) AS long_rule FROM part""")
def ui_paths(spark, sf):
    return _paths(spark, sf).select("p_partkey", tx.is_ui_path("path", "short").alias("short_rule"),
                                    tx.is_ui_path("path", "long").alias("long_rule"))


@query("attr_values_class", """
    SELECT DISTINCT value FROM (SELECT unnest(regexp_extract_all(html, 'class="([^"]*)"', 1)) AS value FROM pages) WHERE value <> ''""")
def attr_values_class(spark, sf):
    return src.attr_values(table(spark, sf, "pages"), "class", "html")


@query("attr_values_href", """
    SELECT DISTINCT value FROM (SELECT unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS value FROM pages) WHERE value <> ''""")
def attr_values_href(spark, sf):
    return src.attr_values(table(spark, sf, "pages"), "href", "html")


_ASSET = render("Assets/<<upper(p_type)>>/<<upper(substr(p_name, 1, 1))>><<substr(replace(p_name, ' ', ''), 2)>>.imageset")


@query("asset_names", """
    SELECT DISTINCT unnest([n, lower(n)]) AS name FROM (
      SELECT upper(substr(p_name, 1, 1)) || substr(replace(p_name, ' ', ''), 2) AS n FROM part)""")
def asset_names(spark, sf):
    return src.asset_names(table(spark, sf, "part").select(F.expr(_ASSET).alias("path")), "path")


_LAYOUT = ("CASE WHEN p_size = 7 AND p_brand < 'Brand#2' THEN 'Package.swift' WHEN p_size = 8 AND p_brand LIKE '%3' THEN 'Project.swift' "
           "WHEN p_size = 9 AND p_brand LIKE '%5' THEN 'App.xcodeproj/project.pbxproj' ELSE 'Sources/a.swift' END")


@query("project_layout", """
    SELECT p_brand AS project, CASE WHEN bool_or(p_size = 7 AND p_brand < 'Brand#2') THEN 'spm' WHEN bool_or(p_size = 8 AND p_brand LIKE '%3') THEN 'tuist'
      WHEN bool_or(p_size = 9 AND p_brand LIKE '%5' AND NOT (p_size = 8 AND p_brand LIKE '%3')) THEN 'xcode' ELSE 'unknown' END AS layout
    FROM part GROUP BY p_brand""")
def project_layout(spark, sf):
    rows = table(spark, sf, "part").select(F.col("p_brand").alias("project"), F.expr(_LAYOUT).alias("rel_path"))
    return src.project_layout(rows)


@query("file_scoped_ids", f"""
    SELECT p_partkey, upper(sha256(path)) AS scoped_id FROM (SELECT p_partkey, {_PATH} AS path FROM part)""")
def file_scoped_ids(spark, sf):
    from symloom.functions.names import file_scoped_id

    return _paths(spark, sf).select("p_partkey", file_scoped_id("path").alias("scoped_id"))


@query("squeeze_documents", r"""
    SELECT doc_id, md5(trim(regexp_replace(regexp_replace(padded, '[ \t]+\n', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), chr(10))) AS digest
    FROM (SELECT doc_id, replace(text, '. ', '.  ' || chr(10) || chr(10) || chr(10)) || chr(10) AS padded FROM documents)""")
def squeeze_documents(spark, sf):
    docs = table(spark, sf, "documents")
    padded = F.concat(F.replace("text", F.lit(". "), F.lit(".  \n\n\n")), F.lit("\n"))
    return docs.select("doc_id", F.md5(tx.squeeze(padded)).alias("digest"))


@query("strip_comments_markup", """
    SELECT page_id, md5(regexp_replace(html, '(?s)<!--.*?-->', '', 'g')) AS digest FROM pages""")
def strip_comments_markup(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.md5(tx.strip_comments("html", "markup")).alias("digest"))


@query("blank_comments_markup", """
    WITH p AS (SELECT page_id, html, regexp_split_to_array(html, '(?s)<!--.*?-->') AS t, regexp_extract_all(html, '(?s)<!--.*?-->') AS c FROM pages)
    SELECT page_id, md5(array_to_string([x || coalesce(repeat(' ', length(c[i])), '') FOR x, i IN t], '')) AS digest, length(html) AS n_chars FROM p""")
def blank_comments_markup(spark, sf):
    blank = tx.blank_comments("html", "markup")
    return table(spark, sf, "pages").select("page_id", F.md5(blank).alias("digest"), F.length(blank).cast("long").alias("n_chars"))


@query("strip_comments_code", r"""
    SELECT p_partkey AS file_id, text LIKE '%Hidden%' OR text LIKE '%commented%' AS left_over, length(text) AS n_chars FROM (
      SELECT p_partkey, regexp_replace(regexp_replace(src, '(?s)/\*.*?\*/', '', 'g'), '//[^\n]*', '', 'g') AS text FROM (SELECT p_partkey, {src} AS src FROM part))
    """.replace("{src}", render(SWIFT)))
def strip_comments_code(spark, sf):
    text = tx.strip_comments("text", "swift")
    return swift_files(spark, sf).select("file_id", (text.contains("Hidden") | text.contains("commented")).alias("left_over"),
                                         F.length(text).cast("long").alias("n_chars"))


@query("scanned_files", """
    SELECT 's_nationkey=' || CAST(s_nationkey AS STRING) AS folder, count(*) AS n_lines, md5(string_agg(s_name || chr(10), '' ORDER BY s_suppkey)) AS digest
    FROM supplier WHERE s_nationkey <> 3 GROUP BY s_nationkey""")
def scanned_files(spark, sf):
    """A file per nation is written to the shared folder and scanned; one folder is skipped."""
    folder = new_folder(spark, "scan")
    rows = table(spark, sf, "supplier").repartition("s_nationkey").sortWithinPartitions("s_nationkey", "s_suppkey")
    rows.select("s_nationkey", F.col("s_name").alias("value")).write.partitionBy("s_nationkey").text(folder)
    found = src.scan_files(spark, folder, (".txt",), ["s_nationkey=3"])
    return found.select(F.substring_index("rel_path", "/", 1).alias("folder"), F.regexp_count("text", F.lit("\n")).cast("long").alias("n_lines"), F.md5("text").alias("digest"))


@query("nested_node_files", """
    SELECT 'N' || CAST(s_nationkey AS STRING) AS path, 'class' AS kind, 0 AS depth FROM supplier GROUP BY s_nationkey
    UNION ALL SELECT 'N' || CAST(s_nationkey AS STRING) || '.S' || CAST(s_suppkey AS STRING), 'function', 1 FROM supplier""")
def nested_node_files(spark, sf):
    """A declaration file per nation, suppliers as its members, written and read back."""
    from symloom.sources.nodes import read_nodes

    folder = new_folder(spark, "nodes")
    name = lambda letter, key: F.concat(F.lit(letter), F.col(key).cast("string")).alias("A_name")
    member = F.struct(name("S", "s_suppkey"), F.lit("function").alias("B_kind"))
    files = table(spark, sf, "supplier").groupBy("s_nationkey").agg(F.collect_list(member).alias("members"))
    node = F.struct(name("N", "s_nationkey"), F.lit("class").alias("B_kind"))
    files.select("s_nationkey", node.alias("node"), F.col("members").alias("children")).write.partitionBy("s_nationkey").json(folder)
    return read_nodes(spark, folder).select("path", "kind", "depth")


@query("pools_and_clusters", """
    SELECT 'property' AS kind, 'pool' AS origin, p_name AS name, CAST(NULL AS STRING) AS tokens, CAST(NULL AS STRING) AS members, CAST(NULL AS BIGINT) AS cluster_id FROM (SELECT DISTINCT p_name FROM part)
    UNION ALL SELECT 'property', 'cluster', s_name, s_name || '|x', s_name || '|' || CAST(s_nationkey AS STRING), row_number() OVER (ORDER BY s_suppkey) - 1 FROM supplier""")
def pools_and_clusters(spark, sf):
    """A name pool and a cluster index of several files are written and read for a kind that shares those of another."""
    from symloom.sources import lists as ls

    folder = new_folder(spark, "pools")
    table(spark, sf, "part").select(F.col("p_name").alias("value")).distinct().write.text(f"{folder}/buckets_pool_variable.txt")
    ordered = table(spark, sf, "supplier").repartitionByRange(4, "s_suppkey").sortWithinPartitions("s_suppkey")
    cluster = ordered.select(F.col("s_name").alias("rep"), F.array("s_name", F.lit("x")).alias("tokens"),
                             F.array("s_name", F.col("s_nationkey").cast("string")).alias("members"))
    cluster.write.json(f"{folder}/cluster_index_variable.json")
    pool = ls.read_pool(spark, folder, ["property"]).select("kind", F.lit("pool").alias("origin"), "name", F.lit(None).cast("string").alias("tokens"),
                                                            F.lit(None).cast("string").alias("members"), F.lit(None).cast("long").alias("cluster_id"))
    return pool.unionByName(ls.read_clusters(spark, folder, ["property"], lines=True).select(
        "kind", F.lit("cluster").alias("origin"), F.col("rep").alias("name"), F.array_join("tokens", "|").alias("tokens"),
        F.array_join("members", "|").alias("members"), "cluster_id"))

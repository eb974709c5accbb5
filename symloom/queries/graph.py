"""Queries over the symbol graph and catalogs."""

from __future__ import annotations

from pyspark.sql import functions as F

from symloom.operators import catalog as cat, graph as g
from symloom.queries.derived import EDGES_SQL, NODES_CTE, key_edges, node_rows, render, table
from symloom.queries.registry import query

_TYPES = "('class', 'struct', 'enum', 'protocol', 'actor')"
_ALIASES = "aliases AS (SELECT 'Alias' || CAST(n_nationkey AS STRING) AS alias, ['Prot' || CAST(n_regionkey AS STRING), 'Cust' || CAST(n_nationkey AS STRING)] AS protocols FROM nation)"


def _types(spark, sf):
    return node_rows(spark, sf).where("parent_id is null")


def _aliases(spark, sf):
    n = F.col("n_nationkey").cast("string")
    return table(spark, sf, "nation").select(F.concat(F.lit("Alias"), n).alias("alias"), F.array(
        F.concat(F.lit("Prot"), F.col("n_regionkey").cast("string")), F.concat(F.lit("Cust"), n)).alias("protocols"))


@query("expand_aliases", f"""
    WITH {NODES_CTE}, {_ALIASES}, x AS (SELECT node_id, unnest(adopted) AS a, generate_subscripts(adopted, 1) AS i FROM nodes WHERE parent_id IS NULL)
    SELECT node_id, string_agg(coalesce(array_to_string(protocols, '|'), a), '|' ORDER BY i) AS adopted FROM x LEFT JOIN aliases ON a = alias GROUP BY node_id""")
def expand_aliases(spark, sf):
    return g.expand_aliases(_types(spark, sf), _aliases(spark, sf)).select("node_id", F.array_join("adopted", "|").alias("adopted"))


_EDGES = """e AS (SELECT unnest(adopted) AS parent, node_id AS child_id, name AS child, 'adopts' AS rel FROM nodes WHERE parent_id IS NULL AND kind <> 'extension'
  UNION ALL SELECT name, node_id, name, 'extends' FROM nodes WHERE kind = 'extension')"""


@query("symbol_edges", f"WITH {NODES_CTE}, {_EDGES} SELECT parent, child_id, rel FROM e")
def symbol_edges(spark, sf):
    return g.edges(_types(spark, sf)).select("parent", "child_id", "rel")


@query("linked_parents", f"""
    WITH {NODES_CTE}, {_EDGES}, t AS (SELECT name, min(node_id) AS parent_id FROM nodes WHERE kind IN {_TYPES} GROUP BY name)
    SELECT parent, child_id, rel, parent_id FROM e LEFT JOIN t ON parent = name""")
def linked_parents(spark, sf):
    nodes = _types(spark, sf)
    return g.link_parents(g.edges(nodes), nodes).select("parent", "child_id", "rel", "parent_id")


# Customers as types of projects that share type names.
_SHARED = """shared AS (SELECT c_nationkey AS project, c_custkey AS node_id, 'T' || CAST(c_custkey % 30 AS STRING) AS name,
    CASE c_custkey % 4 WHEN 0 THEN 'extension' ELSE 'class' END AS kind, 'T' || CAST(c_custkey * 7 % 40 AS STRING) AS base FROM customer)"""


def _shared_types(spark, sf):
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select(
        F.col("c_nationkey").alias("project"), k.alias("node_id"), F.concat(F.lit("T"), (k % 30).cast("string")).alias("name"),
        F.when(k % 4 == 0, "extension").otherwise("class").alias("kind"), F.array(F.concat(F.lit("T"), (k * 7 % 40).cast("string"))).alias("adopted"))


@query("linked_parents_by_project", f"""
    WITH {_SHARED}, e AS (SELECT project, CASE kind WHEN 'extension' THEN name ELSE base END AS parent, node_id AS child_id FROM shared),
    t AS (SELECT project, name AS parent, min(node_id) AS parent_id FROM shared WHERE kind = 'class' GROUP BY ALL)
    SELECT project, parent, child_id, parent_id FROM e LEFT JOIN t USING (project, parent)""")
def linked_parents_by_project(spark, sf):
    nodes = _shared_types(spark, sf)
    return g.link_parents(g.edges(nodes), nodes).select("project", "parent", "child_id", "parent_id")


@query("folded_extensions_by_project", f"""
    WITH {_SHARED}, x AS (SELECT project, name, list(DISTINCT base) AS extra FROM shared WHERE kind = 'extension' GROUP BY ALL)
    SELECT project, node_id, array_to_string(list_sort(list_distinct([base] || coalesce(extra, []))), '|') AS adopted FROM shared LEFT JOIN x USING (project, name) WHERE kind = 'class'""")
def folded_extensions_by_project(spark, sf):
    folded = g.fold_extensions(_shared_types(spark, sf)).where("kind = 'class'")
    return folded.select("project", "node_id", F.array_join(F.array_sort(F.array_distinct("adopted")), "|").alias("adopted"))


@query("renameable_names_by_project", f"""
    WITH {_SHARED}, n AS (SELECT project, name, kind, max(CAST(node_id % 11 = 0 AS INT)) AS flagged FROM shared GROUP BY ALL)
    SELECT project, kind, name FROM n WHERE kind = 'class' AND flagged = 0""")
def renameable_names_by_project(spark, sf):
    from symloom.operators.flags import renameable

    return renameable(_shared_types(spark, sf).withColumn("is_exception", (F.col("node_id") % 11 == 0).cast("int")))


@query("types_without_relations", f"""
    WITH {NODES_CTE}, {_EDGES} SELECT node_id FROM nodes WHERE kind IN {_TYPES} AND node_id % 30 = 1 AND name NOT IN (SELECT parent FROM e WHERE child_id % 30 <> 1)""")
def types_without_relations(spark, sf):
    nodes = _types(spark, sf)
    bare = nodes.withColumn("adopted", F.when(F.col("node_id") % 30 == 1, F.array().cast("array<string>")).otherwise(F.col("adopted")))
    return g.no_inheritance(bare, g.edges(bare)).select("node_id")


@query("folded_extensions", f"""
    WITH {NODES_CTE}, x AS (SELECT name, list_sort(list_distinct(flatten(list(adopted)))) AS extra FROM nodes WHERE kind = 'extension' GROUP BY name)
    SELECT node_id, array_to_string(list_sort(list_distinct(adopted || coalesce(extra, []))), '|') AS adopted FROM nodes LEFT JOIN x USING (name) WHERE kind IN {_TYPES}""")
def folded_extensions(spark, sf):
    folded = g.fold_extensions(_types(spark, sf)).where(F.col("kind").isin(g.TYPE_KINDS))
    return folded.select("node_id", F.array_join(F.array_sort(F.array_distinct("adopted")), "|").alias("adopted"))


@query("external_candidates", f"""
    WITH {NODES_CTE}, {_EDGES} SELECT DISTINCT child_id AS node_id FROM e WHERE parent NOT IN (SELECT name FROM nodes WHERE kind IN {_TYPES})
    UNION SELECT node_id FROM nodes WHERE kind = 'extension'""")
def external_candidates(spark, sf):
    nodes = _types(spark, sf)
    return g.external_candidates(nodes, g.edges(nodes))


@query("name_file_index", "SELECT DISTINCT p_name AS name, p_brand AS file FROM part")
def name_file_index(spark, sf):
    return cat.name_index(table(spark, sf, "part"), "p_name", "p_brand")


_EXT = """ext AS (SELECT 'Ext' || CAST(n_nationkey AS STRING) AS base, CASE n_nationkey % 2 WHEN 0 THEN 'protocol' ELSE 'class' END AS base_kind, n_nationkey FROM nation
    UNION ALL SELECT 'Cust' || CAST(n_nationkey AS STRING), 'protocol', n_nationkey FROM nation WHERE n_nationkey < 10),
  extm AS (SELECT base, base_kind, 'm' || CAST(i AS STRING) AS name, CASE i % 3 WHEN 0 THEN 'variable' WHEN 1 THEN 'function' ELSE 'case' END AS kind
    FROM ext, range(0, 200) r(i) WHERE i % 25 = n_nationkey UNION ALL SELECT base, base_kind, 'body', 'variable' FROM ext)"""
# Who is below whom, by id; every type is below itself.
_TREE = f"""links AS (SELECT t.parent_id AS up, child_id AS down FROM e JOIN (SELECT name, min(node_id) AS parent_id FROM nodes WHERE kind IN {_TYPES} GROUP BY name) t ON parent = t.name),
  tree AS (SELECT node_id AS root_id, node_id FROM nodes WHERE parent_id IS NULL UNION SELECT tree.root_id, links.down FROM tree JOIN links ON tree.node_id = links.up)"""


def _ext(spark, sf):
    n = F.col("n_nationkey")
    nation = table(spark, sf, "nation")
    kind = F.when(n % 2 == 0, "protocol").otherwise("class")
    types = (nation.select((n * 2).cast("long").alias("node_id"), F.concat(F.lit("Ext"), n.cast("string")).alias("name"), kind.alias("kind"), n)
             .unionByName(nation.where("n_nationkey < 10").select((n * 2 + 1).cast("long").alias("node_id"), F.concat(F.lit("Cust"), n.cast("string")).alias("name"), F.lit("protocol").alias("kind"), n)))
    i = F.explode(F.sequence(n, n + 175, F.lit(25)))
    members = (types.select(F.col("node_id").alias("parent_id"), i.alias("i"))
               .select("parent_id", F.concat(F.lit("m"), F.col("i").cast("string")).alias("name"),
                       F.when(F.col("i") % 3 == 0, "variable").when(F.col("i") % 3 == 1, "function").otherwise("case").alias("kind"))
               .unionByName(types.select(F.col("node_id").alias("parent_id"), F.lit("body").alias("name"), F.lit("variable").alias("kind"))))
    return types.drop("n_nationkey"), members


def _tree(nodes):
    edges = g.link_parents(g.edges(nodes), nodes).where("parent_id is not null")
    tree = g.reachable(edges.select(F.col("parent_id").alias("parent"), F.col("child_id").alias("child")), nodes.select(F.col("node_id").alias("node")))
    return tree.select(F.col("root").alias("root_id"), F.col("node").alias("node_id"))


@query("match_external", f"""
    WITH RECURSIVE {NODES_CTE}, {_EDGES}, {_EXT}, {_TREE},
    pairs AS (SELECT node_id, name AS base, true AS own FROM nodes WHERE kind = 'extension' UNION SELECT node_id, unnest(adopted), false FROM nodes WHERE parent_id IS NULL),
    hit AS (SELECT node_id, base, own FROM pairs WHERE base IN (SELECT base FROM ext)),
    owners AS (SELECT DISTINCT tree.node_id, base FROM hit JOIN tree ON tree.root_id = hit.node_id)
    SELECT DISTINCT node_id, 'external_extension' AS reason FROM hit WHERE own
    UNION SELECT m.node_id, 'external_member' FROM nodes m JOIN owners ON m.parent_id = owners.node_id JOIN extm ON extm.base = owners.base AND extm.name = m.name AND extm.kind = m.kind
      WHERE extm.base_kind = 'protocol' OR (extm.base_kind = 'class' AND list_contains(m.attributes, 'override'))""")
def match_external(spark, sf):
    nodes = node_rows(spark, sf)
    types = nodes.where("parent_id is null")
    ext, ext_members = _ext(spark, sf)
    return cat.match_external(types, nodes.where("parent_id is not null"), _tree(types), ext, ext_members)


_SDK = """sdk AS (SELECT base AS type_name, name AS member, CASE kind WHEN 'variable' THEN 'Var' WHEN 'function' THEN 'Func' ELSE 'EnumElement' END AS member_kind FROM extm
    UNION ALL SELECT b, NULL, NULL FROM (VALUES ('Codable'), ('Decodable'), ('Encodable')) t(b))"""


def _sdk(spark, sf):
    ext, members = _ext(spark, sf)
    named = members.join(ext.select(F.col("node_id").alias("parent_id"), F.col("name").alias("type_name")), "parent_id")
    kind = F.when(F.col("kind") == "variable", "Var").when(F.col("kind") == "function", "Func").otherwise("EnumElement")
    bases = spark.createDataFrame([("Codable",), ("Decodable",), ("Encodable",)], "type_name string")
    empty = F.lit(None).cast("string")
    return named.select("type_name", F.col("name").alias("member"), kind.alias("member_kind")).unionByName(
        bases.select("type_name", empty.alias("member"), empty.alias("member_kind")))


@query("match_sdk", f"""
    WITH RECURSIVE {NODES_CTE}, {_EDGES}, {_EXT}, {_TREE}, {_SDK},
    cand AS (SELECT node_id, name, kind, CASE WHEN list_contains(adopted, 'Codable') THEN list_distinct(adopted || ['Decodable', 'Encodable']) ELSE adopted END AS adopted FROM nodes WHERE parent_id IS NULL),
    hit AS (SELECT node_id, kind, base, own FROM (SELECT node_id, kind, name AS base, true AS own FROM cand WHERE kind = 'extension' UNION ALL SELECT node_id, kind, unnest(adopted), false FROM cand)
      WHERE base IN (SELECT type_name FROM sdk)),
    owners AS (SELECT DISTINCT tree.node_id, base FROM hit JOIN tree ON tree.root_id = hit.node_id),
    m AS (SELECT node_id AS member_id, parent_id, name, kind FROM nodes WHERE parent_id IS NOT NULL),
    raw AS (SELECT DISTINCT tree.node_id FROM hit JOIN tree ON tree.root_id = hit.node_id WHERE NOT own AND kind = 'enum' AND base IN ('Codable', 'Decodable', 'Encodable')),
    coding AS (SELECT DISTINCT tree.node_id FROM hit JOIN tree ON tree.root_id = hit.node_id WHERE NOT own AND base IN ('Decodable', 'Encodable'))
    SELECT node_id, 'sdk_extension' AS reason FROM hit WHERE own
    UNION SELECT member_id, 'sdk_raw_value' FROM m JOIN raw ON m.parent_id = raw.node_id WHERE kind = 'case'
    UNION SELECT member_id, 'sdk_coding' FROM m JOIN coding ON m.parent_id = coding.node_id
    UNION SELECT member_id, 'sdk_member' FROM m JOIN owners ON m.parent_id = owners.node_id JOIN sdk ON sdk.type_name = base AND sdk.member = m.name
      AND CASE sdk.member_kind WHEN 'Var' THEN 'variable' WHEN 'Func' THEN 'function' ELSE 'case' END = m.kind""")
def match_sdk(spark, sf):
    nodes = node_rows(spark, sf)
    types = nodes.where("parent_id is null")
    return cat.match_sdk(types, nodes.where("parent_id is not null"), _tree(types), _sdk(spark, sf))


@query("external_names", f"""
    WITH {NODES_CTE} SELECT DISTINCT name FROM (SELECT name FROM nodes UNION ALL SELECT unnest(params) FROM nodes) WHERE name <> '_'""")
def external_names(spark, sf):
    return cat.external_names(node_rows(spark, sf))


_DUMP = render('{"ABIRoot": {"name": "Kit<<p_size>>", "children": [{"kind": "Import", "name": "Dep<<p_partkey % 30>>"}, {"kind": "Import", "name": "_Private"}, '
               '{"kind": "Import", "name": "Kit<<p_size>>.Sub"}, {"kind": "TypeDecl", "declKind": "Class", "name": "T<<p_partkey>>", "moduleName": "Kit<<p_size>>", "usr": "u<<p_partkey>>", "children": ['
               '{"kind": "Var", "name": "v<<p_size>>", "printedName": "v"}, {"kind": "Function", "declKind": "Func", "name": "f<<p_partkey>>", "printedName": "f(a<<p_size>>:_:)"}, '
               '{"kind": "TypeNominal", "name": "skipped"}, {"kind": "TypeDecl", "declKind": "Enum", "name": "N<<p_partkey>>", "children": [{"kind": "EnumElement", "name": "e<<p_size>>"}]}]}]}}')


def _dumps(spark, sf):
    return table(spark, sf, "part").select(F.expr(_DUMP).alias("value"))


@query("sdk_catalog", """
    SELECT unnest([{'type_name': 'T' || CAST(p_partkey AS STRING), 'kind': 'Class', 'module': 'Kit' || CAST(p_size AS STRING), 'member': 'v' || CAST(p_size AS STRING), 'member_kind': 'Var'},
      {'type_name': 'T' || CAST(p_partkey AS STRING), 'kind': 'Class', 'module': 'Kit' || CAST(p_size AS STRING), 'member': 'f' || CAST(p_partkey AS STRING), 'member_kind': 'Func'},
      {'type_name': 'T' || CAST(p_partkey AS STRING), 'kind': 'Class', 'module': 'Kit' || CAST(p_size AS STRING), 'member': 'N' || CAST(p_partkey AS STRING), 'member_kind': 'Enum'},
      {'type_name': 'N' || CAST(p_partkey AS STRING), 'kind': 'Enum', 'module': NULL, 'member': 'e' || CAST(p_size AS STRING), 'member_kind': 'EnumElement'}], recursive := true) FROM part""")
def sdk_catalog(spark, sf):
    return cat.parse_sdk(_dumps(spark, sf)).select("type_name", "kind", "module", "member", "member_kind")


@query("sdk_names", """
    SELECT DISTINCT unnest(['T' || CAST(p_partkey AS STRING), 'N' || CAST(p_partkey AS STRING), 'v' || CAST(p_size AS STRING), 'f' || CAST(p_partkey AS STRING), 'e' || CAST(p_size AS STRING), 'a' || CAST(p_size AS STRING)]) AS name FROM part""")
def sdk_names(spark, sf):
    return cat.sdk_names(cat.parse_sdk(_dumps(spark, sf)))


@query("reexported_modules", """
    SELECT DISTINCT 'Dep' || CAST(p_partkey % 30 AS STRING) AS module FROM part EXCEPT SELECT 'Dep' || CAST(n_nationkey AS STRING) FROM nation""")
def reexported_modules(spark, sf):
    imported = table(spark, sf, "nation").select(F.concat(F.lit("Dep"), F.col("n_nationkey").cast("string")).alias("module"))
    return cat.reexports(_dumps(spark, sf), imported)


@query("graph_roots", f"WITH {EDGES_SQL} SELECT DISTINCT parent AS node FROM edges WHERE parent NOT IN (SELECT child FROM edges)")
def graph_roots(spark, sf):
    return g.roots(key_edges(spark, sf))


@query("descendant_closure", f"""
    WITH RECURSIVE {EDGES_SQL}, t AS (
      SELECT DISTINCT parent AS root, parent AS node, 0 AS depth, [parent] AS path FROM edges WHERE parent NOT IN (SELECT child FROM edges)
      UNION ALL SELECT root, child, depth + 1, list_append(path, child) FROM t JOIN edges ON node = parent WHERE NOT list_contains(path, child))
    SELECT root, node, depth, array_to_string(path, '/') AS path FROM t""")
def descendant_closure(spark, sf):
    edges = key_edges(spark, sf)
    return g.closure(edges, g.roots(edges)).select("root", "node", "depth", F.array_join("path", "/").alias("path"))


@query("cyclic_closure", """
    WITH RECURSIVE e AS (SELECT DISTINCT n_nationkey AS a, (n_nationkey * 2 + 1) % 25 AS b FROM nation),
    t AS (SELECT a AS root, a AS node, 0 AS depth, [a] AS path FROM e UNION ALL SELECT root, b, depth + 1, list_append(path, b) FROM t JOIN e ON node = a WHERE NOT list_contains(path, b))
    SELECT root, node, depth FROM t""")
def cyclic_closure(spark, sf):
    n = F.col("n_nationkey")
    e = table(spark, sf, "nation").select(n.alias("parent"), ((n * 2 + 1) % 25).alias("child"))
    return g.closure(e, e.select(F.col("parent").alias("node"))).select("root", "node", "depth")


# Twelve diamonds in a row per 37 parts: a top, two sides, the next top. 16,381 paths start at the first top, to 37 nodes.
_LATTICE = """lattice AS (SELECT p_partkey AS a, unnest(CASE p_partkey % 37 % 3 WHEN 0 THEN [p_partkey + 1, p_partkey + 2] WHEN 1 THEN [p_partkey + 2] ELSE [p_partkey + 1] END) AS b FROM part WHERE p_partkey % 37 < 36)"""


@query("reachable_nodes", f"""
    WITH RECURSIVE {_LATTICE}, t AS (SELECT p_partkey AS root, p_partkey AS node, 0 AS depth FROM part UNION SELECT root, b, depth + 1 FROM t JOIN lattice ON node = a),
    least AS (SELECT root, node, min(depth) AS depth FROM t GROUP BY root, node)
    SELECT l.root, l.node, l.depth, min(p.node) AS via FROM least l LEFT JOIN lattice e ON e.b = l.node LEFT JOIN least p ON p.root = l.root AND p.node = e.a AND p.depth = l.depth - 1
    GROUP BY l.root, l.node, l.depth""")
def reachable_nodes(spark, sf):
    """Every part of a lattice of diamonds with what lies below it, once."""
    key, at = F.col("p_partkey"), F.col("p_partkey") % 37
    part = table(spark, sf, "part")
    below = F.when(at % 3 == 0, F.array(key + 1, key + 2)).when(at % 3 == 1, F.array(key + 2)).otherwise(F.array(key + 1))
    edges = part.where(at < 36).select(key.alias("parent"), F.explode(below).alias("child"))
    return g.reachable(edges, part.select(key.alias("node")))


_GROUPS = """groups AS (SELECT 'R' || CAST(r_regionkey AS STRING) AS id, CAST(NULL AS STRING) AS parent_id, r_name AS name FROM region
    UNION ALL SELECT 'N' || CAST(n_nationkey AS STRING), 'R' || CAST(n_regionkey AS STRING), n_name FROM nation
    UNION ALL SELECT 'C' || CAST(c_custkey AS STRING), 'N' || CAST(c_nationkey AS STRING), c_name FROM customer)"""


@query("ancestor_paths", f"""
    WITH RECURSIVE {_GROUPS}, t AS (SELECT id, parent_id AS up, name AS path, 0 AS depth FROM groups UNION ALL SELECT t.id, g.parent_id, g.name || '/' || t.path, depth + 1 FROM t JOIN groups g ON t.up = g.id)
    SELECT id, path, depth FROM t WHERE up IS NULL""")
def ancestor_paths(spark, sf):
    def rows(name, key, parent, label):
        up = F.lit(None).cast("string") if parent is None else F.concat(F.lit(parent[0]), F.col(parent[1]).cast("string"))
        return table(spark, sf, name).select(F.concat(F.lit(key[0]), F.col(key[1]).cast("string")).alias("id"), up.alias("parent_id"), F.col(label).alias("name"))

    groups = (rows("region", ("R", "r_regionkey"), None, "r_name").unionByName(rows("nation", ("N", "n_nationkey"), ("R", "n_regionkey"), "n_name"))
              .unionByName(rows("customer", ("C", "c_custkey"), ("N", "c_nationkey"), "c_name")))
    return g.ancestor_path(groups).select("id", F.array_join("path", "/").alias("path"), "depth")


_NESTED = render('[{"node": {"A_name": "T<<p_partkey>>", "B_kind": "class", "isException": <<p_size % 2>>, "G_members": [{"A_name": "m<<p_size>>", "B_kind": "function", "isException": 1, "G_members": '
                 '[{"A_name": "inner", "B_kind": "variable"}]}, {"A_name": "n", "B_kind": "case", "isException": 0}]}, "extension": [{"A_name": "T<<p_partkey>>", "B_kind": "extension"}], "children": []}]')


@query("flattened_members", """
    SELECT p_partkey AS doc_id, unnest([{'path': 'T' || k, 'kind': 'class', 'depth': 0, 'is_exception': p_size % 2, 'has_flag': true},
      {'path': 'T' || k || '.m' || s, 'kind': 'function', 'depth': 1, 'is_exception': 1, 'has_flag': true}, {'path': 'T' || k || '.m' || s || '.inner', 'kind': 'variable', 'depth': 2, 'is_exception': 0, 'has_flag': false},
      {'path': 'T' || k || '.n', 'kind': 'case', 'depth': 1, 'is_exception': 0, 'has_flag': true}, {'path': 'T' || k || '.T' || k, 'kind': 'extension', 'depth': 1, 'is_exception': 0, 'has_flag': false}], recursive := true)
    FROM (SELECT *, CAST(p_partkey AS STRING) AS k, CAST(p_size AS STRING) AS s FROM part)""")
def flattened_members(spark, sf):
    docs = table(spark, sf, "part").select(F.col("p_partkey").alias("doc_id"), F.expr(_NESTED).alias("value"))
    return g.flatten(docs).select("doc_id", "path", "kind", "depth", "is_exception", "has_flag")


@query("rerooted_tree", f"""
    WITH RECURSIVE {EDGES_SQL}, t AS (SELECT DISTINCT parent AS root, parent AS node, 0 AS depth FROM edges WHERE parent NOT IN (SELECT child FROM edges)
      UNION ALL SELECT root, child, depth + 1 FROM t JOIN edges ON node = parent)
    SELECT node, min(d) AS depth FROM (SELECT node, depth - CASE WHEN root IN ('R0', 'R1') THEN 0 ELSE 1 END AS d FROM t) WHERE d >= 0 GROUP BY node""")
def rerooted_tree(spark, sf):
    """Only two of the regions are declared; the nations of the others become roots."""
    edges = key_edges(spark, sf)
    tree = g.reachable(edges, g.roots(edges)).select("root", "node", "depth")
    declared = table(spark, sf, "region").where("r_regionkey < 2").select(F.concat(F.lit("R"), F.col("r_regionkey").cast("string")).alias("name"))
    return g.reroot(tree, declared)

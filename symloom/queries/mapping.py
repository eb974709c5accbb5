"""Queries over replacement names, similarity, manifests and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from symloom.functions import names as nm, similarity as sim
from symloom.operators import lexical as lex, manifest as mf, mapping as mp, tokens as tok
from symloom.queries.derived import IDENT, ident_names, swift_files, table
from symloom.queries.registry import query
from symloom.session import new_folder
from symloom.sources import sinks

_WORD = r"[\p{L}_][\p{L}\p{N}_]*"


@query("name_pool", rf"""
    WITH used AS (SELECT DISTINCT unnest(regexp_extract_all(text, '{_WORD}')) AS name FROM benchmark), w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '{_WORD}')) AS name FROM documents)
    SELECT name, CASE WHEN regexp_matches(name, '^\p{{Lu}}') THEN 'upper' ELSE 'lower' END AS initial FROM w WHERE length(name) >= 5 AND NOT contains(name, '_') AND name NOT IN (SELECT name FROM used)""")
def name_pool(spark, sf):
    names = table(spark, sf, "documents").select(F.explode(F.array_distinct(tok.words("text"))).alias("name"))
    used = table(spark, sf, "benchmark").select(F.explode(tok.words("text")).alias("target"))
    return mp.name_pool(names, used.withColumn("replacement", F.col("target")))


def _jw(pairs: str) -> str:
    """CTEs up to ``jw(id, a, b, score)``: the similarity spelled out letter by letter."""
    return f"""pairs AS ({pairs}), steps AS (SELECT id, a, b, greatest(length(a), length(b)) // 2 - 1 AS r, 1 AS i, CAST([] AS BIGINT[]) AS la, CAST([] AS BIGINT[]) AS lb FROM pairs
      UNION ALL SELECT id, a, b, r, i + 1, CASE WHEN j IS NULL THEN la ELSE list_append(la, i) END, CASE WHEN j IS NULL THEN lb ELSE list_append(lb, j) END
      FROM (SELECT *, list_filter(range(greatest(1, i - r), least(i + r, length(b)) + 1), lambda j: substr(b, j, 1) = substr(a, i, 1) AND NOT list_contains(lb, j))[1] AS j FROM steps WHERE i <= length(a))),
    counted AS (SELECT id, a, b, len(la) AS m, len(list_filter(range(1, len(la) + 1), lambda k: substr(a, la[k], 1) <> substr(b, list_sort(lb)[k], 1))) / 2.0 AS t,
      CASE WHEN substr(a, 1, 1) <> substr(b, 1, 1) OR a = '' OR b = '' THEN 0 WHEN substr(a, 2, 1) <> substr(b, 2, 1) OR least(length(a), length(b)) < 2 THEN 1
        WHEN substr(a, 3, 1) <> substr(b, 3, 1) OR least(length(a), length(b)) < 3 THEN 2 WHEN substr(a, 4, 1) <> substr(b, 4, 1) OR least(length(a), length(b)) < 4 THEN 3 ELSE 4 END AS p FROM steps WHERE i = length(a) + 1),
    jaro AS (SELECT id, a, b, p, CASE WHEN m = 0 THEN 0.0 ELSE (m / length(a) + m / length(b) + (m - t) / m) / 3.0 END AS x FROM counted),
    jw AS (SELECT id, a, b, CASE WHEN a = b THEN 1.0 WHEN x = 0 THEN 0.0 ELSE x + p * 0.1 * (1 - x) END AS score FROM jaro)"""


_PAIR = "SELECT l_orderkey * 10 + l_linenumber AS id, p1.p_name || ' ' || p1.p_type AS a, p2.p_type || p2.p_name AS b FROM lineitem JOIN part p1 ON l_partkey = p1.p_partkey JOIN part p2 ON l_suppkey = p2.p_partkey"


def _pairs(spark, sf):
    part = table(spark, sf, "part")
    one = part.select(F.col("p_partkey").alias("l_partkey"), F.concat_ws(" ", "p_name", "p_type").alias("a"))
    two = part.select(F.col("p_partkey").alias("l_suppkey"), F.concat("p_type", "p_name").alias("b"))
    li = table(spark, sf, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), "l_partkey", "l_suppkey")
    return li.join(one, "l_partkey").join(two, "l_suppkey").select("a", "b").distinct()


@query("jaro_winkler_scores", f"WITH RECURSIVE {_jw(f'SELECT row_number() OVER () AS id, a, b FROM (SELECT DISTINCT a, b FROM ({_PAIR}))')} SELECT a, b, round(score, 9) AS score FROM jw")
def jaro_winkler_scores(spark, sf):
    return _pairs(spark, sf).select("a", "b", F.round(sim.jaro_winkler("a", "b"), 9).alias("score"))


@query("token_jaccard_scores", """
    WITH n AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS x, split_part(p_name, ' ', 2) AS y FROM part), p AS (SELECT l.x AS x1, l.y AS y1, r.x AS x2, r.y AS y2 FROM n l JOIN n r ON l.x = r.x OR l.y = r.y)
    SELECT x1 || '_' || y1 AS a, x2 || '-' || y2 AS b, round(len(list_intersect([x1, y1], [x2, y2])) * 1.0 / len(list_distinct([x1, y1, x2, y2])), 9) AS score FROM p""")
def token_jaccard_scores(spark, sf):
    n = table(spark, sf, "part").select(F.split("p_name", " ").alias("w")).distinct().select(F.col("w")[0].alias("x"), F.col("w")[1].alias("y"))
    left = n.select(F.col("x").alias("x1"), F.col("y").alias("y1"))
    right = n.select(F.col("x").alias("x2"), F.col("y").alias("y2"))
    same_x = left.join(right, F.col("x1") == F.col("x2"))
    same_y = left.join(right, (F.col("y1") == F.col("y2")) & (F.col("x1") != F.col("x2")))
    a, b = F.concat_ws("_", "x1", "y1"), F.concat_ws("-", "x2", "y2")
    return same_x.unionByName(same_y).select(a.alias("a"), b.alias("b"), F.round(sim.token_jaccard(a, b), 9).alias("score"))


_DIST_PAIR = "SELECT DISTINCT replace(p_name, ' ', '') AS t, split_part(p_name, ' ', 1) AS t1, split_part(p_name, ' ', 2) AS t2, lower(p_type) AS r FROM part"


_JAC = "(1 - len(list_intersect([t1, t2], [r])) * 1.0 / len(list_distinct([t1, t2, r])))"


def _gap(a, b):
    return f"least(abs(length({a}) - length({b})), 8) / 8.0"


@query("cluster_distances", f"""
    WITH RECURSIVE d AS ({_DIST_PAIR}), {_jw('SELECT row_number() OVER () AS id, t AS a, r AS b FROM d')}
    SELECT t AS target, r AS rep, round(0.5 * (1 - score) + 0.25 * {_JAC} + 0.15 * {_gap('t', 'r')} + 0.05 * CAST(substr(t, 1, 3) = substr(r, 1, 3) AS INT) + 0.05 * CAST(substr(t, -2) = substr(r, -2) AS INT), 9) AS distance
    FROM d JOIN jw ON jw.a = t AND jw.b = r""")
def cluster_distances(spark, sf):
    rows = table(spark, sf, "part").select(F.replace("p_name", F.lit(" "), F.lit("_")).alias("target"), F.lower("p_type").alias("rep")).distinct()
    rows = rows.withColumn("norm", nm.normalize("target")).withColumn("jw", sim.jaro_winkler("norm", "rep"))
    return rows.select(F.col("norm").alias("target"), "rep", F.round(sim.cluster_distance("norm", nm.token_set("target"), "rep", F.array("rep"), "jw"), 9).alias("distance"))


@query("name_distances", f"""
    WITH RECURSIVE d AS ({_DIST_PAIR}), {_jw('SELECT row_number() OVER () AS id, r AS a, t AS b FROM d')}
    SELECT t AS target, r AS name, round(0.55 * (1 - score) + 0.2 * {_gap('t', 'r')} + 0.05 * CAST(substr(t, 1, 3) = substr(r, 1, 3) AS INT) + 0.2 * {_JAC}, 9) AS distance FROM d JOIN jw ON jw.b = t AND jw.a = r""")
def name_distances(spark, sf):
    rows = table(spark, sf, "part").select(F.replace("p_name", F.lit(" "), F.lit("_")).alias("target"), F.lower("p_type").alias("name")).distinct()
    return rows.select(nm.normalize("target").alias("target"), "name", F.round(sim.name_distance("target", "name"), 9).alias("distance"))


# Targets from words of the benchmark texts, clusters from part names and market segments.
_CLUSTERS = """clusters AS (SELECT 'variable' AS kind, row_number() OVER (ORDER BY rep) - 1 AS cluster_id, rep FROM (SELECT DISTINCT p_name AS rep FROM part UNION SELECT DISTINCT lower(c_mktsegment) FROM customer UNION SELECT DISTINCT lower(p_type) FROM part))"""


def _clusters(spark, sf):
    part, customer = table(spark, sf, "part"), table(spark, sf, "customer")
    reps = (part.select(F.col("p_name").alias("rep")).union(customer.select(F.lower("c_mktsegment"))).union(part.select(F.lower("p_type")))).distinct()
    from symloom.functions.scan import dense_index
    return dense_index(reps, [F.col("rep")], "cluster_id").select(F.lit("variable").alias("kind"), F.col("cluster_id").cast("int").alias("cluster_id"), "rep", F.split("rep", " ").alias("tokens"))


@query("far_clusters", rf"""
    WITH RECURSIVE targets AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[A-Za-z]+'))) AS target FROM benchmark), {_CLUSTERS},
    near AS (SELECT target, cluster_id, rep FROM targets, clusters WHERE abs(length(target) - length(rep)) >= 2 AND substr(target, 1, 3) <> substr(rep, 1, 3) AND NOT list_contains(string_split(rep, ' '), target)),
    {_jw('SELECT row_number() OVER () AS id, target AS a, rep AS b FROM near')},
    far AS (SELECT target, cluster_id, 0.5 * (1 - score) + 0.25 + 0.15 * {_gap('target', 'rep')} + 0.05 * CAST(substr(target, -2) = substr(rep, -2) AS INT) AS distance FROM near JOIN jw ON jw.a = target AND jw.b = rep WHERE score <= 0.2)
    SELECT target, cluster_id, round(distance, 9) AS distance, rn FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY round(distance, 12) DESC, cluster_id) AS rn FROM far) WHERE rn <= 5""")
def far_clusters(spark, sf):
    words = table(spark, sf, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("w"))
    targets = words.select(F.lit("variable").alias("kind"), F.lower("w").alias("target")).distinct()
    return mp.far_clusters(targets, _clusters(spark, sf), 5).select("target", "cluster_id", F.round("distance", 9).alias("distance"), "rn")


_TARGETS = """targets AS (SELECT CASE c_custkey % 3 WHEN 0 THEN 'class' WHEN 1 THEN 'variable' ELSE 'property' END AS kind,
    CASE c_custkey % 2 WHEN 0 THEN lower(c_mktsegment) ELSE upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) END || CAST(c_custkey AS STRING) AS target, c_custkey % 2 AS pascal FROM customer)"""


def _mapping_inputs(spark, sf):
    key = F.col("c_custkey")
    kind = F.when(key % 3 == 0, "class").when(key % 3 == 1, "variable").otherwise("property")
    name = F.when(key % 2 == 0, F.lower("c_mktsegment")).otherwise(F.concat(F.upper(F.substring("c_mktsegment", 1, 1)), F.lower(F.expr("substr(c_mktsegment, 2)"))))
    targets = table(spark, sf, "customer").select(kind.alias("kind"), F.concat(name, key.cast("string")).alias("target"))
    idents = table(spark, sf, "part").select("p_name", "p_size", F.concat(F.expr(IDENT), F.col("p_partkey").cast("string")).alias("name"), "p_partkey")
    pool_kind = F.when(F.col("p_size") % 2 == 0, "class").otherwise("variable")
    pool = idents.select(pool_kind.alias("kind"), "name")
    base = _clusters(spark, sf)
    clusters = base.unionByName(base.withColumn("kind", F.lit("class")))
    members = idents.select(pool_kind.alias("kind"), F.col("p_name").alias("rep"), "name").join(base.select("rep", "cluster_id"), "rep").select("kind", "cluster_id", "name")
    forbidden = idents.where("p_partkey % 17 = 0").select("name")
    return targets, clusters, members, pool, forbidden


@query("replacement_mapping")
def replacement_mapping(spark, sf):
    return mp.create_mapping(*_mapping_inputs(spark, sf))


@query("replacement_mapping_checks", f"""
    WITH {_TARGETS}, pool AS (SELECT CASE WHEN p_size % 2 = 0 THEN 'class' ELSE 'variable' END AS pool, p_partkey % 4 AS style, count(*) AS supply FROM part WHERE p_partkey % 17 <> 0 AND p_partkey % 4 < 2 GROUP BY ALL),
    want AS (SELECT CASE kind WHEN 'class' THEN 'class' ELSE 'variable' END AS pool, pascal AS style, count(*) AS demand FROM targets GROUP BY ALL)
    SELECT CAST(sum(least(coalesce(supply, 0), demand)) AS BIGINT) AS n_mapped, 0 AS reused, 0 AS wrong_case, 0 AS same_prefix, 0 AS forbidden FROM want LEFT JOIN pool USING (pool, style)""")
def replacement_mapping_checks(spark, sf):
    targets, clusters, members, pool, forbidden = _mapping_inputs(spark, sf)
    m = mp.create_mapping(targets, clusters, members, pool, forbidden)
    banned = targets.select(F.col("target").alias("replacement")).union(forbidden).distinct().withColumn("bad", F.lit(1))
    counted = m.groupBy("replacement").agg(F.count("*").alias("uses"), F.min("target").alias("target")).join(banned, "replacement", "left")
    one = lambda c: F.coalesce(F.sum(c.cast("int")), F.lit(0)).cast("int")
    return counted.agg(F.count("*").alias("n_mapped"), one(F.col("uses") > 1).alias("reused"), one(nm.casing("target") != nm.casing("replacement")).alias("wrong_case"),
                       one(F.substring("target", 1, 3) == F.substring("replacement", 1, 3)).alias("same_prefix"), one(F.col("bad").isNotNull()).alias("forbidden"))


@query("allocated_names", """
    WITH free AS (SELECT p_name || CAST(p_size AS STRING) AS name, row_number() OVER (ORDER BY p_name || CAST(p_size AS STRING)) - 1 AS i FROM (SELECT DISTINCT p_name, p_size FROM part WHERE p_size % 5 <> 0)),
    f AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) - 1 AS f FROM supplier)
    SELECT s_suppkey, CAST(slot AS INT) AS slot, name, name IS NULL AS exhausted FROM (SELECT s_suppkey, slot, f * 2 + slot AS i FROM f, range(0, 2) r(slot)) LEFT JOIN free USING (i)""")
def allocated_names(spark, sf):
    part = table(spark, sf, "part").select("p_size", F.concat("p_name", F.col("p_size").cast("string")).alias("name"))
    return mp.allocate_names(part, part.where("p_size % 5 = 0"), table(spark, sf, "supplier"), "s_suppkey", per_file=2)


@query("closest_symbols", """
    WITH p AS (SELECT p_partkey, CAST(p_partkey AS STRING) AS k FROM part)
    SELECT p_partkey AS file_id, unnest([{'ident': 'commentd' || k, 'symbol': 'commented' || k || '()', 'tier': 3},
      {'ident': 'load' || k || '(x:)', 'symbol': 'load' || k || '(with id: Int, _ flag: [String: Int])', 'tier': 2}], recursive := true) FROM p
    UNION ALL SELECT p_partkey, 'titel' || k, 'title' || k, 3 FROM p WHERE length(k) > 1""")
def closest_symbols(spark, sf):
    """Misspelt names against the symbols of their file; two swapped letters are too many for the shortest names."""
    files = swift_files(spark, sf)
    syms = lex.symbols(files, "swift", keep=["file_id"])
    k = F.col("p_partkey").cast("string")
    idents = table(spark, sf, "part").select(F.col("p_partkey").alias("file_id"), F.explode(F.array(
        F.concat(F.lit("titel"), k), F.concat(F.lit("commentd"), k), F.concat(F.lit("load"), k, F.lit("(x:)")), F.concat(F.lit("zzz"), k))).alias("ident"))
    return mp.closest_symbol(idents, syms, ["file_id"])


@query("resolved_targets", """
    SELECT r_name AS target, 'src/' || CAST(o_orderkey AS STRING) || '.swift' AS path FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey WHERE o_orderkey % 2 = 0""")
def resolved_targets(spark, sf):
    targets = table(spark, sf, "region").join(table(spark, sf, "nation"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("target"), F.col("n_nationkey").alias("phase_id"))
    phases = table(spark, sf, "customer").select(F.col("c_nationkey").alias("phase_id"), F.col("c_custkey").alias("build_id"))
    orders = table(spark, sf, "orders")
    builds = orders.select(F.col("o_custkey").alias("build_id"), F.col("o_orderkey").alias("file_ref"))
    suffix = F.when(F.col("o_orderkey") % 2 == 0, ".swift").otherwise(".m")
    refs = orders.select(F.col("o_orderkey").alias("file_ref"), F.concat(F.lit("src/"), F.col("o_orderkey").cast("string"), suffix).alias("path"))
    return mf.resolve_targets(targets, phases, builds, refs)


@query("chosen_targets", """
    WITH c AS (SELECT c_nationkey AS key, c_mktsegment || CASE WHEN c_custkey % 4 = 0 THEN '' ELSE CAST(c_custkey % 4 AS STRING) END AS name FROM customer),
    w AS (SELECT n_nationkey AS key, CASE n_nationkey % 4 WHEN 0 THEN 'MACHINERY' WHEN 1 THEN 'machinery1' WHEN 2 THEN 'ture2' ELSE 'build' END AS want FROM nation),
    t AS (SELECT DISTINCT key, want, name, CASE WHEN name = want THEN 1 WHEN lower(name) = lower(want) THEN 2 WHEN contains(lower(name), lower(want)) THEN 3 END AS tier FROM c JOIN w USING (key)),
    g AS (SELECT key, want, tier, min(name) AS name, count(DISTINCT name) AS n FROM t WHERE tier IS NOT NULL GROUP BY ALL)
    SELECT key, want, arg_min(name, tier) AS name, min(tier) AS tier FROM g WHERE tier < 3 OR n = 1 GROUP BY key, want""")
def chosen_targets(spark, sf):
    tail = F.when(F.col("c_custkey") % 4 == 0, "").otherwise((F.col("c_custkey") % 4).cast("string"))
    cands = table(spark, sf, "customer").select(F.col("c_nationkey").alias("key"), F.concat("c_mktsegment", tail).alias("name"))
    n = F.col("n_nationkey")
    want = F.when(n % 4 == 0, "MACHINERY").when(n % 4 == 1, "machinery1").when(n % 4 == 2, "ture2").otherwise("build")
    return mf.choose_per_group(cands, table(spark, sf, "nation").select(n.alias("key"), want.alias("want")), "key")


@query("written_splits", "SELECT CASE WHEN p_size % 3 = 0 THEN 'safe' ELSE 'risky' END AS split, count(*) AS n FROM part GROUP BY 1")
def written_splits(spark, sf):
    path = new_folder(spark, "splits")
    sinks.write_splits(table(spark, sf, "part"), path, F.when(F.col("p_size") % 3 == 0, "safe").otherwise("risky"), spread=4)
    return spark.read.parquet(path).groupBy(F.col("split").cast("string").alias("split")).agg(F.count("*").alias("n"))


@query("logged_decisions", "SELECT 'pending' AS status, 'exclude' AS kind, count(*) AS n FROM part WHERE p_size % 2 = 0 UNION ALL SELECT 'approved', 'include', count(*) FROM part WHERE p_size % 2 = 1")
def logged_decisions(spark, sf):
    path = new_folder(spark, "decisions")
    part = table(spark, sf, "part").select(F.col("p_name").alias("name"), "p_size")
    sinks.log_decisions(part.where("p_size % 2 = 0").withColumn("status", F.lit("pending")), path, "exclude", "policy")
    sinks.log_decisions(part.where("p_size % 2 = 1").withColumn("status", F.lit("approved")), path, "include", "policy")
    rows = spark.read.schema("name string, status string, basis string, decided_at timestamp, kind string").json(path)
    return rows.groupBy("status", "kind").agg(F.count("*").alias("n"))


@query("written_payloads", "SELECT p_brand AS identifier, count(*) AS n FROM part GROUP BY p_brand")
def written_payloads(spark, sf):
    path = new_folder(spark, "payloads")
    sinks.write_payloads(table(spark, sf, "part").select(F.col("p_brand").alias("identifier"), F.col("p_name").alias("payload")), path)
    return spark.read.schema("payload string, identifier string").json(path).groupBy("identifier").agg(F.count("*").alias("n"))


@query("ident_sample", f"SELECT DISTINCT name FROM (SELECT {IDENT} AS name FROM part) ORDER BY name LIMIT 10")
def ident_sample(spark, sf):
    from symloom.sources.lists import sample_sorted

    return sample_sorted(ident_names(spark, sf), "name", 10)

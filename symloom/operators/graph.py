"""Symbol graph: aliases, edges, roots, closures, ancestor paths, flattening."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from symloom.functions.names import leaf
from symloom.session import cut_lineage, salted_join, scope, shuffled

TYPE_KINDS = ["class", "struct", "enum", "protocol", "actor"]


def expand_aliases(nodes: DataFrame, aliases: DataFrame, key: str = "node_id") -> DataFrame:
    """Replace adopted aliases by their protocols, one level, keeping order.

    Of aliases declared twice the first by the other columns of ``aliases`` counts.
    """
    order = F.struct(*[F.col(c) for c in aliases.columns if c not in ("alias", "protocols")], "protocols")
    own = scope(nodes, aliases)
    table = (aliases.where(F.size("protocols") > 0).groupBy(*own, F.col("alias").alias("_a"))
             .agg(F.min_by("protocols", order).alias("_p")))
    parts = nodes.select(key, *own, F.posexplode("adopted").alias("pos", "_a"))
    whole = (salted_join(parts, table, [*own, "_a"], F.struct(key, "pos"), "left", salts=1)
             .groupBy(key).agg(F.array_sort(F.collect_list(
                 F.struct("pos", F.coalesce("_p", F.array("_a")).alias("p")))).alias("_x"))
             .select(key, F.flatten(F.transform("_x", lambda x: x["p"])).alias("_adopted")))
    return (nodes.join(shuffled(whole), key, "left")
            .withColumn("adopted", F.coalesce("_adopted", "adopted")).drop("_adopted"))


def edges(nodes: DataFrame) -> DataFrame:
    """([project,] parent, child_id, child, rel): adopted types and extended types."""
    own = scope(nodes)
    adopts = (nodes.where("kind <> 'extension'")
              .select(*own, F.explode("adopted").alias("parent"), F.col("node_id").alias("child_id"),
                      F.col("name").alias("child"), F.lit("adopts").alias("rel")))
    extends = (nodes.where("kind = 'extension'")
               .select(*own, leaf("name").alias("parent"), F.col("node_id").alias("child_id"),
                       F.col("name").alias("child"), F.lit("extends").alias("rel")))
    return adopts.unionByName(extends)


def declared_types(nodes: DataFrame) -> DataFrame:
    """([project,] name, node_id): the first declaration of every type name."""
    return nodes.where(F.col("kind").isin(TYPE_KINDS)).groupBy(*scope(nodes), "name").agg(F.min("node_id").alias("node_id"))


def link_parents(edge_rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Add ``parent_id``, null where the parent is not declared in the project."""
    own = scope(edge_rows, nodes)
    table = declared_types(nodes).select(*own, F.col("name").alias("parent"), F.col("node_id").alias("parent_id"))
    return salted_join(edge_rows, table, [*own, "parent"], F.col("child_id"), "left", salts=1)


def no_inheritance(nodes: DataFrame, edge_rows: DataFrame) -> DataFrame:
    """Types that adopt nothing and are nobody's parent."""
    alone = nodes.where(F.col("kind").isin(TYPE_KINDS) & (F.size("adopted") == 0))
    own = scope(nodes, edge_rows)
    parents = edge_rows.select(*own, F.col("parent").alias("name")).distinct()
    return salted_join(alone, parents, [*own, "name"], F.col("node_id"), "left_anti").select(*nodes.columns)


def fold_extensions(nodes: DataFrame) -> DataFrame:
    """Add what extensions adopt to the extended type."""
    own = scope(nodes)
    extra = (nodes.where("kind = 'extension'").select(*own, leaf("name").alias("name"), F.explode("adopted").alias("a"))
             .groupBy(*own, "name").agg(F.sort_array(F.collect_set("a")).alias("_extra")))
    base = nodes.where(F.col("kind").isin(TYPE_KINDS))
    rest = nodes.where(~F.col("kind").isin(TYPE_KINDS))
    folded = (salted_join(base, extra, [*own, "name"], F.col("node_id"), "left")
              .withColumn("adopted", F.when(F.col("_extra").isNull(), F.col("adopted"))
                          .otherwise(F.array_union("adopted", "_extra"))).select(*nodes.columns))
    return folded.unionByName(rest)


def external_candidates(nodes: DataFrame, edge_rows: DataFrame) -> DataFrame:
    """Nodes below an undeclared parent, and all extensions."""
    own = scope(nodes, edge_rows)
    known = declared_types(nodes).select(*own, F.col("name").alias("parent"))
    below = (salted_join(edge_rows, known, [*own, "parent"], F.col("child_id"), "left_anti")
             .select(F.col("child_id").alias("node_id")))
    return below.union(nodes.where("kind = 'extension'").select("node_id")).distinct()


def roots(edge_rows: DataFrame, parent: str = "parent", child: str = "child") -> DataFrame:
    """Parents that are no one's child."""
    flags = (edge_rows.select(F.col(parent).alias("node"), F.lit(False).alias("is_child"))
             .union(edge_rows.select(F.col(child).alias("node"), F.lit(True).alias("is_child"))))
    return flags.groupBy("node").agg(F.bool_or("is_child").alias("c")).where("not c").select("node")


def closure(edge_rows: DataFrame, starts: DataFrame, parent: str = "parent", child: str = "child") -> DataFrame:
    """(root, node, depth, path): everything below each start, cycles cut per path.

    Edges are written once, with a mark on those that lead on. Per level only
    paths that go on meet them, each path once: both sides are shuffled, and
    parts that a node with many children or paths makes large are split by
    the sizes measured. Every level is written to the checkpoint folder, so
    lineage stays short and a lost executor costs one level.
    """
    table = edge_rows.select(F.col(parent).alias("_from"), F.col(child).alias("_to")).distinct()
    inner = table.select(F.col("_from").alias("_inner")).distinct()
    table = cut_lineage(table.join(shuffled(inner), F.col("_to") == F.col("_inner"), "left")
                        .select("_from", "_to", F.col("_inner").isNotNull().alias("_more")))
    level = cut_lineage(starts.select(
        F.col("node").alias("root"), F.col("node").alias("node"), F.lit(0).alias("depth"), F.array("node").alias("path"), F.lit(True).alias("_more")))
    out = level
    while True:
        going = level.where("_more").withColumnRenamed("node", "_from").drop("_more")
        if going.isEmpty():
            return out.drop("_more")
        level = cut_lineage(
            table.join(shuffled(going), "_from").where(~F.array_contains("path", F.col("_to")))
            .select("root", F.col("_to").alias("node"), (F.col("depth") + 1).alias("depth"),
                    F.concat("path", F.array("_to")).alias("path"), "_more"))
        out = out.unionByName(level)


def reachable(edge_rows: DataFrame, starts: DataFrame, parent: str = "parent", child: str = "child") -> DataFrame:
    """(root, node, depth, via): what each start reaches, once, with its least depth and the smallest predecessor there.

    Each round joins only the pairs that are new, and drops those known from
    any earlier round, so there is one row per start and node however many
    paths lead there, and cycles end by themselves. ``closure`` lists paths.
    Edges are written once, so that rounds do not derive them again.
    """
    table = cut_lineage(edge_rows.select(F.col(parent).alias("_from"), F.col(child).alias("_to")).distinct())
    new = cut_lineage(starts.select("node").distinct().select(
        F.col("node").alias("root"), "node", F.lit(0).alias("depth"), F.col("node").alias("via")))
    known = new.withColumn("via", F.when(F.lit(False), F.col("via")))
    while True:
        step = (new.withColumnRenamed("node", "_from").join(table, "_from")
                .groupBy("root", F.col("_to").alias("node")).agg((F.min("depth") + 1).alias("depth"), F.min("_from").alias("via")))
        new = cut_lineage(step.join(known.select("root", "node"), ["root", "node"], "left_anti"))
        if new.isEmpty():
            return known
        known = known.unionByName(new)


def ancestor_path(groups: DataFrame, key: str = "id", parent: str = "parent_id", name: str = "name",
                  rounds: list | None = None) -> DataFrame:
    """(id, path, depth): names from the root down to each row, cycles cut; ``key`` is unique.

    Pointer doubling: per round each row takes over what the ancestor at the
    end of its climb has climbed so far, and goes on from that one's end, so a
    chain of n takes about log2(n) rounds. A climb that meets itself ends in
    front of what it has met. ``rounds``, if given, gets an entry per round.
    """
    rows = cut_lineage(groups.select(F.col(key).alias("id"), F.col(parent).alias("_up"),
                                     F.array(key).alias("_ids"), F.array(name).alias("_names")))
    while True:
        active = rows.where("_up is not null")
        if active.isEmpty():
            return rows.select("id", F.reverse("_names").alias("path"), (F.size("_names") - 1).alias("depth"))
        if rounds is not None:
            rounds.append(len(rounds) + 1)
        table = rows.select(F.col("id").alias("_up"), F.col("_up").alias("_next"), F.col("_ids").alias("_more"), F.col("_names").alias("_labels"))
        looped = F.arrays_overlap("_ids", "_more")
        first = F.array_min(F.transform(F.array_intersect("_more", "_ids"), lambda x: F.array_position("_more", x)))
        take = F.when(looped, first - 1).otherwise(F.size("_more")).cast("int")
        added = [F.when(F.col(more).isNull(), F.col(own)).otherwise(F.concat(own, F.slice(more, F.lit(1), take))).alias(own)
                 for own, more in (("_ids", "_more"), ("_names", "_labels"))]
        step = active.join(table, "_up", "left").select("id", F.when(F.coalesce(looped, F.lit(True)), None).otherwise(F.col("_next")).alias("_up"), *added)
        rows = cut_lineage(rows.where("_up is null").unionByName(step))


_NODE_TEXT = T.StructType([
    T.StructField(n, T.StringType()) for n in (
        "A_name", "B_kind", "C_accessLevel", "F_location", "H_initialValue", "J_returnType",
        "G_members", "children", "members", "extension", "node")]
    + [T.StructField(n, T.ArrayType(T.StringType())) for n in (
        "D_attributes", "E_adoptedClassProtocols", "I_parameters", "I_parameterType")]
    + [T.StructField("isException", T.IntegerType())])


def flatten(docs: DataFrame, column: str = "value", key: str = "doc_id") -> DataFrame:
    """Nested declaration JSON to rows with dotted path and depth.

    Each level is parsed with its members left as text; the loop ends at the
    first empty level. A wrapper's ``node`` is read in its place, and the
    wrapper's children and extensions count as that node's.
    """
    strings = T.ArrayType(T.StringType())

    def items(text):
        as_list = F.from_json(text, strings)
        return F.when(F.ltrim(text).startswith("["), as_list).when(text.isNotNull(), F.array(text))

    level = docs.select(F.col(key), F.lit("").alias("parent_path"), F.lit(0).alias("depth"),
                        F.posexplode(items(F.col(column))).alias("pos", "raw"))
    out = None
    while True:
        parsed = level.withColumn("w", F.from_json("raw", _NODE_TEXT))
        inner = F.from_json(F.col("w.node"), _NODE_TEXT)
        parsed = cut_lineage(parsed.withColumn("n", F.when(F.col("w.node").isNotNull(), inner).otherwise(F.col("w"))))
        if out is not None and parsed.isEmpty():
            return out
        name = F.trim(F.coalesce("n.A_name", F.lit("")))
        path = (F.when(F.col("parent_path") == "", name).when(name == "", F.col("parent_path"))
                .otherwise(F.concat_ws(".", "parent_path", name)))
        rows = parsed.select(
            key, "depth", name.alias("name"), F.col("n.B_kind").alias("kind"), path.alias("path"),
            F.coalesce("n.isException", F.lit(0)).alias("is_exception"), F.col("n.isException").isNotNull().alias("has_flag"),
            F.col("n.F_location").alias("location"), F.col("n.E_adoptedClassProtocols").alias("adopted"),
            F.col("n.D_attributes").alias("attributes")).where("name <> ''")
        out = rows if out is None else out.unionByName(rows)
        below = F.flatten(F.array(*[
            F.coalesce(items(F.col(c)), F.array().cast(strings)) for c in ("n.G_members", "n.children", "n.members", "n.extension")]
            + [F.when(F.col("w.node").isNotNull(), F.coalesce(items(F.col(c)), F.array().cast(strings)))
               .otherwise(F.array().cast(strings)) for c in ("w.children", "w.members", "w.extension", "w.G_members")]))
        level = parsed.select(key, path.alias("parent_path"), (F.col("depth") + 1).alias("depth"),
                              F.posexplode(below).alias("pos", "raw"))


def reroot(tree: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, depth) with undeclared roots dropped, their children promoted, each node once.

    ``tree`` is a closure (root, node, depth); a node below several roots keeps
    its smallest depth under a declared root.
    """
    declared = nodes.select(F.col("name").alias("root")).distinct().withColumn("_known", F.lit(True))
    rows = (salted_join(tree, declared, "root", F.col("node"), "left")
            .withColumn("depth", F.when(F.col("_known"), F.col("depth")).otherwise(F.col("depth") - 1))
            .where("depth >= 0"))
    return rows.groupBy("node").agg(F.min("depth").alias("depth"))

"""From source files to flagged symbol nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symloom.operators import catalog, flags, graph, lexical, rules
from symloom.session import cut_lineage, shuffled


def symbol_tree(nodes: DataFrame) -> DataFrame:
    """(root_id, node_id): every type and all that adopts or extends it, itself included."""
    linked = graph.link_parents(graph.edges(nodes), nodes).where("parent_id is not null")
    tree = graph.reachable(linked.select(F.col("parent_id").alias("parent"), F.col("child_id").alias("child")),
                           nodes.select(F.col("node_id").alias("node")))
    return tree.select(F.col("root").alias("root_id"), F.col("node").alias("node_id"))


def exception_reasons(nodes: DataFrame, ext_nodes: DataFrame, ext_members: DataFrame, sdk: DataFrame,
                      listed: DataFrame) -> DataFrame:
    """(node_id, reason) from external catalogs, the SDK and the naming rules."""
    types = nodes.where(F.col("kind").isin([*graph.TYPE_KINDS, "extension"]))
    members = nodes.where("parent_id is not null")
    tree = cut_lineage(symbol_tree(types))
    known = catalog.external_names(ext_nodes).union(ext_members.select("name")).union(catalog.sdk_names(sdk)).distinct()
    names = listed.select("name").union(rules.keyword_set(nodes)).distinct()
    return (catalog.match_external(types, members, tree, ext_nodes, ext_members)
            .unionByName(catalog.match_sdk(types, members, tree, sdk))
            .unionByName(rules.rule_exceptions(nodes, names, known)).distinct())


def classify(files: DataFrame, ext_nodes: DataFrame, ext_members: DataFrame, sdk: DataFrame, listed: DataFrame,
             scored: DataFrame | None = None) -> DataFrame:
    """Declaration nodes with ``is_exception`` and ``reasons``.

    Texts are scanned once for nodes and once for aliases; the node table and
    the reasons are written down, since every later step reads them.
    """
    declared = cut_lineage(lexical.declarations(files))
    nodes = cut_lineage(graph.fold_extensions(graph.expand_aliases(declared, lexical.aliases(files, keep=["project", "file_id"]))))
    found = exception_reasons(nodes, ext_nodes, ext_members, sdk, listed)
    reasons = cut_lineage(found.groupBy("node_id").agg(F.sort_array(F.collect_set("reason")).alias("reasons")))
    out = (nodes.join(shuffled(reasons), "node_id", "left").withColumn("is_exception", F.col("reasons").isNotNull().cast("int"))
           .withColumn("reasons", F.coalesce("reasons", F.array().cast("array<string>"))))
    return out if scored is None else flags.tag_names(out, scored)

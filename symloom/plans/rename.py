"""From flagged nodes to renamed texts."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symloom.operators import flags, mapping, rewrite
from symloom.session import cut_lineage, scope, shuffled


class Renamed(NamedTuple):
    files: DataFrame
    mapping: DataFrame
    audit: DataFrame


def rename(files: DataFrame, nodes: DataFrame, external: DataFrame, clusters: DataFrame, members: DataFrame, pool: DataFrame,
           seed: int = 42, key: str = "file_id") -> Renamed:
    """Map every renameable name to an unused one, audit the mapping, rewrite the texts."""
    # Names are read several times, and whoever hands them over may have classified them with many joins: that is done once.
    nodes = cut_lineage(nodes.select(*scope(nodes), "name", "kind", "is_exception"))
    every = cut_lineage(flags.all_names(nodes, external))
    names = flags.merge_kinds(flags.renameable(nodes))
    wanted = cut_lineage(names.where(F.col("kind") != "extension").select("kind", F.col("name").alias("target")))
    table = cut_lineage(mapping.create_mapping(wanted, clusters, members, pool, every, seed))
    audit = flags.audit_mapping(table, every)
    # A name may be mapped under several kinds; the texts know only names, so one of them is used everywhere.
    per_name = table.groupBy("target").agg(F.min("replacement").alias("replacement"))
    # Written, since names are taken from it and put back into it.
    clean = cut_lineage(rewrite.strip_comments_lexed(files))
    return Renamed(rewrite.pseudonymize(clean, per_name, key, profile="swift"), table, audit)


def wrappable(files: DataFrame, key: str = "file_id", select: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Function inventory with ``blocked_by``; ``select`` may add columns before.

    Three scans of the texts: the functions, the types by role, and what stands
    in blocks; each is written without the texts and read from there. What is
    looked up goes with the few columns that it needs and meets the functions
    by their row once; without ``select`` only the columns that the caller keeps move there.
    """
    from symloom.operators import rules, scopes

    whole = cut_lineage(scopes.function_inventory(files).withColumn("_row", F.monotonically_increasing_id()))
    looked_up = ("func_key", "parent_type", "parent_conforms", "parent_kind", "parent_has_actor_attr", "is_parent_extension")
    funcs = whole.select("_row", *dict.fromkeys([*scope(files), key, "name", "line_no", *looked_up]))
    lists, facts = cut_lineage(scopes.type_lists(files)), cut_lineage(rules.block_facts(files, key))
    asked = facts.where("role = 'requirement'").withColumnRenamed("owner", "protocol").withColumnRenamed("value", "func_key")
    funcs = scopes.protocol_impl(funcs, asked, [key, "name", "line_no"])
    funcs = scopes.resolve_parents(funcs, *(lists.where(F.col("role") == r) for r in ("actor", "global_actor", "local")))
    found = funcs.select("_row", *(c for c in funcs.columns if c not in whole.columns))
    funcs = whole.drop("parent_has_actor_attr").join(shuffled(found), "_row").drop("_row")
    types = facts.where("role = 'type'").select(key, "owner", F.col("value").alias("type"))
    return rules.eligible(select(cut_lineage(funcs)) if select else funcs, types, key, using=whole)


def functions_to_wrap(files: DataFrame, rule_table: DataFrame, key: str = "file_id") -> DataFrame:
    """Function inventory with ``excluded``, ``risk_reasons``, ``is_safe`` and ``blocked_by``."""
    from symloom.operators import rules

    return wrappable(files, key, lambda funcs: rules.risk_reasons(rules.partition_by_rules(funcs, rule_table, [key, "name", "line_no"])))

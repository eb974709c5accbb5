"""Exception flags on nodes: tagging, specs, updates, name collection, audits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symloom.functions.names import parse_spec, unquote_backticks
from symloom.session import salted_join, scope


def merge_exceptions(*sources: DataFrame, key: str = "location") -> DataFrame:
    """One row per location; of several the earlier source wins."""
    out = None
    for rank, df in enumerate(sources):
        part = df.withColumn("_rank", F.lit(rank))
        out = part if out is None else out.unionByName(part)
    others = [c for c in out.columns if c not in (key, "_rank")]
    return (out.groupBy(key).agg(F.min(F.struct("_rank", *others)).alias("r"))
            .select(key, *[F.col(f"r.{c}").alias(c) for c in others]))


def tag_exceptions(nodes: DataFrame, exceptions: DataFrame, key: str = "location") -> DataFrame:
    """Set ``is_exception`` from a list of locations."""
    hits = exceptions.select(key).distinct().withColumn("_hit", F.lit(1))
    return nodes.drop("is_exception").join(hits, key, "left").withColumn("is_exception", F.coalesce("_hit", F.lit(0))).drop("_hit")


def tag_names(nodes: DataFrame, scored: DataFrame) -> DataFrame:
    """Also flag nodes whose name is on a scored list."""
    hits = scored.select("name").distinct().withColumn("_hit", F.lit(1))
    out = salted_join(nodes, hits, "name", F.col("node_id"), "left")
    return out.withColumn("is_exception", F.coalesce("_hit", "is_exception")).drop("_hit").select(*nodes.columns)


def renameable(nodes: DataFrame) -> DataFrame:
    """([project,] kind, name) that may be renamed.

    A name is held back when it is flagged anywhere in the project with the same kind, or,
    for variables, cases and functions, with any of the three. One aggregate
    per name decides; nothing is joined.
    """
    own = scope(nodes)
    value_kind = F.col("kind").isin("variable", "case", "function")
    group = F.when(value_kind, "value").otherwise(F.col("kind"))
    rows = nodes.where("kind <> 'extension' or is_exception = 1").select(
        *own, "name", unquote_backticks("name").alias("bare"), "kind", group.alias("grp"), "is_exception")
    # The stripped form is used for the cross-kind test only.
    flagged = (rows.where("is_exception = 1").select(*own, F.col("name").alias("n"), "grp").distinct())
    kinds = rows.groupBy(*own, "name", "bare", "kind", "grp").agg(
        F.bool_or(F.col("is_exception") == 1).alias("same"), F.bool_or(F.col("is_exception") == 0).alias("free"))
    free = kinds.where("free and not same and kind <> 'extension'")
    values = flagged.where("grp = 'value'").select(*own, F.col("n").alias("bare"))
    return (free.where("grp <> 'value'").select(*own, "kind", "name")
            .unionByName(free.where("grp = 'value'").join(values, [*own, "bare"], "left_anti").select(*own, "kind", "name")))


def merge_kinds(names: DataFrame) -> DataFrame:
    """Cases count as variables, actors as classes."""
    kind = F.when(F.col("kind") == "case", "variable").when(F.col("kind") == "actor", "class").otherwise(F.col("kind"))
    return names.withColumn("kind", kind).distinct()


def all_names(nodes: DataFrame, external: DataFrame) -> DataFrame:
    return nodes.select("name").union(external.select("name")).where("name is not null").distinct()


def mapping_dump(names: DataFrame, mapping: DataFrame) -> DataFrame:
    """(category, original, replacement), only what is mapped. Rows, not one map per
    category: a category may hold any number of names."""
    table = mapping.groupBy(F.col("target").alias("name")).agg(F.min("replacement").alias("replacement"))
    return names.join(table, "name").select(F.col("kind").alias("category"), F.col("name").alias("original"), "replacement")


def audit_mapping(mapping: DataFrame, names: DataFrame) -> DataFrame:
    """One row of counts: targets and replacements found among all names, and clashes.

    Counts are taken per replacement first, so the final sum runs over one row each.
    """
    known = names.select("name").distinct()
    hit = salted_join(mapping.select("replacement", F.col("target").alias("name")), known.withColumn("_t", F.lit(1)), "name", F.col("replacement"), "left")
    uses = hit.groupBy(F.col("replacement").alias("name")).agg(F.count("*").alias("c"), F.coalesce(F.sum("_t"), F.lit(0)).alias("t"))
    both = uses.join(known.withColumn("_r", F.lit(1)), "name", "left")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return both.agg(total(F.col("c")).alias("n"), total(F.col("t")).alias("targets_found"),
                    total(F.when(F.col("_r") == 1, F.col("c")).otherwise(0)).alias("replacements_found"),
                    total((F.col("c") > 1).cast("long")).alias("replacements_reused"))


def match_specs(nodes: DataFrame, specs: DataFrame, allowed_kinds: list[str] | None = None) -> DataFrame:
    """(node_id, spec): leaf name, parent-path suffix and optional kind.

    ``nodes`` has ``name``, ``kind`` and ``parents`` (names from the root down).
    """
    s = specs.select("spec", parse_spec("spec").alias("s")).select("spec", F.col("s.kind").alias("want"), "s.parents", F.col("s.leaf").alias("name"))
    table = s.where("name <> ''").groupBy("name").agg(F.collect_set(F.struct("spec", "want", F.col("parents").alias("tail"))).alias("_specs"))
    hits = salted_join(nodes, table, "name", F.col("node_id"))
    n = F.size("parents")

    def fits(x):
        k = F.size(x["tail"])
        tail = F.when(k == 0, F.array().cast("array<string>")).otherwise(F.slice("parents", F.greatest(n - k + 1, F.lit(1)), F.greatest(k, F.lit(1))))
        return (k <= n) & (tail == x["tail"]) & (x["want"].isNull() | (x["want"] == F.lower("kind")))

    out = hits.select("node_id", "kind", F.explode(F.filter("_specs", fits)).alias("x")).select("node_id", "kind", "x.spec")
    if allowed_kinds is not None:
        out = out.where(F.lower("kind").isin([k.strip().lower() for k in allowed_kinds]))
    return out.select("node_id", "spec")


def set_flags(nodes: DataFrame, specs: DataFrame, value: int, *, lock_children: bool = True, only_explicit_zero: bool = False,
              allowed_kinds: list[str] | None = None) -> DataFrame:
    """Nodes with ``status`` (changed, unchanged or null) and the updated flag.

    With the lock, a match below another matched node is not visited.
    ``ancestor_ids`` lists the node ids above a node, ``has_flag`` tells an
    explicit flag from an absent one.
    """
    matched = match_specs(nodes, specs, allowed_kinds).select("node_id").distinct().withColumn("_m", F.lit(True))
    out = nodes.join(matched, "node_id", "left").withColumn("_m", F.coalesce("_m", F.lit(False)))
    if lock_children:
        below = out.where("_m").select("node_id", F.explode("ancestor_ids").alias("_up"))
        locked = (salted_join(below, matched.select(F.col("node_id").alias("_up")), "_up", F.col("node_id"), "left_semi")
                  .select("node_id").distinct().withColumn("_l", F.lit(True)))
        out = out.join(locked, "node_id", "left").withColumn("_m", F.col("_m") & F.col("_l").isNull()).drop("_l")
    changes = F.col("_m") & (F.coalesce("is_exception", F.lit(0)) != value)
    if only_explicit_zero and value == 1:
        changes = changes & F.col("has_flag")
    return (out.withColumn("status", F.when(changes, "changed").when(F.col("_m"), "unchanged"))
            .withColumn("is_exception", F.when(changes, F.lit(value)).otherwise(F.col("is_exception"))).drop("_m"))


def missing_specs(nodes: DataFrame, specs: DataFrame, flagged: DataFrame) -> DataFrame:
    """Leaf names of specs that matched no node."""
    leaves = specs.select(parse_spec("spec")["leaf"].alias("name")).where("name <> ''").distinct()
    return leaves.join(flagged.where("status is not null").select("name").distinct(), "name", "left_anti")


def compare_exclusions(names: DataFrame, nodes: DataFrame) -> DataFrame:
    """(name, status): one, zero or missing, by exact name, path, then either without case.

    ``nodes`` has ``name``, ``path`` and ``is_exception``; the flag is reduced
    per key before the joins, and each name takes its first tier that matches.
    """
    flag = F.max(F.coalesce("is_exception", F.lit(0)))
    wanted = names.select(F.regexp_replace(F.trim("name"), r"^[\"']+|[\"']+$", "").alias("name")).distinct()
    out = wanted
    tiers = [("_1", F.col("name"), F.col("name")), ("_2", F.col("path"), F.col("name")),
             ("_3", F.lower("name"), F.lower("name")), ("_4", F.lower("path"), F.lower("name"))]
    for label, node_key, name_key in tiers:
        side = nodes.groupBy(node_key.alias("_k")).agg(flag.alias(label))
        if label in ("_2", "_4"):
            side = nodes.where("path <> name").groupBy(node_key.alias("_k")).agg(flag.alias(label))
        out = out.withColumn("_k", name_key).join(side, "_k", "left").drop("_k")
    best = F.coalesce("_1", "_2", "_3", "_4")
    return out.select("name", F.when(best.isNull(), "missing").when(best == 1, "one").otherwise("zero").alias("status"))

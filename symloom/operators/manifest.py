"""Build manifests: which files belong to which target."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symloom.operators.graph import ancestor_path
from symloom.session import salted_join


def links(df: DataFrame, owner: str, children: str, up: str, down: str) -> DataFrame:
    """(up, down) rows from a table that lists children in an array."""
    return df.select(F.col(owner).alias(up), F.explode(children).alias(down))


def resolve_targets(targets: DataFrame, phases: DataFrame, build_files: DataFrame, file_refs: DataFrame,
                    groups: DataFrame | None = None, suffix: str | None = ".swift") -> DataFrame:
    """(target, path): target → phase → build file → file reference → path.

    ``targets`` has (target, phase_id), ``phases`` (phase_id, build_id),
    ``build_files`` (build_id, file_ref), ``file_refs`` (file_ref, path). The
    path of a file's group is put in front where groups are given.
    """
    refs = file_refs.where(F.col("path").endswith(suffix)) if suffix else file_refs
    if groups is not None:
        refs = (refs.join(group_paths(groups).withColumnRenamed("child", "file_ref"), "file_ref", "left")
                .withColumn("path", F.when(F.coalesce("folder", F.lit("")) == "", F.col("path")).otherwise(F.concat_ws("/", "folder", "path"))))
    owned = salted_join(phases, targets.distinct(), "phase_id", F.col("build_id"))
    return (owned.select("target", "build_id").join(build_files, "build_id").join(refs, "file_ref")
            .select("target", "path").distinct())


def group_paths(groups: DataFrame) -> DataFrame:
    """(child, folder): the joined path of all groups above each child."""
    links = groups.select(F.col("id").alias("up"), F.explode_outer("children").alias("child"))
    parent = links.groupBy(F.col("child").alias("id")).agg(F.min("up").alias("parent_id")).where("id is not null")
    rows = groups.select("id", F.coalesce("path", F.lit("")).alias("name")).join(parent, "id", "left")
    up = ancestor_path(rows).select(F.col("id").alias("up"), F.array_join(F.filter("path", lambda x: x != ""), "/").alias("folder"))
    return links.where("child is not null").join(up, "up").groupBy("child").agg(F.min("folder").alias("folder"))


def choose_target(candidates: DataFrame, want: str) -> DataFrame:
    """At most one row: an exact name, else one equal without case, else the only one that contains it."""
    low = want.lower()
    name = F.col("name")
    tier = F.when(name == want, 1).when(F.lower(name) == low, 2).when(F.lower(name).contains(low), 3)
    best = (candidates.withColumn("tier", tier).where("tier is not null")
            .groupBy("tier").agg(F.min("name").alias("name"), F.countDistinct("name").alias("n")))
    substring_ok = (F.col("tier") < 3) | (F.col("n") == 1)
    return best.where(substring_ok).orderBy("tier").limit(1).select("name", "tier")


def choose_per_group(candidates: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The same choice for many wishes at once: (key, name, tier)."""
    c = salted_join(candidates, wanted.select(key, "want").distinct(), key, F.col("name"))
    low, name = F.lower("want"), F.col("name")
    tier: Column = F.when(name == F.col("want"), 1).when(F.lower(name) == low, 2).when(F.lower(name).contains(low), 3)
    tiers = (c.withColumn("tier", tier).where("tier is not null").groupBy(key, "want", "tier")
             .agg(F.min("name").alias("name"), F.max("name").alias("other"))
             .where((F.col("tier") < 3) | (F.col("name") == F.col("other"))))
    return tiers.groupBy(key, "want").agg(F.min_by(F.struct("name", "tier"), "tier").alias("b")).select(key, "want", "b.name", "b.tier")

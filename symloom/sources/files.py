"""Reading source files and classifying their paths."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from symloom.functions.names import ColumnLike, as_col

# Folders that hold built or fetched files.
SKIP_DIRS = [".git", ".build", "Pods", "Carthage", "Checkouts", ".swiftpm",
             "DerivedData", "Tuist", ".xcodeproj"]
SIDECAR_EXTS = [".xib", ".storyboard", ".plist", ".json", ".strings", ".xcassets", ".entitlements"]


def scan_files(spark: SparkSession, root: str, suffixes: Iterable[str] = (".swift",),
               skip_dirs: Iterable[str] = SKIP_DIRS) -> DataFrame:
    """One row per file under ``root``; excluded folders are filtered by path."""
    globs = ",".join("*" + s for s in suffixes)
    raw = (spark.read.option("recursiveFileLookup", True)
           .option("pathGlobFilter", "{" + globs + "}").text(root, wholetext=True)
           .select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("path")))
    base = root.rstrip("/")
    rel = F.substring_index(F.col("path"), base + "/", -1)
    dirs = F.slice(F.split(rel, "/"), 1, F.greatest(F.size(F.split(rel, "/")) - 1, F.lit(0)))
    skipped = F.arrays_overlap(dirs, F.array(*[F.lit(d) for d in skip_dirs]))
    return (raw.where(~skipped)
            .select(F.lit(base.rsplit("/", 1)[-1]).alias("project"),
                    F.xxhash64(rel).alias("file_id"), rel.alias("rel_path"), "text"))


def directory(path: ColumnLike) -> Column:
    return F.regexp_replace(as_col(path), r"[^/]*$", "")


def filter_paths(df: DataFrame, path: str, keywords: Iterable[str], drop_names: Iterable[str] = ()) -> DataFrame:
    """Drop files whose folder contains a keyword, and files with a given name."""
    folder = F.lower(directory(path))
    out = df
    for keyword in keywords:
        out = out.where(~folder.contains(keyword.lower()))
    drop_names = list(drop_names)
    if drop_names:
        out = out.where(~F.substring_index(F.col(path), "/", -1).isin(drop_names))
    return out


def sidecars(df: DataFrame, path: str, exts: Iterable[str] = SIDECAR_EXTS) -> DataFrame:
    hit = F.lit(False)
    for ext in exts:
        hit = hit | F.col(path).endswith(ext)
    return df.where(hit)


def file_origin(path: ColumnLike) -> Column:
    """``external`` for fetched packages and frameworks, else ``internal``."""
    segments = F.split(as_col(path), "/")
    named = F.arrays_overlap(segments, F.array(F.lit("Pods"), F.lit("Carthage"), F.lit("DerivedData")))
    checkout = as_col(path).rlike(r"(^|/)\.build/checkouts/")
    framework = F.exists(segments, lambda s: F.lower(s).rlike(r"^frameworks?$|\.framework$"))
    return F.when(named | checkout | framework, "external").otherwise("internal")


def attr_values(files: DataFrame, attr: str, text: str = "text") -> DataFrame:
    """Distinct values of one markup attribute."""
    values = F.regexp_extract_all(F.col(text), F.lit(attr + r'="([^"]*)"'), F.lit(1))
    return files.select(F.explode(values).alias("value")).where("value <> ''").distinct()


def asset_names(paths: DataFrame, path: str) -> DataFrame:
    """Names before the first dot, as written and in lower case."""
    name = F.substring_index(F.substring_index(F.col(path), "/", -1), ".", 1)
    return (paths.select(F.explode(F.array(name, F.lower(name))).alias("name"))
            .where("name <> ''").distinct())


def project_layout(files: DataFrame, project: str = "project", path: str = "rel_path") -> DataFrame:
    """Layout of every project from its marker files."""
    top = ~F.col(path).contains("/")
    marks = files.groupBy(project).agg(
        F.bool_or(top & (F.col(path) == "Package.swift")).alias("spm"),
        F.bool_or(top & (F.col(path) == "Project.swift")).alias("tuist"),
        F.bool_or(F.col(path).rlike(r"\.xcodeproj(/|$)")).alias("xcode"),
        F.count("*").alias("n"),
        F.bool_or(top & F.col(path).endswith(".swift")).alias("has_top"),
    )
    return marks.select(
        project,
        F.when((F.col("n") == 1) & F.col("has_top") & ~F.col("spm") & ~F.col("tuist"), "file")
        .when(F.col("spm"), "spm").when(F.col("tuist"), "tuist").when(F.col("xcode"), "xcode")
        .otherwise("unknown").alias("layout"))

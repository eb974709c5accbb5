"""Readers for name lists, rules, targets, candidate pools and policies, all as tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from symloom import schemas
from symloom.functions.scan import dense_index

KINDS = ["class", "struct", "enum", "protocol", "extension", "typealias", "function", "variable", "property"]
SECTIONS = {"project": ["input", "output", "build_target"],
            "options": [],
            "include": ["obfuscation", "encryption"],
            "exclude": ["obfuscation", "encryption"],
            "preflight": []}


def clean_names(lines: DataFrame, column: str = "value") -> DataFrame:
    """Trim, drop blanks and ``#`` lines."""
    name = F.trim(F.col(column))
    return lines.select(name.alias("name")).where((F.col("name") != "") & ~F.col("name").startswith("#"))


def read_names(spark: SparkSession, path: str) -> DataFrame:
    return clean_names(spark.read.text(path))


def parse_rules(docs: DataFrame, column: str = "value") -> DataFrame:
    """Rules from documents that are either a list or ``{"rules": [...]}``."""
    as_list = F.from_json(F.col(column), T.ArrayType(schemas.RULE))
    as_object = F.from_json(F.col(column), T.StructType([T.StructField("rules", T.ArrayType(schemas.RULE))]))
    is_list = F.ltrim(F.col(column)).startswith("[")
    rows = docs.select(F.inline(F.when(is_list, as_list).otherwise(as_object["rules"])))
    return rows.select(
        F.coalesce("A_name", "name").alias("name"),
        F.lower(F.coalesce("B_kind", "kind")).alias("kind"), "comment", "file", "path", "glob")


def read_rules(spark: SparkSession, *paths: str) -> DataFrame:
    return parse_rules(spark.read.text(list(paths), wholetext=True))


def rule_file_globs(rules: DataFrame) -> DataFrame:
    """File patterns named by rules, in lower case with forward slashes."""
    named = F.when(F.col("kind") == "file", F.col("name"))
    return (rules.select(F.explode(F.array("file", "path", "glob", named)).alias("pattern"))
            .where(F.trim("pattern") != "")
            .select(F.lower(F.translate("pattern", "\\", "/")).alias("pattern")).distinct())


def parse_targets(docs: DataFrame, column: str = "value") -> DataFrame:
    """(kind, name) from the four accepted shapes; the default kind is function."""
    c = F.col(column)
    strings = T.ArrayType(T.StringType())
    by_kind = F.map_filter(F.from_json(c, T.MapType(T.StringType(), T.StringType())),
                           lambda k, v: k.isin(KINDS) & F.ltrim(v).startswith("["))
    single = F.from_json(c, T.StructType([T.StructField("kind", T.StringType()), T.StructField("type", T.StringType()),
                                          T.StructField("names", strings), T.StructField("list", strings)]))
    is_list = F.ltrim(c).startswith("[")
    kind = F.lower(F.coalesce(single["kind"], single["type"]))
    named = F.coalesce(single["names"], single["list"])
    entry = "array<struct<kind:string,names:array<string>>>"
    shapes = (
        F.when(is_list, F.array(F.struct(F.lit("function").alias("kind"), F.from_json(c, strings).alias("names"))).cast(entry))
        .when(F.size(by_kind) > 0, F.transform(F.map_entries(by_kind), lambda e: F.struct(
            e["key"].alias("kind"), F.from_json(e["value"], strings).alias("names"))).cast(entry))
        .otherwise(F.array(F.struct(F.when(kind.isin(KINDS), kind).otherwise("function").alias("kind"),
                                    named.alias("names"))).cast(entry)))
    return docs.select(F.inline(shapes)).select("kind", F.explode("names").alias("name"))


def read_targets(spark: SparkSession, path: str) -> DataFrame:
    return parse_targets(spark.read.text(path, wholetext=True))


def parse_forbidden(docs: DataFrame, column: str = "value") -> DataFrame:
    """All names of a list or of every list-valued key, once each."""
    c = F.col(column)
    strings = T.ArrayType(T.StringType())
    values = F.map_values(F.from_json(c, T.MapType(T.StringType(), T.StringType())))
    lists = F.transform(F.filter(values, lambda v: F.ltrim(v).startswith("[")), lambda v: F.from_json(v, strings))
    names = F.when(F.ltrim(c).startswith("["), F.from_json(c, strings)).otherwise(F.flatten(lists))
    return docs.select(F.explode(names).alias("name")).distinct()


def read_forbidden(spark: SparkSession, path: str) -> DataFrame:
    return parse_forbidden(spark.read.text(path, wholetext=True))


def read_pool(spark: SparkSession, directory: str, kinds: Iterable[str]) -> DataFrame:
    """Candidate names per kind; ``property`` shares the ``variable`` pool."""
    out = None
    for kind in kinds:
        stem = "variable" if kind == "property" else kind
        safe = f"{directory}/safe_pool_{stem}.txt"
        path = safe if _exists(spark, safe) else f"{directory}/buckets_pool_{stem}.txt"
        part = (spark.read.text(path).select(F.lit(kind).alias("kind"), F.trim("value").alias("name"))
                .where("name <> ''"))
        out = part if out is None else out.unionByName(part)
    return out


def read_clusters(spark: SparkSession, directory: str, kinds: Iterable[str], lines: bool = False) -> DataFrame:
    """Cluster index per kind, one row per entry of the index, numbered 0, 1, 2, … by file and place in it.

    An index is one JSON list, or with ``lines`` one entry per line in any
    number of files, of any size: Spark may cut a file anywhere.
    """
    entry = T.StructType([
        T.StructField("rep", T.StringType()), T.StructField("tokens", T.ArrayType(T.StringType())),
        T.StructField("members", T.ArrayType(T.StringType()))])
    out = None
    for kind in kinds:
        stem = "variable" if kind == "property" else kind
        rows = spark.read.schema(entry).option("multiLine", not lines).json(f"{directory}/cluster_index_{stem}.json")
        # Inside a cut of a file the reader hands on entry by entry, so row numbers follow the order there.
        placed = rows.select("rep", "tokens", "members", F.col("_metadata.file_path").alias("_file"),
                             F.col("_metadata.file_block_start").alias("_cut"), F.monotonically_increasing_id().alias("_row"))
        numbered = dense_index(placed, [F.col("_file"), F.col("_cut"), F.col("_row")], "cluster_id")
        part = numbered.select(F.lit(kind).alias("kind"), "cluster_id", "rep", "tokens", "members")
        out = part if out is None else out.unionByName(part)
    return out


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path)


def policy_table(docs: DataFrame, column: str = "value") -> DataFrame:
    """(config key, section, category, position, pattern, is_wildcard), cleaned and de-duplicated.

    Unknown categories are dropped, a lone string counts as a list of one,
    blanks and entries that are not strings are dropped, the first of equal
    entries is kept.
    """
    key = [c for c in docs.columns if c != column]
    parsed = docs.select(*key, F.try_parse_json(column).alias("v"))

    def entries(section: str, category: str) -> Column:
        path = f"$.{section}.{category}"
        raw = F.try_variant_get("v", path, "variant")
        kind = F.schema_of_variant(raw)
        items = F.transform(F.filter(F.try_variant_get("v", path, "array<variant>"), lambda e: F.schema_of_variant(e) == "STRING"),
                            lambda e: F.try_variant_get(e, "$", "string"))
        return F.struct(F.lit(section).alias("section"), F.lit(category).alias("category"),
                        F.when(kind == "STRING", F.array(F.try_variant_get("v", path, "string"))).otherwise(items).alias("items"))

    every = F.array(*[entries(s, c) for s in ("include", "exclude") for c in SECTIONS[s]])
    rows = (parsed.select(*key, F.explode(every).alias("e"))
            .select(*key, "e.section", "e.category", F.posexplode("e.items").alias("position", "pattern"))
            .withColumn("pattern", F.trim("pattern")).where("pattern <> ''"))
    first = rows.groupBy(*key, "section", "category", "pattern").agg(F.min("position").alias("position"))
    return first.withColumn("is_wildcard", F.col("pattern").rlike(r"[*?]"))


def policy_findings(docs: DataFrame, column: str = "value") -> DataFrame:
    """(config key, finding, item) for unknown top keys and wrong value types."""
    key = [c for c in docs.columns if c != column]
    parsed = docs.select(*key, F.try_parse_json(column).alias("v"))
    top = F.map_keys(F.try_variant_get("v", "$", "map<string,variant>"))
    unknown = F.filter(F.array_except(top, F.array(*[F.lit(s) for s in SECTIONS])), lambda k: ~k.startswith("_"))

    def found(finding: str, item: str, bad: Column) -> Column:
        return F.when(bad, F.struct(F.lit(finding).alias("finding"), F.lit(item).alias("item")))

    def kind(path: str) -> Column:
        return F.schema_of_variant(F.try_variant_get("v", path, "variant"))

    checks = [found("not_an_object", s, ~kind(f"$.{s}").startswith("OBJECT")) for s in SECTIONS]
    checks += [found("not_a_list", f"{s}.{c}", ~kind(f"$.{s}.{c}").rlike("^(ARRAY|STRING)"))
               for s in ("include", "exclude") for c in SECTIONS[s]]
    all_found = F.concat(F.transform(unknown, lambda k: F.struct(F.lit("unknown_key").alias("finding"), k.alias("item"))),
                         F.filter(F.array(*checks), lambda f: f.isNotNull()))
    return parsed.select(*key, F.explode(all_found).alias("f")).select(*key, "f.finding", "f.item")


def load_policy(spark: SparkSession, path: str) -> DataFrame:
    """The policy table of a file that Spark can read."""
    return policy_table(spark.read.text(path, wholetext=True)).drop("value")


def first_seen(df: DataFrame, keys: list[str], value: str, position: str) -> DataFrame:
    """Keep the first of equal values, with its position."""
    return df.groupBy(*keys, value).agg(F.min(position).alias(position))


def latest_rule_by_name(rules: DataFrame, order: str) -> DataFrame:
    """One rule per name; of equal names the last wins."""
    others = [c for c in rules.columns if c not in ("name", order)]
    return (rules.groupBy("name").agg(F.max_by(F.struct(*others), F.col(order)).alias("r"))
            .select("name", "r.*"))


def sample_sorted(df: DataFrame, column: str, n: int) -> DataFrame:
    """The first ``n`` distinct values in order; Spark runs this as a bounded top-n."""
    return df.select(column).distinct().orderBy(column).limit(n)



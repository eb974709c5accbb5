"""Matching declared members against external and SDK catalogs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from symloom.functions.names import leaf
from symloom.session import cut_lineage, salted_join, scope

# Catalog member kinds, and the names of well-known bases.
SDK_KINDS = ["Var", "Func", "Constructor", "Subscript", "Enum", "EnumElement", "TypeAlias", "AssociatedType"]
RAW_VALUE_BASES = ["String", "Int", "UInt", "Double", "Float", "Character", "CaseIterable", "Decodable",
                   "Encodable", "Codable", "NSCoding", "NSSecureCoding"]
CODING_BASES = ["Decodable", "Encodable", "NSCoding", "NSSecureCoding"]


_CHILD2 = T.StructType([T.StructField(n, T.StringType()) for n in ("kind", "declKind", "name", "printedName", "usr")])
_CHILD = T.StructType([T.StructField(n, T.StringType()) for n in ("kind", "declKind", "name", "moduleName", "usr", "printedName")]
                      + [T.StructField("children", T.StringType())])
_ROOT = T.StructType([T.StructField("ABIRoot", T.StructType([
    T.StructField("name", T.StringType()), T.StructField("children", T.ArrayType(_CHILD))]))])


def parse_sdk(docs: DataFrame, column: str = "value") -> DataFrame:
    """(type_name, kind, module, usr, member, member_kind, member_type) from catalog dumps.

    Types nested in types are read level by level, down to the deepest; every
    level is written to the shared folder.
    """
    children = T.ArrayType(_CHILD)
    level = docs.select(F.explode(F.from_json(column, _ROOT)["ABIRoot"]["children"]).alias("c")).select("c.*")
    out = None
    while True:
        level = cut_lineage(level.where("kind = 'TypeDecl'"))
        if out is not None and level.isEmpty():
            return out
        types_ = level.withColumn("m", F.from_json("children", T.ArrayType(_CHILD2)))
        members = F.filter("m", lambda m: F.coalesce(m["declKind"], m["kind"]).isin(SDK_KINDS))
        rows = types_.select(
            F.col("name").alias("type_name"), F.coalesce("declKind", "kind").alias("kind"), F.col("moduleName").alias("module"),
            "usr", F.explode_outer(members).alias("m")).select(
            "type_name", "kind", "module", "usr", F.col("m.name").alias("member"),
            F.coalesce("m.declKind", "m.kind").alias("member_kind"), F.col("m.printedName").alias("member_type"))
        out = rows if out is None else out.unionByName(rows)
        level = types_.select(F.explode(F.from_json("children", children)).alias("c")).select("c.*")


def reexports(docs: DataFrame, imported: DataFrame, column: str = "value") -> DataFrame:
    """Modules re-exported by catalogs and not imported already."""
    root = F.from_json(column, _ROOT)["ABIRoot"]
    rows = docs.select(root["name"].alias("root"), F.explode(root["children"]).alias("c"))
    keep = ((F.col("c.kind") == "Import") & (F.coalesce("c.name", F.lit("")) != "")
            & ~F.col("c.name").startswith("_")
            & ~((F.coalesce("root", F.lit("")) != "") & F.col("c.name").startswith(F.concat("root", F.lit(".")))))
    return (rows.where(keep).select(F.col("c.name").alias("module")).distinct()
            .join(imported.select("module").distinct(), "module", "left_anti"))


def import_list(imports: DataFrame) -> DataFrame:
    """Distinct modules with the two that are always there."""
    spark = imports.sparkSession
    always = spark.createDataFrame([("Swift",), ("Foundation",)], "module string")
    return imports.select("module").distinct().union(always).distinct()


def name_index(ext_nodes: DataFrame, name: str = "name", file: str = "ext_file") -> DataFrame:
    """(name, file) once each. Kept as rows: a common name may be in very many files."""
    return ext_nodes.select(F.col(name).alias("name"), F.col(file).alias("file")).distinct()


def _owner_matches(cands: DataFrame, catalog: DataFrame) -> DataFrame:
    """(node_id, base): an extension by its leaf name, any node by an adopted name; within the project if the catalog has any."""
    own = scope(cands, catalog)
    wanted = (cands.where("kind = 'extension'").select("node_id", *own, leaf("name").alias("base"), F.lit(True).alias("by_name"))
              .unionByName(cands.select("node_id", *own, F.explode("adopted").alias("base"), F.lit(False).alias("by_name"))))
    return salted_join(wanted, catalog.select(*own, F.col("name").alias("base")).distinct(), [*own, "base"], F.col("node_id")).drop(*own)


def _with_descendants(pairs: DataFrame, tree: DataFrame) -> DataFrame:
    """Pass a base on to everything below the matched node: (node_id, base).

    ``tree`` has (root_id, node_id), each node below itself included.
    """
    below = tree.select(F.col("root_id").alias("node_id"), F.col("node_id").alias("_below"))
    return salted_join(below, pairs, "node_id", F.col("_below"), salts=1).select(F.col("_below").alias("node_id"), "base").distinct()


def _known_members(members: DataFrame, catalog_members: DataFrame) -> DataFrame:
    """Members of whose name and kind the catalog has any: only these are worth offering to all bases of their owner."""
    key = F.concat_ws("\u0001", "name", "kind").alias("_nk")
    return salted_join(members.select("*", key), catalog_members.select(key).distinct(), "_nk", F.col("member_id"), "left_semi").drop("_nk")


def match_external(cands: DataFrame, members: DataFrame, tree: DataFrame, ext_nodes: DataFrame,
                   ext_members: DataFrame) -> DataFrame:
    """(node_id, reason): extensions of external types, and members that an
    external protocol requires or that override an external class member."""
    pairs = _owner_matches(cands, ext_nodes)
    own = pairs.where("by_name").select("node_id", F.lit("external_extension").alias("reason"))
    owners = _with_descendants(pairs.select("node_id", "base"), tree)
    requirement = (ext_members.join(ext_nodes.select("node_id", F.col("name").alias("base"), F.col("kind").alias("base_kind")),
                                    ext_members["parent_id"] == F.col("node_id"))
                   .select("base", "base_kind", ext_members["name"], ext_members["kind"]))
    keyed = requirement.groupBy(F.concat_ws("\u0001", "base", "name", "kind").alias("_key")).agg(
        F.bool_or(F.col("base_kind") == "protocol").alias("_protocol"), F.bool_or(F.col("base_kind") == "class").alias("_class"))
    own_members = _known_members(members.select(F.col("node_id").alias("member_id"), F.col("parent_id").alias("node_id"), "name", "kind", "attributes"),
                                 requirement)
    offered = (salted_join(own_members, owners, "node_id", F.col("member_id"), salts=1)
               .withColumn("_key", F.concat_ws("\u0001", "base", "name", "kind")))
    hit = salted_join(offered, keyed, "_key", F.col("member_id"))
    kept = hit.where(F.col("_protocol") | (F.col("_class") & F.array_contains("attributes", "override")))
    return own.union(kept.select(F.col("member_id").alias("node_id"), F.lit("external_member").alias("reason"))).distinct()


def match_sdk(cands: DataFrame, members: DataFrame, tree: DataFrame, sdk: DataFrame) -> DataFrame:
    """(node_id, reason) against SDK types: (type_name, member, member_kind)."""
    codable = (F.array_contains("adopted", "Codable"))
    extra = F.array(F.lit("Decodable"), F.lit("Encodable"))
    cands = cands.withColumn("adopted", F.when(codable, F.array_union("adopted", extra)).otherwise(F.col("adopted")))
    pairs = _owner_matches(cands, sdk.select(F.col("type_name").alias("name")))
    kinds = cands.select("node_id", "kind")
    base = F.col("base")
    own = pairs.where("by_name").select("node_id", F.lit("sdk_extension").alias("reason"))
    ui = (pairs.where(~F.col("by_name") & (base.isin("UIViewController", "UITableViewController")
                      | (base.contains("UI") & (base.contains("View") | base.contains("Controller")))))
          .select("node_id", F.lit("sdk_ui_base").alias("reason")))
    adopted = pairs.where("not by_name").select("node_id", "base").join(kinds, "node_id")
    raw = _with_descendants(adopted.where((F.col("kind") == "enum") & base.isin(RAW_VALUE_BASES)).select("node_id", "base"), tree)
    coding = _with_descendants(adopted.where(base.isin(CODING_BASES)).select("node_id", "base"), tree)
    child = members.select(F.col("node_id").alias("member_id"), F.col("parent_id").alias("node_id"), leaf("name").alias("name"), "kind")
    cases = (salted_join(child.where("kind = 'case'"), raw.select("node_id").distinct(), "node_id", F.col("member_id"), "left_semi", salts=1)
             .select(F.col("member_id").alias("node_id"), F.lit("sdk_raw_value").alias("reason")))
    coded = (salted_join(child, coding.select("node_id").distinct(), "node_id", F.col("member_id"), "left_semi", salts=1)
             .select(F.col("member_id").alias("node_id"), F.lit("sdk_coding").alias("reason")))
    mk = F.lower("member_kind")
    kind = F.when(mk == "var", "variable").when(mk == "enumelement", "case").when(mk == "func", "function").otherwise(mk)
    keyed = sdk.where("member is not null").select(F.concat_ws("\u0001", "type_name", "member", kind).alias("_key")).distinct()
    owners = _with_descendants(pairs.select("node_id", "base"), tree)
    values = child.where(~F.col("kind").isin("struct", "protocol", "class", "enum"))
    known = _known_members(values, sdk.where("member is not null").select(F.col("member").alias("name"), kind.alias("kind")))
    offered = (salted_join(known, owners, "node_id", F.col("member_id"), salts=1)
               .withColumn("_key", F.concat_ws("\u0001", "base", "name", "kind")))
    same = (salted_join(offered, keyed, "_key", F.col("member_id"), "left_semi")
            .select(F.col("member_id").alias("node_id"), F.lit("sdk_member").alias("reason")))
    return own.union(ui).union(cases).union(coded).union(same).distinct()


def external_names(ext_nodes: DataFrame) -> DataFrame:
    """Names and parameter labels of external nodes; nested members are rows already."""
    labels = F.filter("params", lambda p: p != "_")
    return ext_nodes.select(F.explode(F.concat(F.array("name"), F.coalesce(labels, F.array().cast("array<string>")))).alias("name")).distinct()


def sdk_names(sdk: DataFrame) -> DataFrame:
    """Type, member and parameter names of an SDK catalog."""
    inside = F.regexp_extract("member_type", r"(?s)\((.*)\)", 1)
    params = F.filter(F.transform(F.split(inside, ":"), lambda p: F.trim(p)), lambda p: ~p.isin("", "_"))
    types_ = F.when(F.col("kind").isin("Class", "Struct", "Protocol", "Enum"), F.col("type_name"))
    return (sdk.select(F.explode(F.concat(F.array(types_, F.col("member")), F.coalesce(params, F.array().cast("array<string>")))).alias("name"))
            .where("name is not null").distinct())

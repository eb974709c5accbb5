"""Table schemas, stated once; nothing is inferred from data."""

from __future__ import annotations

from pyspark.sql import types as T


def _s(name: str) -> T.StructField:
    return T.StructField(name, T.StringType())


def _strings(name: str) -> T.StructField:
    return T.StructField(name, T.ArrayType(T.StringType()))


LOCATION = T.StructType([
    _s("file"), T.StructField("line", T.IntegerType()), T.StructField("col", T.IntegerType())])

NODES = T.StructType([
    _s("project"), T.StructField("node_id", T.LongType()), T.StructField("parent_id", T.LongType()),
    _s("name"), _s("kind"), _s("access"), _strings("attributes"), _strings("adopted"),
    T.StructField("loc", LOCATION), _s("initial_value"), _strings("params"), _strings("param_types"),
    _s("return_type"), T.StructField("is_exception", T.IntegerType())])

FILES = T.StructType([
    _s("project"), T.StructField("file_id", T.LongType()), _s("rel_path"), _s("text")])

RULE = T.StructType([
    _s("name"), _s("A_name"), _s("kind"), _s("B_kind"), _s("comment"), _s("file"), _s("path"), _s("glob")])

SDK_MEMBER = T.StructType([_s("kind"), _s("type"), _s("usr")])
SDK_TYPES = T.StructType([
    _s("type_name"), _s("kind"), _s("module"), _s("usr"),
    T.StructField("members", T.MapType(T.StringType(), SDK_MEMBER))])

LOG_LINES = T.StructType([_s("run_id"), T.StructField("ts", T.TimestampType()), _s("line")])

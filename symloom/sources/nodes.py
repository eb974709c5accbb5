"""Readers for nested declaration files and SDK dumps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from symloom.operators.catalog import parse_sdk
from symloom.operators.graph import flatten


def read_nodes(spark: SparkSession, directory: str) -> DataFrame:
    """All declaration files of a folder, nested members as rows."""
    docs = (spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(directory, wholetext=True)
            .selectExpr("_metadata.file_path as doc_id", "value"))
    return flatten(docs)


def read_sdk(spark: SparkSession, directory: str) -> DataFrame:
    return parse_sdk(spark.read.option("pathGlobFilter", "*.json").text(directory, wholetext=True))

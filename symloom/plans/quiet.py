"""Literals to encrypt and calls to remove."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symloom.functions.calls import DEBUG_NAMES
from symloom.operators import literals as lit, rewrite
from symloom.session import salted_join


class Literals(NamedTuple):
    encrypted: DataFrame
    report: DataFrame


def protect_literals(files: DataFrame, policy: DataFrame, key: Column, id_column: str = "file_id") -> Literals:
    """Literals on unaffected lines that no policy excludes, with their cipher text, and the policy report."""
    table = lit.literal_table(files, "swift", keep=[id_column])
    effects = lit.literal_policy(policy)
    held_back = effects.where("effect <> 'included'").select(F.concat(F.lit('"'), "pattern", F.lit('"')).alias("value"))
    wanted = salted_join(lit.keep_literals(table), held_back, "value", F.struct(id_column, "line_no"), "left_anti")
    return Literals(lit.encrypt_literals(wanted, key), lit.literal_policy_report(table, effects))


class Quiet(NamedTuple):
    files: DataFrame
    calls: DataFrame
    report: DataFrame
    changes: DataFrame


def remove_debug_calls(files: DataFrame, id_column: str = "file_id", path: str = "rel_path") -> Quiet:
    """Files without debug calls, the calls found, their report, and what changed."""
    own = rewrite.user_defined(files)
    calls = rewrite.debug_calls(files, own, keep=[id_column, path])
    cleaned = rewrite.remove_calls(files.withColumn("_before", F.col("text")), DEBUG_NAMES, own=own)
    changes = rewrite.diff_rows(cleaned, id_column, "_before", "text")
    return Quiet(cleaned.drop("_before"), calls, rewrite.debug_report(calls, path), changes)

"""Grouped reports over edits and steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def edit_summary(edits: DataFrame, project: str = "project", file: str = "file", amount: str = "n_edits") -> DataFrame:
    """(project, file, n_files, n_edits): per file, per project and in total.

    Files are summed first; the rollup then runs over one row per file.
    """
    per_file = edits.groupBy(project, file).agg(F.sum(amount).alias("n_edits"))
    return per_file.rollup(project, file).agg(F.count("*").alias("n_files"), F.sum("n_edits").alias("n_edits"))


def group_status(steps: DataFrame, keys: list[str], step: str, state: str, done: str = "done") -> DataFrame:
    """A group is Done when any of its steps is."""
    return steps.groupBy(*keys).agg(
        F.when(F.bool_or(F.col(state) == done), "Done").otherwise("Skipped").alias("status"), F.countDistinct(step).alias("n_steps"))

"""A policy against a corpus: what is missing, what conflicts, what changes."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symloom.operators import flags, policy as pol


class Preflight(NamedTuple):
    presence: DataFrame
    include_conflicts: DataFrame
    exclude_candidates: DataFrame
    nodes: DataFrame
    compared: DataFrame


def preflight(names: DataFrame, nodes: DataFrame, policy: dict[str, list[str]], scored: DataFrame, mode: str = "ask") -> Preflight:
    """``nodes`` has name, kind, path, parents, ancestor_ids, is_exception and has_flag.

    Included names that are exceptions follow ``mode``; excluded names found in
    the corpus are flagged, top match first; ``compared`` sets a list of scored
    names against the flags.
    """
    presence = pol.policy_presence(names, policy)
    conflicts, resolved = pol.resolve_conflicts(policy.get("include.obfuscation", []), nodes, mode)
    excluded = pol.exclude_candidates(policy.get("exclude.obfuscation", []), names, nodes)
    specs = excluded.where("in_nodes").select(F.col("name").alias("spec"))
    updated = flags.set_flags(resolved, specs, 1, only_explicit_zero=True)
    return Preflight(presence, conflicts, excluded, updated, flags.compare_exclusions(scored, updated))

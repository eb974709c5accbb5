"""All registered queries."""

from __future__ import annotations

from symloom.queries import corpus, graph, lexical, mapping, names, plans, policy, rules, steps, tokens  # noqa: F401
from symloom.queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "flagship"]


def flagship(spark, sf):
    return QUERIES["policy_presence"](spark, sf)

"""Include/exclude policies against the names of a corpus. Patterns are rows, in any number, as names are."""

from __future__ import annotations

import re
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from symloom.session import cut_lineage, salted_join, shuffled

GRAM = 3
# So many wildcards are sent to every task.
FEW = 10_000


def is_wildcard(pattern: str) -> bool:
    return any(ch in pattern for ch in "*?[")


def split_globs(patterns: Iterable[str]) -> tuple[list[str], list[str]]:
    """(literals, wildcards), blanks dropped, each once."""
    cleaned = list(dict.fromkeys(p.strip() for p in patterns if p and p.strip()))
    return [p for p in cleaned if not is_wildcard(p)], [p for p in cleaned if is_wildcard(p)]


def glob_regex(pattern: str) -> str:
    """Shell pattern to a regex: ``*``, ``?``, ``[abc]``, ``[!abc]``; case-sensitive."""
    out, i = "", 0
    while i < len(pattern):
        ch = pattern[i]
        close = pattern.find("]", i + 2) if ch == "[" else -1
        if close > 0:
            body = pattern[i + 1:close].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "\\&\\&")
            body = "^" + body[1:] if body[0] == "!" else ("\\^" + body[1:] if body[0] == "^" else body)
            out, i = out + f"[{body}]", close + 1
            continue
        out += {"*": ".*", "?": "."}.get(ch) or ("\\" + ch if not ch.isalnum() and ch.isascii() and ch != "_" else ch)
        i += 1
    return out


def pattern_table(spark: SparkSession, patterns: Iterable[str]) -> DataFrame:
    """(pattern) rows, trimmed, blanks dropped, each once."""
    return spark.createDataFrame([(p,) for p in dict.fromkeys(p.strip() for p in patterns if p and p.strip())], "pattern string")


@F.pandas_udf(T.StructType([T.StructField("regex", T.StringType()), T.StructField("gram", T.StringType())]))
def _compiled(patterns: pd.Series) -> pd.DataFrame:
    """The regex of a wildcard, and up to ``GRAM`` characters in a row that every match holds."""
    def gram(pattern: str) -> str:
        return max(re.split(r"[*?\[]+", re.sub(r"(?s)\[.[^\]]*\]", "*", pattern)), key=len)[:GRAM]

    return pd.DataFrame([(f"(?s)^{glob_regex(p)}$", gram(p)) for p in patterns], columns=["regex", "gram"])


def _cut(name: Column, n: int):
    return lambda i: F.substring(name, i, F.lit(n))


def _grams(name: Column) -> Column:
    """All runs of up to ``GRAM`` characters of a name, and the empty one."""
    runs = [F.transform(F.sequence(F.lit(1), F.greatest(F.length(name) - n + 1, F.lit(1))), _cut(name, n)) for n in range(1, GRAM + 1)]
    return F.array_distinct(F.concat(F.array(F.lit("")), *runs))


def match_wildcards(values: DataFrame, wildcards: DataFrame) -> DataFrame:
    """(value, pattern) for distinct ``value`` rows and ``pattern`` rows that match them.

    A wildcard is joined by the first characters of its longest literal run to
    the values that hold them, and only these pairs are tested; a pattern without any
    literal character meets all values, as it has to. Wildcards are written and
    counted: up to ``FEW`` are sent out, with more both sides are shuffled.
    """
    parts = cut_lineage(wildcards.select("pattern", _compiled("pattern").alias("c")).select("pattern", "c.regex", F.col("c.gram").alias("gram")))
    pairs = values.select("value", F.explode(_grams(F.col("value"))).alias("gram")).join(F.broadcast(parts) if parts.count() <= FEW else shuffled(parts), "gram")
    return pairs.where(F.regexp_like("value", F.col("regex"))).select("value", "pattern")


def glob_match(names: DataFrame, patterns: Iterable[str] | DataFrame, column: str = "name") -> DataFrame:
    """(name, pattern) for every distinct name and every pattern it matches; ``patterns`` may be a table of any size.

    Literal patterns are an equi-join, wildcards go by their literal parts.
    """
    table = patterns if isinstance(patterns, DataFrame) else pattern_table(names.sparkSession, patterns)
    wild = F.col("pattern").rlike(r"[*?\[]")
    distinct = names.select(F.col(column).alias("name")).where("name IS NOT NULL").distinct()
    literal = distinct.join(table.where(~wild).select(F.col("pattern").alias("name")), "name", "left_semi").select("name", F.col("name").alias("pattern"))
    matched = match_wildcards(distinct.select(F.col("name").alias("value")), table.where(wild))
    return literal.unionByName(matched.select(F.col("value").alias("name"), "pattern"))


def policy_presence(names: DataFrame, policy: dict[str, list[str]]) -> DataFrame:
    """(category, finding, pattern) per ``section.category``: a lone ``*``,
    wildcards without a match, and literals that are absent."""
    spark = names.sparkSession
    rows = [(cat, p.strip(), is_wildcard(p)) for cat, ps in policy.items() for p in dict.fromkeys(ps) if p.strip()]
    table = spark.createDataFrame(rows, "category string, pattern string, wild boolean")
    used = glob_match(names, [p for _, p, _ in rows]).select("pattern").distinct()
    missing = table.where("pattern <> '*'").join(used, "pattern", "left_anti")
    return (table.where("pattern = '*'").select("category", F.lit("bare_star").alias("finding"), "pattern")
                .unionByName(missing.select("category", F.when(F.col("wild"), "wildcard_without_match")
                                            .otherwise("literal_absent").alias("finding"), "pattern")))


def policy_conflicts(policy: DataFrame) -> DataFrame:
    """(category, pattern) that is both included and excluded."""
    sides = policy.groupBy("category", "pattern").agg(
        F.bool_or(F.col("section") == "include").alias("i"), F.bool_or(F.col("section") == "exclude").alias("e"))
    return sides.where("i and e").select("category", "pattern")


def policy_overlap(policy: DataFrame, exceptions: DataFrame) -> DataFrame:
    """(section, category, name): policy names that are exceptions already; one join for all four sets."""
    flagged = exceptions.select("name").distinct()
    wanted = policy.select("section", "category", F.col("pattern").alias("name")).distinct()
    return wanted.join(flagged, "name", "left_semi").select("section", "category", "name")


def resolve_conflicts(patterns: Iterable[str], nodes: DataFrame, mode: str) -> tuple[DataFrame, DataFrame]:
    """(conflicts, nodes): included names that are exceptions.

    ``force`` clears the flag on functions of those names; ``skip`` and
    ``ask`` leave the nodes as they are.
    """
    if mode not in ("force", "skip", "ask"):
        raise ValueError(f"unknown mode {mode}")
    flagged = nodes.where("is_exception = 1").select("name")
    conflicts = glob_match(flagged, patterns).select("name").distinct()
    if mode != "force":
        return conflicts, nodes
    marked = salted_join(nodes, conflicts.withColumn("_c", F.lit(True)), "name", F.col("node_id"), "left")
    cleared = marked.withColumn("is_exception", F.when(F.col("_c") & (F.col("kind") == "function"), 0).otherwise(F.col("is_exception")))
    return conflicts, cleared.select(*nodes.columns)


def exclude_candidates(patterns: Iterable[str], corpus_names: DataFrame, nodes: DataFrame) -> DataFrame:
    """(name, in_nodes): excluded names present in the corpus, and whether a node has that name."""
    present = glob_match(corpus_names, patterns).select("name").distinct()
    known = nodes.select("name").distinct().withColumn("in_nodes", F.lit(True))
    return present.join(shuffled(known), "name", "left").withColumn("in_nodes", F.coalesce("in_nodes", F.lit(False)))


def name_lists(*lists: DataFrame) -> DataFrame:
    """Union of name lists, each name once."""
    out = lists[0].select("name")
    for other in lists[1:]:
        out = out.union(other.select("name"))
    return out.where("name is not null and name <> ''").distinct()

"""Rewriting whole texts: pseudonyms, removed calls and comments, change reports."""

from __future__ import annotations

import difflib
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from symloom.functions import calls as cl, grammar
from symloom.functions.comments import strip_comments
from symloom.operators.tokens import WORD
from symloom.session import hold, salted_join, scope, shuffled, small_batches

# What is copied unchanged in code: comments and string contents.
MASKED = {
    "plain": "",
    "swift": r'(?s)/\*.*?\*/|//[^\n]*|""".*?"""|"(?:\\.|[^"\\\n])*"|',
}


def _pieces(profile: str) -> str:
    """Comment, string, name (back-ticks or ``$`` kept outside), or one run of anything else."""
    return MASKED[profile] + r"[\p{L}_][\p{L}\p{N}_]*"


def _rewriter(profile: str):
    """Python twin of ``_pieces``: letters are ``[^\\W\\d_]`` there."""
    masked = MASKED[profile].replace("(?s)", "")
    return re.compile(masked + r"(?P<name>[^\W\d]\w*)", re.S)


def pseudonymize(files: DataFrame, mapping: DataFrame, key: str, text: str = "text", profile: str = "plain") -> DataFrame:
    """Replace every whole-token occurrence of a mapped name.

    The mapping is joined to the distinct tokens of each file, and only the
    hits travel back to the files, so it may be of any size.
    """
    pairs = mapping.select("target", "replacement").distinct()
    tokens = F.filter(F.array_distinct(F.regexp_extract_all(text, F.lit(_pieces(profile)), F.lit(0))),
                      lambda t: t.rlike(rf"^{WORD}$"))
    hits = salted_join(files.select(key, F.explode(tokens).alias("target")), pairs, "target", F.col(key))
    per_file = hits.groupBy(key).agg(F.collect_list("target").alias("_from"), F.collect_list("replacement").alias("_to"))

    @F.pandas_udf(T.StringType())
    def rewrite(texts: pd.Series, sources: pd.Series, targets: pd.Series) -> pd.Series:
        pattern = _rewriter(profile)
        return pd.Series([_replace(pattern, t, dict(zip(s, r)) if s is not None else {})
                          for t, s, r in zip(texts, sources, targets)])

    return files.join(shuffled(per_file), key, "left").withColumn(text, rewrite(text, "_from", "_to")).drop("_from", "_to")


def pseudonymize_by_table(files: DataFrame, table: dict[str, str], text: str = "text", profile: str = "plain") -> DataFrame:
    """The same for a mapping that the caller holds and states to be small; the texts are not moved."""
    return _by_table(files, table, text, profile)


def _replace(pattern: re.Pattern, text: str | None, table: dict[str, str]) -> str | None:
    if not table or text is None:
        return text
    return pattern.sub(lambda m: table.get(m.group("name"), m.group()) if m.group("name") else m.group(), text)


def _by_table(files: DataFrame, table: dict[str, str], text: str, profile: str) -> DataFrame:
    small_batches(files.sparkSession)
    shared = files.sparkSession.sparkContext.broadcast(table)

    @F.pandas_udf(T.StringType())
    def rewrite(texts: pd.Series) -> pd.Series:
        pattern, names = _rewriter(profile), shared.value
        return texts.map(lambda t: _replace(pattern, t, names))

    return files.withColumn(text, rewrite(text))


def strip_comments_lexed(files: DataFrame, text: str = "text") -> DataFrame:
    @F.pandas_udf(T.StringType())
    def strip(texts: pd.Series) -> pd.Series:
        return texts.map(strip_comments)

    return files.withColumn(text, strip(text))


_SPAN = T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("prefixed", T.BooleanType()),
                                  T.StructField("start_line", T.IntegerType()), T.StructField("end_line", T.IntegerType())]))


def _mentions(text: str, names: list[str]):
    return F.col(text).rlike(r"\b(?:" + "|".join(re.escape(n) for n in names) + r")\s*\(|Thread\.callStackSymbols")


def user_defined(files: DataFrame, names: list[str] = cl.DEBUG_NAMES, text: str = "text") -> DataFrame:
    """([project,] name) of calls that the corpus defines itself, with any attributes and modifiers; at most one row per name and project."""
    pattern = rf"(?m)^[ \t]*{grammar.ATTRIBUTES}(?:{grammar.MODIFIER}[ \t]+)*func\s+({'|'.join(names)})\b"
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)))
    return files.select(*scope(files), F.explode(found).alias("name")).distinct()


def debug_calls(files: DataFrame, own: DataFrame, names: list[str] = cl.DEBUG_NAMES, text: str = "text",
                keep: list[str] | None = None) -> DataFrame:
    """(keep, name, start_line, end_line, code) of calls, unless the corpus defines the name itself."""
    kept = keep or [c for c in files.columns if c != text]

    @F.pandas_udf(_SPAN)
    def spans(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"name": n, "prefixed": p, "start_line": s, "end_line": e}
                                    for n, p, s, e in cl.call_spans(t, names)])

    own_scope = scope(files, own)
    extra = [c for c in own_scope if c not in kept]
    found = (files.where(_mentions(text, names)).select(*kept, *extra, F.split(text, "\n").alias("_l"), spans(text).alias("_s"))
             .select(*kept, *extra, F.explode(F.transform("_s", lambda s: F.struct(
                 s["name"].alias("name"), s["prefixed"].alias("prefixed"), s["start_line"].alias("start_line"),
                 s["end_line"].alias("end_line"), F.trim(F.get("_l", s["start_line"] - 1)).alias("code")))).alias("s"))
             .select(*kept, *extra, "s.*"))
    defined = own.select(*own_scope, "name").where(F.col("name").isin(names)).distinct().withColumn("_own", F.lit(True))
    return found.join(defined, [*own_scope, "name"], "left").where("_own is null or prefixed").drop("_own", "prefixed").select(
        *kept, "name", "start_line", "end_line", "code")


def debug_report(calls: DataFrame, path: str) -> DataFrame:
    """(path, n_calls, first_line, last_line) per file; the entries stay rows of ``calls``."""
    return calls.groupBy(path).agg(F.count("*").alias("n_calls"), F.min("start_line").alias("first_line"),
                                   F.max("end_line").alias("last_line"))


_REMOVED = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_removed", T.IntegerType())])


def remove_calls(files: DataFrame, names: list[str] = cl.DEBUG_NAMES, text: str = "text", own: DataFrame | None = None) -> DataFrame:
    """Text without the calls, and ``n_removed``; one pass over the texts. Null texts stay.

    ``own`` is what :func:`user_defined` finds: names that a project defines
    itself stay in its files, a handful per project at most.
    """
    kept_names = F.array().cast("array<string>")
    columns = files.columns
    if own is not None:
        by = scope(files, own)
        per = own.where(F.col("name").isin(names)).groupBy(*by).agg(F.collect_set("name").alias("_own"))
        files = files.join(per, by, "left") if by else files.crossJoin(F.broadcast(per))  # without projects: one row
        kept_names = F.coalesce("_own", kept_names)

    @F.pandas_udf(_REMOVED)
    def strip(texts: pd.Series, owned: pd.Series) -> pd.DataFrame:
        rows = []
        for value, mine in zip(texts, owned):
            wanted = [n for n in names if n not in mine]
            rows.append(cl.remove_calls(value, wanted, [n for n in wanted if n in cl.QUIET_NAMES]) if wanted else (value, 0))
        return pd.DataFrame(rows, columns=["text", "n_removed"])

    return hold(files, "_r", strip(text, kept_names)).withColumn(text, F.col("_r.text")).select(*columns, F.col("_r.n_removed").alias("n_removed"))


def remove_statements(files: DataFrame, name: str, text: str = "text") -> DataFrame:
    """One-line ``name(digits);`` statements removed with a pattern, inside the JVM."""
    pattern = rf"\b{name}\([0-9]*\);"
    return (files.withColumn("n_removed", F.regexp_count(text, F.lit(pattern)))
            .withColumn(text, F.regexp_replace(text, pattern, "")))


def diff_rows(files: DataFrame, key: str, before: str, after: str) -> DataFrame:
    """(key, n_changed, before, after) of the rows whose two texts differ; lines are compared by number. Nothing is moved."""
    pair = files.select(key, F.col(before).alias("before"), F.col(after).alias("after")).where("before <> after")
    zipped = F.arrays_zip(F.split("before", "\n").alias("b"), F.split("after", "\n").alias("a"))
    return pair.select(key, F.size(F.filter(zipped, lambda z: ~z["b"].eqNullSafe(z["a"]))).alias("n_changed"), "before", "after")


def diff_files(before: DataFrame, after: DataFrame, key: str, text: str = "text") -> DataFrame:
    """The same for texts in two tables: digests are joined first, then the texts of what has changed."""
    def digests(side: DataFrame, name: str) -> DataFrame:
        return side.select(key, F.sha2(text, 256).alias(name))

    changed = digests(before, "_b").join(digests(after, "_a"), key).where("_b <> _a").select(key)
    pair = (before.select(key, F.col(text).alias("before")).join(changed, key)
            .join(after.select(key, F.col(text).alias("after")), key))
    return diff_rows(pair, key, "before", "after")


def unified_diff(diffs: DataFrame, name: str) -> DataFrame:
    """Add the unified diff text; runs on changed files only."""
    @F.pandas_udf(T.StringType())
    def render(names: pd.Series, before: pd.Series, after: pd.Series) -> pd.Series:
        return pd.Series(["\n".join(difflib.unified_diff(b.split("\n"), a.split("\n"), f"a/{n}", f"b/{n}", lineterm=""))
                          for n, b, a in zip(names, before, after)])

    return diffs.withColumn("diff", render(F.col(name).cast("string"), "before", "after"))

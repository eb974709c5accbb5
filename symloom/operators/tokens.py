"""Token index and what is read off it: first files, roles, references, snippets.

Texts are tokenized once. Tokens are reduced per line or per file before any
shuffle, and joins against name lists are salted, since a common word can make
up a large share of all tokens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from symloom.functions.names import ColumnLike, as_col
from symloom.session import hold, salted_join, shuffled

WORD = r"[\p{L}_][\p{L}\p{N}_]*"


def words(text: ColumnLike) -> Column:
    return F.regexp_extract_all(as_col(text), F.lit(WORD), F.lit(0))


def token_lines(files: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, token, line_no): the first line of every distinct token of a file."""
    per_line = F.flatten(F.transform(F.split(text, "\n"), lambda l, i: F.transform(
        F.array_distinct(words(l)), lambda t: F.struct(t.alias("token"), (i + 1).alias("line_no")))))
    return (files.select(*keys, F.explode(per_line).alias("x")).groupBy(*keys, "x.token")
            .agg(F.min("x.line_no").alias("line_no")))


def first_file(idents: DataFrame, files: DataFrame, path: str, text: str = "text") -> DataFrame:
    """(name, path, line_no): the first file, in path order, that contains each name.

    The minimum is taken before the join, so a word found everywhere costs one
    row per task, and the join sees every token once.
    """
    per_line = F.flatten(F.transform(F.split(text, "\n"), lambda l, i: F.transform(
        F.array_distinct(words(l)), lambda t: F.struct(t.alias("token"), (i + 1).alias("line_no")))))
    hits = (files.select(F.col(path).alias("path"), F.explode(per_line).alias("x"))
            .groupBy(F.col("x.token").alias("name")).agg(F.min(F.struct("path", "x.line_no")).alias("at")))
    return idents.select("name").distinct().join(shuffled(hits), "name").select("name", "at.path", "at.line_no")


_DEFINE = r"\b(?:struct|class|enum|func|let|var)\s+(?=([A-Za-z_]\w*))"
_CALL = r"\b([A-Za-z_]\w*)\s*\("
_IDENT = r"[A-Za-z_]\w*"


def occurrences(files: DataFrame, symbols: DataFrame, keys: list[str], text: str = "text", code: bool = False) -> DataFrame:
    """(keys, name, line_no, role[, code]): lines that mention a symbol.

    Roles are read off the line itself, definition before call before
    reference, so no pattern is built per symbol. The line's text travels with
    every word only if ``code`` asks for it.
    """
    def on_line(line: Column, i: Column) -> Column:
        defined = F.regexp_extract_all(line, F.lit(_DEFINE), F.lit(1))
        called = F.regexp_extract_all(line, F.lit(_CALL), F.lit(1))
        names = F.array_distinct(F.regexp_extract_all(line, F.lit(_IDENT), F.lit(0)))
        return F.transform(names, lambda n: F.struct(
            n.alias("name"), (i + 1).alias("line_no"),
            F.when(F.array_contains(defined, n), "definition").when(F.array_contains(called, n), "call")
            .otherwise("reference").alias("role"), *([F.trim(line).alias("code")] if code else [])))

    found = files.select(*keys, F.explode(F.flatten(F.transform(F.split(text, "\n"), on_line))).alias("x")).select(*keys, "x.*")
    wanted = symbols.select("name").distinct()
    return salted_join(found, wanted, "name", F.struct(*keys, "line_no"), "left_semi")


def body_refs(bodies: DataFrame, symbols: DataFrame, keys: list[str], body: str = "body", limit: int | None = None) -> DataFrame:
    """(keys, refs): the other symbols mentioned in a body, in symbol order; only the first ``limit`` if one is given.

    ``symbols`` has (name, ordinal); ``bodies`` has the keys, ``name`` and the text.
    """
    order = symbols.groupBy(F.col("name").alias("token")).agg(F.min("ordinal").alias("ordinal"))
    mentioned = (bodies.select(*keys, "name", F.explode(F.array_distinct(words(body))).alias("token"))
                 .where("token <> name"))
    hits = salted_join(mentioned, order, "token", F.struct(*keys))
    rank = Window.partitionBy(*keys).orderBy("ordinal", "token")
    ranked = hits.withColumn("rn", F.row_number().over(rank))
    return ((ranked if limit is None else ranked.where(F.col("rn") <= limit))
            .groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("rn", "token"))).alias("_r"))
            .select(*keys, F.transform("_r", lambda r: r["token"]).alias("refs")))


MORE = "\n... [truncated]"


def snippets(files: DataFrame, hits: DataFrame, key: str, text: str = "text", context: int = 30,
             max_chars: int | None = None) -> DataFrame:
    """(name, key, start_line, end_line, snippet) around the hit line of each name, cut only if ``max_chars`` is given.

    ``hits`` has (name, key, line_no) with each name once. Hits are gathered
    per file, at most one per word of the file, and the lines are sliced in
    the file's row.
    """
    per_file = hits.groupBy(key).agg(F.collect_list(F.struct("name", "line_no")).alias("_hits"))
    cut = files.select(key, F.col(text).alias("_text")).join(per_file, key)
    cut = hold(cut, "_lines", F.split("_text", "\n"))

    def one(hit: Column) -> Column:
        start = F.greatest(hit["line_no"] - context, F.lit(1))
        end = F.least(hit["line_no"] + context, F.size("_lines"))
        whole = F.array_join(F.slice("_lines", start, end - start + 1), "\n")
        shown = whole if max_chars is None else F.when(
            F.length(whole) > max_chars, F.concat(F.substring(whole, 1, max_chars), F.lit(MORE))).otherwise(whole)
        return F.struct(hit["name"].alias("name"), start.alias("start_line"), end.alias("end_line"), shown.alias("snippet"))

    return (cut.select(key, F.explode(F.transform("_hits", one)).alias("s"))
            .select("s.name", key, "s.start_line", "s.end_line", "s.snippet"))


def infer_kind(text: ColumnLike, name: str) -> Column:
    """Kind of ``name`` (a column name) by the first declaration form found in the text."""
    c = as_col(text)
    out = None
    for kind, words_ in [("method", "func"), ("variable", "(?:let|var)"), ("struct", "struct"), ("class", "class"),
                         ("enum", "enum"), ("extension", "extension")]:
        declared = F.array_contains(
            F.regexp_extract_all(c, F.lit(rf"\b{words_}\s+(?=([A-Za-z_]\w*))"), F.lit(1)), F.col(name))
        out = F.when(declared, kind) if out is None else out.when(declared, kind)
    return out.otherwise("unknown")

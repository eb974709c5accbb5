"""Review records for candidate names: declaration sites, payloads, scoring hook."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symloom.functions import names as nm
from symloom.functions.text import _brace_span
from symloom.operators.lexical import symbols as file_symbols
from symloom.operators.mapping import closest_symbol
from symloom.operators.tokens import first_file, occurrences
from symloom.session import cut_lineage, shuffled

# The wording of a review record.
INSTRUCTION = ("In the following Swift code, find all identifiers related to sensitive logic. "
               "Provide the names and reasoning as a JSON object.")
ANSWER = '{\n  "is_sensitive": true|false,\n  "reasoning": "<explanation>"\n}'


def declaration_sites(idents: DataFrame, files: DataFrame, path: str, text: str = "text") -> DataFrame:
    """(name, path, decl_line): in the first file with the name, the line that
    declares it, else that of its closest symbol, else null.

    The corpus is tokenized once for the first files; that small result is
    written down, and the later steps read only the files it names.
    """
    first = cut_lineage(first_file(idents, files, path, text).select("name", "path"))
    kept = (files.select(F.col(path).alias("path"), F.col(text).alias("text"))
            .join(shuffled(first.select("path").distinct()), "path", "left_semi"))
    syms = cut_lineage(file_symbols(kept, "swift", "text", ["path"]))
    near = closest_symbol(first.select("path", F.col("name").alias("ident")), syms, ["path"])
    wanted = first.join(shuffled(near.select("path", F.col("ident").alias("name"), nm.basename("symbol").alias("alias"))), ["path", "name"], "left")
    wanted = cut_lineage(wanted)
    lookups = wanted.select(F.explode(F.array("name", "alias")).alias("name")).where("name is not null")
    defs = cut_lineage(occurrences(kept, lookups, ["path"], "text").where("role = 'definition'")
            .groupBy("path", "name").agg(F.min("line_no").alias("line")))
    own = wanted.join(shuffled(defs.withColumnRenamed("line", "own_line")), ["path", "name"], "left")
    alias = defs.select("path", F.col("name").alias("alias"), F.col("line").alias("alias_line"))
    return own.join(shuffled(alias), ["path", "alias"], "left").select("name", "path", F.coalesce("own_line", "alias_line").alias("decl_line"))


# What a record may say about a symbol, in this order.
SYMBOL_FIELDS = ["symbolName", "symbolKind", "typeSignature", "references", "calls_out", "conforms"]
SYMBOL_LISTS = ["references", "calls_out", "conforms"]


def _json_string(text: Column) -> Column:
    """A JSON string, quotes included."""
    return F.regexp_extract(F.to_json(F.struct(text.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)


def symbol_json(columns: list[str]) -> Column:
    """The symbol as JSON indented by two, from those of the fields that are columns and not null."""
    def field(name: str) -> Column:
        if name in SYMBOL_LISTS:
            items = F.array_join(F.transform(name, lambda v: F.concat(F.lit("    "), _json_string(v))), ",\n")
            value = F.when(F.size(name) == 0, "[]").otherwise(F.concat(F.lit("[\n"), items, F.lit("\n  ]")))
        else:
            value = _json_string(F.col(name))
        return F.when(F.col(name).isNotNull(), F.concat(F.lit(f'  "{name}": '), value))

    present = F.array_compact(F.array(*[field(n) for n in SYMBOL_FIELDS if n in columns]))
    return F.when(F.size(present) == 0, "{}").otherwise(F.concat(F.lit("{\n"), F.array_join(present, ",\n"), F.lit("\n}")))


def payloads(sites: DataFrame) -> DataFrame:
    """Add ``payload``: one JSON record per row from ``code``, ``name`` and ``kind``, or from more of the symbol's fields if there are such columns."""
    named = sites
    for own, given in (("symbolName", "name"), ("symbolKind", "kind")):
        if own not in sites.columns:
            named = named.withColumn(own, F.col(given))
    body = F.concat(F.lit("**Swift Source Code:**\n```swift\n"), F.rtrim("code"), F.lit("\n```\n\n**AST Symbol Information (Target: `"),
                    "name", F.lit("`):**\n```json\n"), symbol_json(named.columns), F.lit("\n```\n\n**Target Identifier:** `"), "name", F.lit("`"))
    return named.withColumn("payload", F.to_json(F.struct(
        F.lit(INSTRUCTION).alias("instruction"), body.alias("input"), F.lit(ANSWER).alias("output")))).select(*sites.columns, "payload")


Scorer = Callable[[str, str, str], str]


def score_candidates(df: DataFrame, scorer: Scorer) -> DataFrame:
    """(name, exclude, reason) from a caller's scorer(name, snippet, symbol) -> text.

    The first JSON object of the answer is read; without an ``exclude`` key the
    name is excluded. No scorer is shipped.
    """
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for name, snippet, symbol in zip(part["name"], part["snippet"], part["symbol"]):
                found = _brace_span(scorer(name, snippet, symbol))
                answer = json.loads(found) if found else {}
                rows.append((name, bool(answer.get("exclude", True)), str(answer.get("reason", ""))))
            yield pd.DataFrame(rows, columns=["name", "exclude", "reason"])

    return df.select("name", "snippet", "symbol").mapInPandas(run, "name string, exclude boolean, reason string")

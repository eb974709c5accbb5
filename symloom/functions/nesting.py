"""Nesting inside one text. Matching braces needs a stack, so these small Arrow
UDFs do just that, on brace strings and line counters; text stays in the JVM."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_INTS = T.ArrayType(T.IntegerType())
_PAIRS = T.StructType([T.StructField("partner", _INTS), T.StructField("depth", _INTS)])
_SCOPES = T.StructType([T.StructField("depth", _INTS), T.StructField("path", T.ArrayType(T.StringType())),
                        T.StructField("end", _INTS)])


@F.pandas_udf(_PAIRS)
def match_braces(braces: pd.Series) -> pd.DataFrame:
    """For every brace of a string like ``{{}}``: its partner (or -1) and the depth after it; none of a null."""
    def pair(text: str | None) -> tuple[list[int], list[int]]:
        text = text or ""
        partner, depth, open_at = [-1] * len(text), [0] * len(text), []
        for i, ch in enumerate(text):
            if ch == "{":
                open_at.append(i)
            elif open_at:
                j = open_at.pop()
                partner[i], partner[j] = j, i
            depth[i] = len(open_at)
        return partner, depth

    pairs = [pair(text) for text in braces]
    return pd.DataFrame({"partner": [p for p, _ in pairs], "depth": [d for _, d in pairs]})


def _walk_scopes(up, down, header, wait: bool) -> tuple[list[int], list[str], list[int]]:
    if up is None:
        return [], [], []
    depth, stack = 0, []
    depths, paths, ends = [], [], [-1] * len(up)
    for i in range(len(up)):
        if header[i]:
            stack.append([i, depth, not wait])
        depths.append(depth)
        paths.append(",".join(str(scope[0]) for scope in stack))
        if up[i] and stack and not stack[-1][2]:
            stack[-1][2] = True
        depth += int(up[i]) - int(down[i])
        while stack and (depth < stack[-1][1] or (stack[-1][2] and depth <= stack[-1][1])):
            at, _, opened = stack.pop()
            if opened:
                ends[at] = i
    return depths, paths, ends


def _scopes(wait: bool):
    @F.pandas_udf(_SCOPES)
    def scopes(opens: pd.Series, closes: pd.Series, is_header: pd.Series) -> pd.DataFrame:
        rows = [_walk_scopes(*row, wait) for row in zip(opens, closes, is_header)]
        return pd.DataFrame({"depth": [r[0] for r in rows], "path": [r[1] for r in rows], "end": [r[2] for r in rows]})
    return scopes


@F.pandas_udf(T.ArrayType(T.StringType()))
def open_parens(parens: pd.Series) -> pd.Series:
    """Per line, given as its parentheses only: those open at its start, outermost first, as ``line:which`` with commas between."""
    def paths(lines) -> list[str] | None:
        if lines is None:
            return None
        open_, out = [], []
        for i, marks in enumerate(lines):
            out.append(",".join(open_))
            for k, mark in enumerate(marks):
                if mark == "(":
                    open_.append(f"{i}:{k}")
                elif open_:
                    open_.pop()
        return out

    return parens.map(paths)


# Per line: brace depth before it, indexes of the headers open on it, and for a
# header the index of its last line. A type header ends after the first line
# whose depth falls back to its own; a function header first waits for its brace.
type_scopes = _scopes(wait=False)
function_scopes = _scopes(wait=True)


def brace_pieces(text: Column) -> tuple[Column, Column]:
    """Text between braces, and the braces as one string."""
    return F.split(text, r"[{}]"), F.regexp_replace(text, r"(?s)[^{}]+", "")

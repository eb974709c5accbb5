"""Text to rows: lines, identifiers, declarations, literals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symloom.functions import grammar as g, names, text as tx
from symloom.functions.nesting import brace_pieces, match_braces
from symloom.session import hold

NAME = r"[A-Za-z_][A-Za-z0-9_]*"

# (kind, pattern, group) per language profile.
IDENTIFIER_PATTERNS = {
    "swift": [
        ("type", rf"\b(?:class|struct|enum|protocol|actor|extension)\s+({NAME})", 1),
        ("function", rf"\bfunc\s+({NAME})", 1),
        ("variable", rf"\b(?:var|let)\s+({NAME})", 1),
        ("typealias", rf"\btypealias\s+({NAME})", 1),
    ],
    "markup": [
        ("element", r"<([a-z][a-z0-9]*)", 1),
        ("call", rf"\b({NAME})\([0-9]+\)", 1),
        ("variable", rf"\bvar\s+({NAME})", 1),
    ],
}
SYMBOL_PATTERNS = {
    "swift": [
        ("struct", rf"\bstruct\s+({NAME})", 1),
        ("class", rf"\bclass\s+({NAME})", 1),
        ("enum", rf"\benum\s+({NAME})", 1),
        ("method", rf"\bfunc\s+({NAME}(?:\([^)]*\))?)", 1),
        ("variable", rf"\b(?:let|var)\s+({NAME})", 1),
    ],
    "markup": [
        ("element", r"<([a-z][a-z0-9]*)", 1),
        ("class", r'class="([^"]+)"', 1),
        ("method", rf"\b({NAME}\([^)]*\))", 1),
        ("variable", rf"\bvar\s+({NAME})", 1),
    ],
}


def _extract(patterns: list[tuple[str, str, int]], text: Column) -> Column:
    """One array of (kind, name) for all patterns, so the text is read once."""
    def tagged(kind: str, pattern: str, group: int) -> Column:
        return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)),
                           lambda n: F.struct(F.lit(kind).alias("kind"), n.alias("name")))

    return F.flatten(F.array(*[tagged(*p) for p in patterns]))


def lines(files: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    kept = keep or [c for c in files.columns if c != text]
    return (files.select(*kept, F.posexplode(F.split(text, "\n")).alias("pos", "line"))
            .withColumn("line_no", F.col("pos") + 1).drop("pos"))


def identifiers(files: DataFrame, profile: str, text: str = "text") -> DataFrame:
    """Distinct declared names of the corpus."""
    return (files.select(F.explode(F.array_distinct(_extract(IDENTIFIER_PATTERNS[profile], F.col(text)))).alias("x"))
            .select("x.name").where("name <> ''").distinct())


def symbols(files: DataFrame, profile: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(kind, name) once per file."""
    kept = keep or [c for c in files.columns if c != text]
    found = F.array_distinct(_extract(SYMBOL_PATTERNS[profile], F.col(text)))
    return files.select(*kept, F.posexplode(found).alias("ordinal", "x")).select(*kept, "ordinal", "x.kind", "x.name")


def imports(files: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """First path component of every import, once per file."""
    kept = keep or [c for c in files.columns if c != text]
    clean = tx.blank_comments(F.col(text))
    found = F.regexp_extract_all(
        clean, F.lit(rf"(?m)^\s*(?:@\w+\s+)*import\s+(?:(?:class|struct|enum|protocol|func|var|let|typealias)\s+)?({NAME})"), F.lit(1))
    return files.select(*kept, F.explode(F.array_distinct(found)).alias("module"))


def aliases(files: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Type aliases; protocols are listed only for ``A & B`` compositions."""
    kept = keep or [c for c in files.columns if c != text]
    clean = tx.blank_comments(F.col(text))
    found = F.regexp_extract_all(clean, F.lit(rf"\btypealias\s+{NAME}[^=\n]*=[^\n]+"), F.lit(0))
    decl = F.col("decl")
    target = F.regexp_extract(decl, r"=\s*(.+?)\s*$", 1)
    parts = F.filter(F.transform(F.split(target, "&"), lambda x: F.trim(x)), lambda p: p != "")
    return (files.select(*kept, F.explode(found).alias("decl"))
            .select(*kept, F.regexp_extract(decl, rf"\btypealias\s+({NAME})", 1).alias("alias"),
                    F.when(target.contains("&"), parts).otherwise(F.array().cast("array<string>")).alias("protocols")))


ACCESS_LEVELS = ["open", "public", "internal", "fileprivate", "private"]
_ATTRS = r"((?:@[\w:.]+(?:\([^)\n]*\))?\s*)*)"
_MODS = r"((?:\w+(?:\(set\))?\s+)*?)"
_KEYWORDS = r"\b(?:class|struct|enum|protocol|actor|extension|func|var|let|init|deinit|typealias)\b|^\s*(?:indirect\s+)?case\s"
_DECLARATION = (rf"^\s*{_ATTRS}{_MODS}(class|struct|enum|protocol|actor|extension|func|var|let|init|deinit|typealias)"
                rf"\b\s*([A-Za-z_`][\w.`]*)?(.*)$")


def declaration_columns(parts: Column) -> dict[str, Column]:
    """Columns of the declaration whose pattern groups are ``parts`` (name is empty where there is none)."""
    def part(i: int) -> Column:
        return F.get(parts, F.lit(i - 1))

    keyword, mods, rest = part(3), F.split(F.trim(part(2)), r"\s+"), part(5)
    attrs = F.regexp_extract_all(part(1), F.lit(r"@([\w:.]+)"), F.lit(1))
    other = F.filter(mods, lambda m: ~m.isin(*ACCESS_LEVELS, ""))
    is_type = keyword.isin("class", "struct", "enum", "protocol", "actor", "extension")
    clause = F.regexp_extract(rest, r"^\s*(?:<[^>]*>)?\s*:\s*([^{]*?)\s*(?:\bwhere\b.*|\{.*)?$", 1)
    adopted = F.filter(F.transform(F.split(clause, ","), lambda t: F.trim(F.substring_index(t, "<", 1))),
                       lambda t: t != "")
    listed = r"^\s*(?:<[^>]*>)?\s*\(((?:[^()]|\([^()]*\))*)\)(.*)$"
    params, tail = F.regexp_extract(rest, listed, 1), F.regexp_extract(rest, listed, 2)
    types = F.transform(F.filter(names.split_params(params), lambda p: F.trim(p) != ""),
                        lambda p: F.trim(F.regexp_replace(F.regexp_replace(p, r"\s=\s.*$", ""), r"^[^:]*:", "")))
    empty = F.array().cast("array<string>")
    is_func = keyword.isin("func", "init")
    return {
        "name": F.when(keyword.isin("init", "deinit"), keyword).otherwise(part(4)),
        "kind": F.when(is_func | (keyword == "deinit"), "function")
                 .when(keyword.isin("var", "let"), "variable").otherwise(keyword),
        "access": F.coalesce(F.get(F.filter(mods, lambda m: m.isin(ACCESS_LEVELS)), F.lit(0)), F.lit("internal")),
        "attributes": F.concat(attrs, other),
        "adopted": F.when(is_type, adopted).otherwise(empty),
        "initial_value": F.when(keyword.isin("var", "let"), F.nullif(
            F.regexp_extract(rest, r'^[^={]*=\s*("(?:\\.|[^"\\])*"[^;]*?|[^;]*?)\s*(?:;.*)?$', 1), F.lit(""))),
        "params": F.when(is_func, names.param_labels(params)).otherwise(empty),
        "param_types": F.when(is_func, types).otherwise(empty),
        "return_type": F.when(is_func, F.nullif(F.regexp_extract(tail, r"^[^{]*?->\s*([^{]*?)\s*(?:\{.*)?$", 1), F.lit(""))),
    }


_CASE = r'[a-z_]\w*(?:\([^)\n]*\))?(?:\s*=\s*(?:"[^"\n]*"|[\w.]+))?'


def _payload(case: Column) -> tuple[Column, Column]:
    """Labels (``_`` without one) and types of a case's associated values."""
    items = F.filter(F.transform(names.split_params(F.regexp_extract(case, r"\((.*)\)", 1)), lambda x: F.trim(x)), lambda p: p != "")
    return (F.transform(items, lambda p: F.when(p.contains(":"), F.trim(F.substring_index(p, ":", 1))).otherwise("_")),
            F.transform(items, lambda p: F.trim(F.regexp_replace(p, r"^[^:]*:", ""))))


def _case_nodes(listed: Column) -> Column:
    empty = F.array().cast("array<string>")

    def node(raw: Column) -> Column:
        case = F.trim(raw)
        labels, types = _payload(case)
        none = F.lit(None).cast("string")
        return F.struct(
            F.regexp_extract(case, rf"^({NAME})", 1).alias("name"), F.lit("case").alias("kind"), F.lit("internal").alias("access"),
            empty.alias("attributes"), empty.alias("adopted"), F.nullif(F.regexp_extract(case, r"=\s*(.*)$", 1), F.lit("")).alias("initial_value"),
            labels.alias("params"), types.alias("param_types"), none.alias("return_type"))

    return F.transform(names.split_params(listed), node)


def declarations(files: DataFrame, text: str = "text") -> DataFrame:
    """Declaration nodes of code files, one row per declaration or enum case.

    Attributes on lines of their own belong to the next declaration. The
    parent is the innermost type or function whose braces enclose the line.
    """
    from symloom.operators.scopes import line_scopes

    scoped = line_scopes(files.withColumn(text, tx.blank_comments(F.col(text))), text, _KEYWORDS)
    scoped = hold(scoped.where(~F.col("line").rlike(r"^\s*(?:@\w+\s+)*import\b")), "_d", tx.groups("line", _DECLARATION, 5))
    cols = declaration_columns(F.col("_d"))
    shared = [c for c in scoped.columns if c != "_d"]
    one = F.array(F.struct(*[c.alias(n) for n, c in cols.items()]))
    in_enum = (F.col("_parent.kind") == "enum") & (F.col("depth") == F.col("type_depth") + 1)
    many = F.when(in_enum, _case_nodes(F.regexp_extract("line", rf"^\s*(?:indirect\s+)?case\s+({_CASE}(?:\s*,\s*{_CASE})*)", 1)))
    rows = (scoped.select(*shared, F.explode(F.when(F.col("_d").isNotNull(), one).otherwise(many)).alias("n"))
            .select(*shared, "n.*").where("name <> ''"))
    node_id = F.xxhash64("project", "rel_path", "line_no", F.col("col"), "kind", "name")
    # The parent's id follows from its header line, so no join is needed to find it.
    head = rf"^(\s*).*?\b(class|struct|enum|protocol|actor|extension)\s+([A-Za-z_`][\w.`]*)"
    part = lambda i: F.regexp_extract("_head.s", head, i)
    parent_id = F.when(F.col("_head").isNotNull(), F.xxhash64(
        "project", "rel_path", F.col("_head.no"), F.length(part(1)) + 1, part(2), part(3)))
    return (rows.withColumn("attributes", F.concat("carried_attrs", "attributes"))
            .withColumn("col", F.when(F.col("kind") == "case", F.position(F.col("name"), F.col("line")))
                        .otherwise(F.length(F.regexp_extract("line", r"^(\s*)", 1)) + 1))
            .select("project", "file_id", "rel_path", node_id.alias("node_id"), parent_id.alias("parent_id"), "name", "kind", "access",
                    "attributes", "adopted",
                    F.struct(F.col("rel_path").alias("file"), F.col("line_no").alias("line"), "col").alias("loc"),
                    "initial_value", "params", "param_types", "return_type",
                    "parent_type", "parent_depth", "depth"))


def variables(files: DataFrame, profile: str = "swift", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """One row per binding with its initial value."""
    kept = keep or [c for c in files.columns if c != text]
    if profile == "markup":
        pattern = rf'\bvar\s+({NAME})\s*=\s*("[^"]*"|[^;"]*)'
        found = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))
        return (files.select(*kept, F.explode(found).alias("d"))
                .select(*kept, F.regexp_extract("d", pattern, 1).alias("name"),
                        F.trim(F.regexp_extract("d", pattern, 2)).alias("initial_value")))
    clean = tx.blank_comments(F.col(text))
    # What a condition or a pattern binds is no variable; it is matched with the word or comma before it, and left out.
    bound = F.regexp_extract_all(clean, F.lit(r"(?:\b(?:if|guard|while|case|catch)\s+|,\s*)?\b(?:var|let)\s+[^\n{;]*[^\n{;,\s]"), F.lit(0))
    statements = F.transform(F.filter(bound, lambda b: b.rlike(r"^(?:var|let)\s")), lambda b: F.regexp_replace(b, r"^\w+\s+", ""))
    binding = F.trim("b")
    return (files.select(*kept, F.explode(statements).alias("s"))
            .select(*kept, F.explode(names.split_params("s")).alias("b"))
            .select(*kept, F.regexp_extract(binding, rf"^({NAME})", 1).alias("name"),
                    F.nullif(F.regexp_extract(binding, r"^[^=]*=\s*(.*)$", 1), F.lit("")).alias("initial_value"))
            .where("name <> ''"))


def enum_cases(files: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Enum cases with labels and types of associated values (``_`` without a label)."""
    kept = keep or [c for c in files.columns if c != text]
    clean = tx.blank_comments(F.col(text))
    found = F.regexp_extract_all(clean, F.lit(rf"(?m)(?:^|[{{;])\s*(?:indirect\s+)?case\s+({_CASE}(?:\s*,\s*{_CASE})*)"), F.lit(1))
    case = F.trim("c")
    labels, types = _payload(case)
    return (files.select(*kept, F.explode(found).alias("s"))
            .select(*kept, F.explode(names.split_params("s")).alias("c"))
            .select(*kept, F.regexp_extract(case, rf"^({NAME})", 1).alias("name"),
                    labels.alias("labels"), types.alias("types"))
            .where("name <> ''"))


LITERAL = {
    "markup": r'"[^"<>]*"',
    "swift": r'"(?:\\.|[^"\\\n])*"',
}


def literals(files: DataFrame, profile: str = "swift", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """One row per quoted literal with its line and the text before it on that line."""
    kept = keep or [c for c in files.columns if c != text]
    pattern = LITERAL[profile]
    rows = lines(files, text, kept).where(F.col("line").contains('"'))
    values = F.regexp_extract_all("line", F.lit(pattern), F.lit(0))
    found = F.transform(F.arrays_zip(values.alias("value"), F.split("line", pattern).alias("before")), lambda z: z)
    return (rows.select(*kept, "line_no", "line", F.posexplode(found).alias("ordinal", "z"))
            .select(*kept, "line_no", "line", "ordinal", "z.value", "z.before").where("value is not null"))


def text_literals(files: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Literals of whole texts, three-quote ones included, with the starting line.

    Every quote is first tagged with its line number, so a literal carries its
    line along and no prefix has to be counted.
    """
    kept = keep or [c for c in files.columns if c != text]
    tag = "\u0001[0-9]+\u0002"
    tagged = F.array_join(F.transform(F.split(text, "\n"), lambda l, i: F.replace(
        l, F.lit('"'), F.concat(F.lit("\u0001"), (i + 1).cast("string"), F.lit("\u0002\"")))), "\n")
    q = tag + '"'
    inner = rf'\\(?:{tag})?.|[^"\\\u0001]'
    pattern = rf'(?s){q}{q}{q}(?:{inner}|{q}(?!{q}{q}))*?{q}{q}{q}|{q}(?:{inner})*{q}'
    return (files.select(*kept, F.posexplode(F.regexp_extract_all(tagged, F.lit(pattern), F.lit(0))).alias("ordinal", "v"))
            .select(*kept, "ordinal", F.regexp_replace("v", tag, "").alias("value"),
                    F.regexp_extract("v", "^\u0001([0-9]+)", 1).cast("int").alias("line_no")))


def underscore_names(files: DataFrame, text: str = "text") -> DataFrame:
    """(role, name): names after ``_``, and those declared as ``let _x`` / ``var _x``."""
    found = _extract([("use", r"_([A-Za-z0-9_]\w*)", 1), ("declared", r"\blet\s+_([A-Za-z]\w*)", 1),
                      ("declared", r"\bvar\s+_([A-Za-z]\w*)", 1)], F.col(text))
    return (files.select(F.explode(F.array_distinct(found)).alias("x"))
            .select(F.col("x.kind").alias("role"), "x.name").distinct())


def wrapper_candidates(files: DataFrame, text: str = "text") -> DataFrame:
    """Names used after ``_`` that are nowhere declared with it; one aggregate, no set join."""
    return (underscore_names(files, text).groupBy("name")
            .agg(F.bool_or(F.col("role") == "declared").alias("declared"))
            .where("not declared").select("name"))


def blocks(files: DataFrame, kinds: list[str], text: str = "text", keep: list[str] | None = None,
           parts: tuple[str, ...] = ("body", "outer", "outer_lines")) -> DataFrame:
    """Balanced ``kind name … { body }`` blocks: kind, name, ordinal and the wanted parts.

    The text is cut at its braces; a piece that ends in a header starts a
    block, and the partner of its brace ends it. ``outer`` is the body with
    every nested block reduced to ``{}``; ``outer_lines`` keeps what stands on
    the line of a nested block's opening brace.
    """
    kept = [c for c in files.columns if c != text] if keep is None else keep
    header = rf"(?s).*\b({'|'.join(kinds)})\s+({NAME})\b[^\\]*$"
    pieces, braces = brace_pieces(F.col("_text"))
    cut = hold(files.select(*kept, F.col(text).alias("_text")), "_x", F.struct(pieces.alias("p"), braces.alias("b")))
    cut = cut.select(*kept, F.col("_x.p").alias("_p"), F.col("_x.b").alias("_b"), match_braces("_x.b").alias("_m"))

    def inside(at: Column, end: Column) -> Column:
        return F.transform(F.slice("_p", at + 2, end - at), lambda p, k: F.struct(
            p.alias("p"), F.substring(F.col("_b"), at + k + 1, F.lit(1)).alias("b"),
            F.get(F.col("_m.depth"), at + k).alias("d"), k.alias("k")))

    def block(partner: Column, at: Column) -> Column:
        head = F.get("_p", at)
        cuts = inside(at, partner)
        level = F.get(F.col("_m.depth"), at)
        body = F.array_join(F.transform(cuts, lambda z: F.concat(F.when(z["k"] > 0, z["b"]).otherwise(""), z["p"])), "")
        outer = F.array_join(F.transform(F.filter(cuts, lambda z: z["d"] == level),
                                         lambda z: F.concat(F.when(z["k"] > 0, "{}").otherwise(""), z["p"])), "")
        first_lines = F.array_join(F.transform(
            F.filter(cuts, lambda z: (z["d"] == level) | ((z["d"] == level + 1) & (z["b"] == "{") & (z["k"] > 0))),
            lambda z: F.when(z["d"] > level, F.concat(F.lit("{"), F.substring_index(z["p"], "\n", 1)))
            .otherwise(F.concat(F.when(z["k"] > 0, "}").otherwise(""), z["p"]))), "")
        found = (partner > at) & head.rlike(header)
        return F.when(found, F.struct(
            F.regexp_extract(head, header, 1).alias("kind"), F.regexp_extract(head, header, 2).alias("name"),
            at.alias("ordinal"), *[{"body": body, "outer": outer, "outer_lines": first_lines}[p].alias(p) for p in parts]))

    found = F.filter(F.transform("_m.partner", block), lambda b: b.isNotNull())
    return cut.select(*kept, F.explode(found).alias("b")).select(*kept, "b.*")


FUNC_LINE = rf"(?m)^{g.SAME_LINE}({g.function_head()}[^\n]*)"


def top_level_funcs(block_rows: DataFrame) -> DataFrame:
    """Functions declared directly in a block: func_line, mods, func, params_src."""
    kept = [c for c in block_rows.columns if c not in ("body", "outer", "outer_lines")]
    return _func_rows(block_rows, "outer_lines", kept)


def all_funcs(block_rows: DataFrame) -> DataFrame:
    """Functions anywhere in a block."""
    kept = [c for c in block_rows.columns if c not in ("body", "outer", "outer_lines")]
    return _func_rows(block_rows, "body", kept)


def _func_rows(df: DataFrame, column: str, kept: list[str]) -> DataFrame:
    one = "(?s)^" + g.function_head(rf"({g.MODIFIERS})", r"(\w+)", rf"({g.PARAMETERS})")
    found = F.regexp_extract_all(F.col(column), F.lit(FUNC_LINE), F.lit(1))
    return (df.select(*kept, F.explode(found).alias("func_line"))
            .select("*", F.trim(F.regexp_extract("func_line", one, 1)).alias("mods"),
                    F.regexp_extract("func_line", one, 2).alias("func"),
                    F.regexp_extract("func_line", one, 3).alias("params_src")))

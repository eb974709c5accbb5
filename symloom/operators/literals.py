"""String literals: why some must stay, which ones are kept, policy counts, encryption."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symloom.functions import names, text as tx
from symloom.functions.nesting import function_scopes, open_parens, type_scopes
from symloom.operators.lexical import LITERAL
from symloom.session import cut_lineage, hold, parts_for, shuffled

# Callees, labels and types whose string arguments must stay readable.
DEBUG_CALLEES = ["print", "NSLog", "debugPrint", "assert", "fatalError", "error", "info", "warning", "log", "debug",
                 "annotation", "preconditionFailure", "os_log"]
ID_LABELS = ["withIdentifier", "reuseIdentifier", "accessibilityIdentifier"]
ID_CALLEES = ["performSegue", "NSClassFromString", "NSSelectorFromString", "bundleFilePath"]
UI_MEMBERS = ["title", "message", "navigationTitle", "subtitle", "prompt", "label", "header", "footer", "caption",
              "hint", "placeholder", "titile", "alert"]
UI_LABELS = ["title", "message", "subtitle", "prompt", "label", "header", "footer", "caption", "hint", "placeholder",
             "name", "description"]
UI_TYPES = ["Text", "Image", "DisplayRepresentation", "TypeDisplayRepresentation", "LocalizedStringResource", "URL"]
RESOURCE_TYPES = ["LocalizedStringKey", "LocalizedStringResource", "TypeDisplayRepresentation", "DisplayRepresentation"]
CONTAINERS = ["vstack", "hstack", "zstack", "lazyvstack", "lazyhstack", "lazyvgrid", "lazyhgrid", "grid", "list",
              "section", "form", "group", "scrollview", "navigationstack", "navigationview", "tabview"]


def _or(words: list[str]) -> str:
    return "(?:" + "|".join(words) + ")"


_OPEN_ARGS = r"\s*\([^()]*$"
_SOME_VIEW = r"(?:->|:)\s*some\s+(?:\w+\.)*View\b"
_CONTAINER = rf"(?i)\b{_or(CONTAINERS)}\b[^{{}}]*\{{"
_SCOPE = rf"\bfunc\s+\w+|{_SOME_VIEW}|{_CONTAINER}"
_TYPE = r"^\s*(?:@[\w:]+(?:\([^)]*\))?\s*)*(?:\w+\s+)*(?:class|struct|enum|actor|extension|protocol)\s+\w+"


def without_closed_calls(text: Column) -> Column:
    """``text`` without the arguments of calls that it closes, nested to any depth: what stands before each bracket still open, and in it.

    The parts go along a stack with an entry per open bracket; a closing one
    drops the last entry, or stays in the text where none is open.
    """
    def put(stack: Column, part: Column) -> Column:
        outer, top = F.slice(stack, F.lit(1), F.size(stack) - 1), F.element_at(stack, -1)
        return (F.when(part == "(", F.concat(stack, F.array(F.lit(""))))
                .when((part == ")") & (F.size(stack) > 1), outer)
                .otherwise(F.concat(outer, F.array(F.concat(top, part)))))

    parts = F.regexp_extract_all(text, F.lit(r"[()]|[^()]+"), F.lit(0))
    return F.when(text.contains(")"), F.array_join(F.aggregate(parts, F.array(F.lit("")), put), "(")).otherwise(text)


def swift_reasons(value: Column, before: Column, line: Column, scopes: Column, main_type: Column, at_top: Column) -> Column:
    """Array of the reasons why a literal must stay, from its line and enclosing headers."""
    inner = F.trim(names.unquote(value))
    checks = {
        "debug": before.rlike(rf"(?:^|[^\w]){_or(DEBUG_CALLEES)}{_OPEN_ARGS}"),
        "attribute": before.rlike(r"@\w+\([^()]*$"),
        "entrypoint": F.exists(scopes, lambda s: (main_type & s.rlike(r"\bfunc\s+main\b"))
                               | s.rlike(r"\bfunc\s+application\s*\([^,]*,\s*\w+\s+didFinishLaunchingWithOptions|"
                                         r"\bfunc\s+application\s*\([^,]*,\s*didFinishLaunchingWithOptions")),
        "global": at_top & line.rlike(r"^\s*(?:@\w+\s+)*(?:\w+\s+)*(?:let|var)\b[^=]*="),
        "identifier": before.rlike(rf"\b{_or(ID_LABELS)}\s*:\s*$|\b{_or(ID_CALLEES)}{_OPEN_ARGS}|"
                                   r"\.(?:reuseIdentifier|accessibilityIdentifier)\s*=\s*$"),
        "localized": before.rlike(rf"\b(?:NSLocalizedString|localized){_OPEN_ARGS}|\b(?:localized|key)\s*:\s*$"),
        "ui_keylike": before.rlike(rf"\.{_or(UI_MEMBERS)}{_OPEN_ARGS}|\b{_or(UI_TYPES)}{_OPEN_ARGS}|"
                                   rf"\([^()]*\b{_or(UI_LABELS)}\s*:[^()]*$"),
        "interpolated": value.rlike(r"\\#*\("),
        "image_literal": before.rlike(r"#imageLiteral\([^()]*$"),
        "resource_like": before.rlike(rf":\s*(?:\[[^\]]*:\s*)?{_or(RESOURCE_TYPES)}\]?\s*=|\b{_or(RESOURCE_TYPES)}{_OPEN_ARGS}")
                         | line.rlike(rf"\bas\s+\[[^\]]*:\s*{_or(RESOURCE_TYPES)}\]"),
        "view_container": F.exists(scopes, lambda s: s.rlike(_SOME_VIEW) | s.rlike(_CONTAINER)) | before.rlike(
            rf"(?i)\b{_or(CONTAINERS)}{_OPEN_ARGS}"),
        "short_or_blank": F.length(inner) <= 1,
    }
    return F.filter(F.array(*[F.when(c, F.lit(r)) for r, c in checks.items()]), lambda r: r.isNotNull())


def markup_reasons(value: Column, before: Column) -> Column:
    """Reasons for markup: short text, identifying attributes, addresses."""
    checks = {
        "short_or_blank": F.length(F.trim(names.unquote(value))) <= 1,
        "identifier": before.rlike(r"\b(?:class|id|name)=$"),
        "resource_like": before.rlike(r"\b(?:href|src)=$"),
    }
    return F.filter(F.array(*[F.when(c, F.lit(r)) for r, c in checks.items()]), lambda r: r.isNotNull())


def literal_table(files: DataFrame, profile: str = "swift", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Literals with ``reasons`` of their own and ``line_reasons`` of their whole line.

    The reasons of a line are gathered in the line's row before literals are
    exploded, so dropping every literal of an affected line needs no join.
    """
    kept = keep or [c for c in files.columns if c != text]
    pattern = LITERAL[profile]

    def parts(line: Column) -> Column:
        return F.filter(F.transform(F.arrays_zip(
            F.regexp_extract_all(line, F.lit(pattern), F.lit(0)).alias("value"), F.split(line, pattern).alias("before")),
            lambda z, i: F.struct(i.alias("ordinal"), z["value"].alias("value"), F.coalesce(z["before"], F.lit("")).alias("before"))),
            lambda z: z["value"].isNotNull())

    if profile == "markup":
        rows = files.select(*kept, F.posexplode(F.split(text, "\n")).alias("i", "line")).where(F.col("line").contains('"'))
        rows = rows.withColumn("line_no", F.col("i") + 1).withColumn("_l", F.transform(parts(F.col("line")), lambda z: F.struct(
            z["ordinal"].alias("ordinal"), z["value"].alias("value"), markup_reasons(z["value"], z["before"]).alias("reasons"))))
    else:
        files = files.select(*kept, F.col(text))
        clean = F.split(tx.blank_comments(F.col(text)), "\n")
        z = F.col("_z")
        numbered = F.filter(F.transform(clean, lambda l, i: F.struct((i + 1).alias("no"), l.alias("s"))),
                            lambda x: x["s"].rlike(r'["{}()@]|\bfunc\b'))
        bare = F.transform(z, lambda x: F.regexp_replace(x["s"], pattern, '""'))
        ups, downs = F.transform(z, lambda x: F.regexp_count(x["s"], F.lit(r"\{"))), F.transform(z, lambda x: F.regexp_count(x["s"], F.lit(r"\}")))
        located = (hold(files, "_z", numbered).drop(text)
                   .withColumn("_f", function_scopes(ups, downs, F.transform(z, lambda x: x["s"].rlike(_SCOPE))))
                   .withColumn("_b", bare).withColumn("_p", open_parens(F.transform(bare, lambda b: F.regexp_replace(b, "[^()]", ""))))
                   .withColumn("_t", type_scopes(ups, downs, F.transform(z, lambda x: x["s"].rlike(_TYPE)))))

        def headers(path: Column) -> Column:
            return F.transform(F.filter(F.split(path, ","), lambda p: p != ""), lambda p: F.get("_z", p.cast("int"))["s"])

        def row(x: Column, i: Column) -> Column:
            scopes, type_path = headers(F.get("_f.path", i)), F.get("_t.path", i)
            main_type = F.exists(F.transform(F.filter(F.split(type_path, ","), lambda p: p != ""), lambda p: p.cast("int")), lambda p:
                                 F.get("_z", p)["s"].rlike(r"@main\b") | F.coalesce(F.get("_z", p - 1)["s"].rlike(r"^\s*@main\s*$"), F.lit(False)))
            at_top = (type_path == "") & (F.get("_f.path", i) == "")
            open_ = F.filter(F.split(F.get("_p", i), ","), lambda p: p != "")
            gaps = F.split(F.get("_b", i), '""')

            def before(p: Column) -> Column:
                """The line up to the literal, without closed calls, behind the callee of the call that is open there."""
                own = p["own"]
                up = F.size(open_) - F.regexp_count(own, F.lit(r"\)"))
                at = F.split(F.get(open_, up - 1), ":")
                callee = F.get(F.split(F.get("_b", F.get(at, F.lit(0)).cast("int")), "[()]"), F.get(at, F.lit(1)).cast("int"))
                return F.when(own.contains("(") | (up < 1), own).otherwise(F.concat(callee, F.lit("("), F.regexp_replace(own, r"^.*\)", "")))

            # One transform after the other, so that each value is computed once per literal.
            lits = F.transform(parts(x["s"]), lambda p: F.struct(p["ordinal"].alias("ordinal"), p["value"].alias("value"), without_closed_calls(
                F.array_join(F.slice(gaps, F.lit(1), p["ordinal"] + 1), '""')).alias("own")))
            lits = F.transform(lits, lambda p: F.struct(p["ordinal"].alias("ordinal"), p["value"].alias("value"), before(p).alias("before")))
            lits = F.transform(lits, lambda p: F.struct(
                p["ordinal"].alias("ordinal"), p["value"].alias("value"),
                swift_reasons(p["value"], p["before"], x["s"], scopes, main_type, at_top).alias("reasons")))
            return F.when(x["s"].contains('"'), F.struct(x["no"].alias("line_no"), x["s"].alias("line"), lits.alias("_l")))

        rows = (located.select(*kept, F.explode(F.filter(F.transform(z, row), lambda r: r.isNotNull())).alias("r"))
                .select(*kept, "r.*"))
    return (rows.withColumn("line_reasons", F.array_sort(F.array_distinct(F.flatten(F.transform("_l", lambda l: l["reasons"])))))
            .select(*kept, "line_no", "line_reasons", F.explode("_l").alias("l"))
            .select(*kept, "line_no", "l.ordinal", "l.value", "l.reasons", "line_reasons"))


def literal_reasons(literals: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, line_no, reason) once per line."""
    return literals.select(*keys, "line_no", F.explode("line_reasons").alias("reason")).distinct()


def keep_literals(literals: DataFrame) -> DataFrame:
    """Literals on lines without any exclusion."""
    return literals.where(F.size("line_reasons") == 0)


def literal_policy(policy: DataFrame) -> DataFrame:
    """(pattern, effect) for literal patterns; an exclusion wins over an inclusion."""
    rows = policy.where("category = 'encryption'").groupBy("pattern").agg(
        F.bool_or(F.col("section") == "include").alias("i"), F.bool_or(F.col("section") == "exclude").alias("e"))
    return rows.select("pattern", F.when(F.col("i") & F.col("e"), "conflict_excluded").when(F.col("e"), "excluded")
                       .otherwise("included").alias("effect"))


def literal_policy_report(literals: DataFrame, effects: DataFrame) -> DataFrame:
    """(value, finding, n): excluded occurrences, unused exclusions, blocked inclusions by reason.

    Occurrences are counted per value and reason before the small policy is
    joined in, so a value found everywhere is one row per task.
    """
    counts = (literals.select(names.unquote("value").alias("pattern"),
                              F.coalesce(F.get("line_reasons", F.lit(0)), F.lit("")).alias("reason"))
              .groupBy("pattern", "reason").agg(F.count("*").alias("n")))
    joined = effects.join(counts, "pattern", "left")
    excluded = joined.where("effect <> 'included'").groupBy("pattern").agg(
        F.coalesce(F.sum(F.when(F.col("reason") == "", F.col("n"))), F.lit(0)).alias("n"))
    included = joined.where("effect = 'included'")
    return (excluded.select("pattern", F.when(F.col("n") > 0, "excluded_occurrences").otherwise("unused_exclusion").alias("finding"), "n")
            .unionByName(included.where("n is null").select("pattern", F.lit("include_absent").alias("finding"), F.lit(0).cast("long").alias("n")))
            .unionByName(included.where("reason <> ''").select("pattern", F.concat(F.lit("blocked_"), "reason").alias("finding"), "n"))
            .unionByName(included.where("reason = ''").select("pattern", F.lit("encryptable").alias("finding"), "n")))


def rewrite_window(literals: DataFrame, hits: DataFrame, keys: list[str]) -> DataFrame:
    """Hits whose line is a literal's line or the one after it, with an equal value.

    Literals are written narrow and counted, so that tasks get a bounded number
    of them, however many there are; nothing is gathered to drop repeats.
    """
    lines = cut_lineage(literals.select(*keys, "value", "line_no"))
    allowed = lines.select(*keys, "value", F.explode(F.array("line_no", F.col("line_no") + 1)).alias("line_no"))
    on = [*keys, "value", "line_no"]
    parts = parts_for(lines.sparkSession, max(2 * lines.count(), hits.count()))
    return hits.repartition(parts, *on).join(shuffled(allowed.repartition(parts, *on)), on, "left_semi")


def encrypt_literals(literals: DataFrame, key: Column) -> DataFrame:
    """Add ``cipher``: base64 of nonce and AES-GCM text of the decoded literal."""
    plain = names.unescape(names.unquote("value"))
    return literals.withColumn("cipher", F.base64(F.aes_encrypt(F.encode(plain, "UTF-8"), key, F.lit("GCM"))))


def decrypt_literals(literals: DataFrame, key: Column) -> DataFrame:
    return literals.withColumn("plain", F.decode(F.aes_decrypt(F.unbase64("cipher"), key, F.lit("GCM")), "UTF-8"))

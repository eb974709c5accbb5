"""Format-preserving pseudonyms for personal numbers, dates and addresses, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symloom.session import hold

KEY = "symloom-demo-key"
ROUNDS = 6

# The length of an IBAN by country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR",
    27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU"}


def _iban() -> str:
    """Country, check digits and as many characters as the country has, in fours or not; other countries: any length."""
    def body(size: int) -> str:
        return f"(?: ?[A-Z0-9]{{4}}){{{size // 4}}}" + (f" ?[A-Z0-9]{{{size % 4}}}" if size % 4 else "")
    known = [f"(?:{names.replace(' ', '|')})[0-9]{{2}}{body(size - 4)}" for size, names in IBAN_LENGTHS.items()]
    others = f"(?!{'|'.join(' '.join(IBAN_LENGTHS.values()).split())})[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?"
    return f"(?:{'|'.join(known)}|{others})(?![\\p{{L}}\\p{{N}}])"


# What is looked for; the first that matches at a place takes it.
PATTERNS = {
    "email": r"[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)+",
    "iban": _iban(),
    "ipv4": r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![\p{L}\p{N}_])(?!\.[0-9])",
    "date": (r"(?<![0-9]/)(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4})"
             r"(?:(?=T[0-9]{2}:?[0-9]{2})|(?![\p{L}\p{N}_])(?![-/.][0-9]))"),
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\p{L}\p{N}_-])",
    "card": r"(?:[0-9]{13,19}|[0-9]{4}(?<first>[ -])[0-9]{4}\k<first>[0-9]{4}\k<first>[0-9]{1,7}|[0-9]{4}(?<other>[ -])[0-9]{6}\k<other>[0-9]{5})(?![\p{L}\p{N}_])(?!-[0-9])",
    "phone": (r"(?:(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}"
              r"|\+[0-9]{1,3}(?:[ .-]?\([0-9]{1,4}\))?[ .-]?[0-9]{1,4}(?:[ .-][0-9]{1,4}){1,4}|\+[0-9]{8,15})(?![\p{L}\p{N}_])(?!-[0-9])"),
}
# A match starts where no word, number or longer expression goes on.
FOUND = r"(?<![\p{L}\p{N}._%+-])(" + "|".join(PATTERNS.values()) + ")"
# Characters that take each other's place, first code point and how many: digits, then letters by script and, where it has them, case.
CLASSES = (
    (48, 10), (65, 26), (97, 26), (0xC0, 23), (0xD8, 7), (0xE0, 23), (0xF8, 8), (0x100, 128), (0x391, 17), (0x3A3, 9), (0x3B1, 17), (0x3C3, 9),
    (0x400, 16), (0x410, 32), (0x430, 32), (0x450, 16), (0x531, 38), (0x561, 38), (0x5D0, 27), (0x621, 26), (0x641, 10), (0x904, 54), (0xE01, 48),
    (0x10D0, 43), (0x3041, 86), (0x30A1, 90), (0x4E00, 20992), (0xAC00, 11172))
MOVABLE = "[" + "".join(f"\\x{{{first:x}}}-\\x{{{first + size - 1:x}}}" for first, size in CLASSES) + "]"


def _digest(key: str, kind: str, turn: Column, value: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), turn.cast("string"), value.cast("string")), 256)


def _rounds(state: Column, step, once) -> Column:
    """The rounds, one step that leaves nothing where it is, and the rounds undone: a permutation without fixed points."""
    there = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), state, lambda s, t: step(s, t, 1))
    moved = F.aggregate(F.array(there), state, lambda _, s: once(s))
    return F.aggregate(F.sequence(F.lit(ROUNDS), F.lit(1), F.lit(-1)), moved, lambda s, t: step(s, t, -1))


def _sides(left: Column, right: Column) -> Column:
    return F.struct(left.alias("left"), right.alias("right"))


def permuted(value: Column, a: Column, b: Column, kind: str, key: str) -> Column:
    """A keyed permutation of 0 … a * b - 1 without fixed points (a > 1): a Feistel network on (left below a, right below b).

    A round adds a keyed number made from one side to the other, by turns, and
    subtracting it undoes the round, so any two radices will do and no value
    has to be tried again.
    """
    def keyed(turn: Column, side: Column) -> Column:
        return F.conv(F.substring(_digest(key, kind, turn, side), 1, 15), 16, 10).cast("long")

    def step(s: Column, turn: Column, sign: int) -> Column:
        odd = F.pmod(turn, F.lit(2)) == 1
        left = F.when(odd, F.pmod(s["left"] + sign * F.pmod(keyed(turn, s["right"]), a), a)).otherwise(s["left"])
        right = F.when(odd, s["right"]).otherwise(F.pmod(s["right"] + sign * F.pmod(keyed(turn, s["left"]), b), b))
        return _sides(left, right)

    state = _sides(F.call_function("div", value, b), F.pmod(value, b))
    out = _rounds(state, step, lambda s: _sides(F.pmod(s["left"] + 1, a), s["right"]))
    return F.aggregate(F.array(out), F.lit(0).cast("long"), lambda _, s: s["left"] * b + s["right"])


def _character(code: Column) -> Column:
    """The character of a code point below 65536."""
    return F.when(code < 256, F.char(code)).otherwise(F.decode(F.unhex(F.lpad(F.hex(code), 4, "0")), "UTF-16BE"))


def permuted_text(text: Column, kind: str, key: str) -> Column:
    """The same for texts: characters move within their class (digits, letters by script and case), others stay; both sides are halves of the text."""
    classes = F.array(*(F.struct(F.lit(first).alias("first"), F.lit(size).alias("size")) for first, size in CLASSES))

    def shifted(side: Column, amount) -> Column:
        def move(c: Column, i: Column) -> Column:
            code = F.ascii(c)
            own = F.filter(classes, lambda k: (code >= k["first"]) & (code < k["first"] + k["size"]))
            return F.coalesce(F.get(F.transform(own, lambda k: _character(F.pmod(code - k["first"] + amount(i), k["size"]) + k["first"])), F.lit(0)), c)
        return F.array_join(F.transform(F.filter(F.split(side, ""), lambda c: c != ""), move), "")

    def by_digest(side: Column, digest: Column, sign: int) -> Column:
        return shifted(side, lambda i: sign * F.conv(F.substring(digest, (F.pmod(i, F.lit(32)) * 2 + 1).cast("int"), F.lit(2)), 16, 10).cast("int"))

    def step(s: Column, turn: Column, sign: int) -> Column:
        odd = F.pmod(turn, F.lit(2)) == 1
        left = F.when(odd, by_digest(s["left"], _digest(key, kind, turn, s["right"]), sign)).otherwise(s["left"])
        right = F.when(odd, s["right"]).otherwise(by_digest(s["right"], _digest(key, kind, turn, s["left"]), sign))
        return _sides(left, right)

    half = F.call_function("div", F.length(text), F.lit(2)).cast("int")
    state = _sides(F.substring(text, F.lit(1), half), F.substring(text, half + 1, F.length(text)))
    out = _rounds(state, step, lambda s: _sides(shifted(s["left"], lambda i: F.lit(1)), shifted(s["right"], lambda i: F.lit(1))))
    return F.aggregate(F.array(out), F.lit(""), lambda _, s: F.concat(s["left"], s["right"]))


def let(value: Column, zero: Column, body) -> Column:
    """``body(value)`` with the value computed once; ``zero`` is any value of the result's type."""
    return F.aggregate(F.array(value), zero, lambda _, v: body(v))


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def refilled(text: Column, with_digits: Column) -> Column:
    """``text`` with its digits replaced, in order, by those given."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("next"))
    filled = F.aggregate(F.split(text, ""), start, lambda s, c: F.when(
        c.rlike("[0-9]"), F.struct(F.concat(s["out"], F.substring(with_digits, s["next"], F.lit(1))).alias("out"), (s["next"] + 1).alias("next"))
    ).otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["next"].alias("next"))))
    return filled["out"]


def permuted_digits(number: Column, kind: str, key: str) -> Column:
    """Digits (2 to 18 of them) permuted among numbers of the same length."""
    def of(n: Column) -> Column:
        left = F.call_function("div", F.length(n), F.lit(2)).cast("int")
        power = lambda e: F.pow(F.lit(10.0), e).cast("long")
        return F.lpad(permuted(n.cast("long"), power(left), power(F.length(n) - left), kind, key).cast("string"), F.length(n), F.lit("0"))
    return let(number, F.lit(""), of)


def luhn(number: Column) -> Column:
    """The Luhn sum of a digit string."""
    size = F.length(number)
    def add(total: Column, i: Column) -> Column:
        d = F.substring(number, size - i + 1, F.lit(1)).cast("int")
        return total + F.when(F.pmod(i, F.lit(2)) == 0, 2 * d - F.when(d > 4, 9).otherwise(0)).otherwise(d)
    return F.aggregate(F.sequence(F.lit(1), size), F.lit(0), add)


def mod97(text: Column) -> Column:
    """ISO 7064 remainder of digits and letters, letters counting 10 to 35."""
    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0), lambda n, c: F.pmod(
        F.when(c.rlike("[0-9]"), n * 10 + F.ascii(c) - 48).otherwise(n * 100 + F.ascii(c) - 55), F.lit(97)).cast("int"))


def _octets(ip: Column) -> Column:
    return F.transform(F.split(ip, r"\."), lambda p: p.cast("long"))


def _days(year: Column, month: Column) -> Column:
    leap = ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)
    return F.when(month == 2, F.when(leap, 29).otherwise(28)).when(month.isin(4, 6, 9, 11), 30).otherwise(31)


def _date_parts(m: Column) -> Column:
    """[year, month, day] of the three ways to write a date; with slashes the month comes first unless it cannot."""
    p = F.transform(F.split(m, "[-/.]"), lambda x: x.cast("int"))
    slash = F.when(p[0] > 12, F.array(p[2], p[1], p[0])).otherwise(F.array(p[2], p[0], p[1]))
    return F.when(m.contains("-"), p).when(m.contains("/"), slash).otherwise(F.array(p[2], p[1], p[0]))


def _moved_date(m: Column, key: str) -> Column:
    """Another day of the same century, written in the same way."""
    def of(p: Column) -> Column:
        century = F.call_function("div", p[0], F.lit(100)).cast("int")
        start = F.make_date(century * 100, F.lit(1), F.lit(1))
        long_century = century % 4 == 0
        # 36525 = 75 * 487 days, or 36524 = 92 * 397.
        day = permuted(F.datediff(F.make_date(p[0], p[1], p[2]), start).cast("long"), F.when(long_century, 75).otherwise(92).cast("long"),
                       F.when(long_century, 487).otherwise(397).cast("long"), "date", key)
        def write(d: Column) -> Column:
            y, mo, da = F.date_format(d, "yyyy"), F.month(d).cast("string"), F.dayofmonth(d).cast("string")
            two = lambda x: F.lpad(x, 2, "0")
            mark = F.when(m.contains("/"), "/").otherwise(".")
            first_wide, second_wide = m.rlike("^[0-9]{2}[/.]"), m.rlike("^[0-9]+[/.][0-9]{2}[/.]")
            month_first = m.contains("/") & (F.regexp_extract(m, "^[0-9]+", 0).cast("int") <= 12)
            a, b = F.when(month_first, mo).otherwise(da), F.when(month_first, da).otherwise(mo)
            return F.when(m.contains("-"), F.concat_ws("-", y, two(mo), two(da))).otherwise(F.concat(
                F.when(first_wide, two(a)).otherwise(a), mark, F.when(second_wide, two(b)).otherwise(b), mark, y))
        return let(F.date_add(start, day.cast("int")), F.lit(""), write)
    return let(_date_parts(m), F.lit(""), of)


def pseudonym(m: Column, key: str) -> Column:
    """(kind, value) of a match: its pseudonym if it is valid, else both null."""
    def kind_is(kind: str) -> Column:
        return m.rlike("^(?:" + PATTERNS[kind] + ")$")

    def value(kind: str, text: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), text.alias("value"))

    nothing = F.struct(F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("value"))
    name = F.substring_index(m, "@", 1)
    email = F.concat(permuted_text(name, "email", key), F.lit("@"), F.substring_index(m, "@", -1))

    number = digits(m)
    body = permuted_digits(F.substring(number, F.lit(1), F.length(number) - 1), "card", key)
    card = let(body, F.lit(""), lambda b: refilled(m, F.concat(b, F.pmod(10 - F.pmod(luhn(F.concat(b, F.lit("0"))), F.lit(10)), F.lit(10)).cast("string"))))

    plain = F.regexp_replace(m, " ", "")
    country, rest = F.substring(plain, 1, 2), F.substring(plain, F.lit(5), F.length(plain))
    iban = let(permuted_text(rest, "iban", key), F.lit(""), lambda r: F.aggregate(
        F.split(F.substring(m, F.lit(5), F.length(m)), ""),
        F.struct(F.concat(country, F.lpad((98 - mod97(F.concat(r, country, F.lit("00")))).cast("string"), 2, "0")).alias("out"), F.lit(1).alias("next")),
        lambda s, c: F.when(c == " ", F.struct(F.concat(s["out"], c).alias("out"), s["next"].alias("next"))).otherwise(
            F.struct(F.concat(s["out"], F.substring(r, s["next"], F.lit(1))).alias("out"), (s["next"] + 1).alias("next"))))["out"])

    ip = let(_octets(m), F.lit(""), lambda o: let(
        permuted(((o[0] * 256 + o[1]) * 256 + o[2]) * 256 + o[3], F.lit(65536).cast("long"), F.lit(65536).cast("long"), "ipv4", key), F.lit(""),
        lambda v: F.concat_ws(".", *(F.pmod(F.shiftright(v, 24 - 8 * i), F.lit(256)).cast("string") for i in range(4)))))

    area, group, serial = (F.substring(number, a, n).cast("long") for a, n in ((1, 3), (4, 2), (6, 4)))
    ssn_value = ((area - 1 - (area > 666).cast("long")) * 99 + group - 1) * 9999 + serial - 1
    def write_ssn(v: Column) -> Column:
        high = F.call_function("div", v, F.lit(9999))
        zone = F.call_function("div", high, F.lit(99)) + 1
        zone = zone + (zone >= 666).cast("long")
        return F.concat_ws("-", F.lpad(zone.cast("string"), 3, "0"), F.lpad((F.pmod(high, F.lit(99)) + 1).cast("string"), 2, "0"),
                           F.lpad((F.pmod(v, F.lit(9999)) + 1).cast("string"), 4, "0"))
    ssn = let(permuted(ssn_value, F.lit(898 * 99).cast("long"), F.lit(9999).cast("long"), "ssn", key), F.lit(""), write_ssn)

    prefix = F.regexp_extract(m, r"^\+[0-9]{1,3}[ .-]?", 0)
    local = F.substring(m, F.length(prefix) + 1, F.length(m))
    phone = F.concat(prefix, refilled(local, permuted_digits(digits(local), "phone", key)))

    parts = _date_parts(m)
    valid_date = let(parts, F.lit(False), lambda p: (p[0] >= 1000) & p[1].between(1, 12) & (p[2] >= 1) & (p[2] <= _days(p[0], p[1])))
    valid_ssn = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    # A name without any character that has a class stays, and is not counted; numbers of other lengths are no phone numbers.
    valid_phone = F.length(number).between(8, 15)
    return (F.when(m.contains("@"), F.when(name.rlike(MOVABLE), value("email", email)).otherwise(nothing))
            .when(kind_is("iban"), F.when(mod97(F.concat(rest, F.substring(plain, 1, 4))) == 1, value("iban", iban)).otherwise(nothing))
            .when(kind_is("ipv4"), F.when(F.forall(_octets(m), lambda o: o < 256), value("ipv4", ip)).otherwise(nothing))
            .when(kind_is("date"), F.when(valid_date, value("date", _moved_date(m, key))).otherwise(nothing))
            .when(kind_is("ssn"), F.when(valid_ssn, value("ssn", ssn)).otherwise(nothing))
            .when(kind_is("card"), F.when(F.pmod(luhn(number), F.lit(10)) == 0, value("card", card)).otherwise(nothing))
            .otherwise(F.when(valid_phone, value("phone", phone)).otherwise(nothing)))


def pseudonymized(docs: DataFrame, key: str = KEY) -> DataFrame:
    """doc_id, text with personal values replaced, n_found, and ``kinds``: the kinds replaced, in order, for every whole text.

    E-mail names, IP addresses, phone numbers, and those card numbers (Luhn),
    IBANs (mod 97), social security numbers and calendar dates that are valid
    are each permuted within their format by a Feistel network under ``key``:
    the same value gives the same pseudonym in every document, different
    values different ones, none stays as it is, check digits hold again.
    Numbers that fail their check stay. Nothing is moved: it is one scan.

    Null text: null, nothing found. Empty text: empty. Repeated rows get a row
    each; other columns are not looked at; an empty table gives none. The
    replacement keeps every other character, blanks included.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    none = F.array().cast("array<string>")
    rows = hold(rows, "_found", F.when(F.col("text").rlike("[0-9@]"), F.regexp_extract_all("text", F.lit(FOUND), 1)).otherwise(none))
    rows = hold(rows, "_new", F.transform("_found", lambda m: pseudonym(m, key)))
    some = F.exists("_new", lambda x: x["kind"].isNotNull())
    values = F.concat(F.zip_with("_new", "_found", lambda x, m: F.coalesce(x["value"], m)), F.array(F.lit("")))
    whole = F.array_join(F.zip_with(F.split("text", FOUND, -1), values, lambda a, b: F.concat(a, b)), "")
    kinds = F.filter(F.transform("_new", lambda x: x["kind"]), lambda k: k.isNotNull())
    return rows.select("doc_id", F.when(some, whole).otherwise(F.col("text")).alias("text"),
                       F.size(kinds).cast("long").alias("n_found"), kinds.alias("kinds"))

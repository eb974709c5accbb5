"""Calls in code texts: where they are, and texts without them. Works on the whole text, so a call or closure may have any length."""

from __future__ import annotations

import re

# The names of debug calls, and of calls that take a trailing closure.
DEBUG_NAMES = ["print", "debugPrint", "NSLog", "assert", "assertionFailure", "dump"]
QUIET_NAMES = ["print", "debugPrint", "NSLog", "dump"]
CLOSURE_CALLS = ["forEach", "map", "compactMap", "flatMap", "filter", "reduce", "sorted", "sort", "contains", "first", "allSatisfy"]
STACK = "Thread.callStackSymbols"

_STRING = r'"(?:\\.|[^"\\])*"'
_PARENS = re.compile(rf"(?s){_STRING}|[()]")
_BRACES = re.compile(r"[{}]")
_DEFINED = re.compile(r"\s*(?:\w+\s+)*func\b\s*(\w*)")


def call_pattern(names: list[str]) -> re.Pattern:
    return re.compile(r"(?<![\w.])(?P<prefix>Swift\.)?(?P<name>" + "|".join(map(re.escape, names)) + r")\s*\(")


def partner(text: str, at: int, marks: re.Pattern = _PARENS) -> int | None:
    """Place of the bracket that closes the one at ``at``; with parentheses, those in strings do not count."""
    open_ = 0
    for mark in marks.finditer(text, at):
        if mark.group() in "({":
            open_ += 1
        elif mark.group() in ")}":
            open_ -= 1
            if not open_:
                return mark.start()
    return None


def _line_end(text: str, at: int) -> int:
    end = text.find("\n", at)
    return len(text) if end < 0 else end


def call_spans(text: str | None, names: list[str]) -> list[tuple[str, bool, int, int]]:
    """(name, prefixed, start, end) of the first call per line, by 1-based lines, outside comment lines and definitions.

    What a call or the definition of a listed name spans is passed over. A call
    that never closes counts for its first line. Null: none.
    """
    pattern, out, at, number = call_pattern(names), [], 0, 1
    text = text or ""
    while at < len(text):
        end = _line_end(text, at)
        line, last = text[at:end], None
        definition = _DEFINED.match(line)
        if definition:
            brace = text.find("{", at, end)
            if definition.group(1) in names and brace >= 0:
                last = partner(text, brace, _BRACES)
        elif not line.lstrip().startswith(("//", "/*", "*")):
            hit = pattern.search(line)
            if STACK in line:
                out.append((STACK, False, number, number))
            elif hit and (hit.group("prefix") or not line[:hit.start()].rstrip().endswith(".")):
                last = partner(text, at + hit.end() - 1)
                height = text.count("\n", at, last) if last is not None else 0
                out.append((hit.group("name"), bool(hit.group("prefix")), number, number + height))
        if last is not None:
            end = _line_end(text, max(last, end))
        number += text.count("\n", at, end) + 1
        at = end + 1
    return out


_PARTS = re.compile(rf'{_STRING}|[;{{}}]|(?:(?!{_STRING})[^;{{}}])+')


def tidy(line: str) -> str:
    """The line without separators that have no statement on one of their sides, as a deleted call leaves them."""
    out, waiting = "", False
    for part in _PARTS.findall(line):
        if part == ";":
            waiting = True
        elif not waiting:
            out += part
        elif part.strip():
            before = out.rstrip()
            statement = before and before[-1] != "{" and part != "}"
            out = before + ("; " if statement else " " if before else "") + part.lstrip()
            waiting = False
    out = out.rstrip()
    # A closure that has lost its only statement still takes its argument.
    return re.sub(r"(?<=\.forEach)(\s*\{)\s*\}", r"\1 _ in }", out)


_NEEDS = re.compile(r"\s*(?:case\b|@unknown\s+default\b|guard\b)")
_FREE = re.compile(r"\s*(?:(?:func|class|struct|enum|protocol|extension)\b|\{)")
_CLOSURE = re.compile(r"\.(?:" + "|".join(CLOSURE_CALLS) + r")\b[^{}\n]*\{")


def remove_calls(text: str | None, names: list[str], quiet: list[str]) -> tuple[str | None, int]:
    """Delete calls, or make them harmless after ``case`` or ``guard``, where a statement is needed; null stays null.

    A line that opens a trailing closure is left alone as far as the closure
    goes if there are calls inside. A call that never closes is left alone.
    """
    if text is None:
        return None, 0
    pattern, out, removed, at, guarded = call_pattern(names), [], 0, 0, False
    while at <= len(text):
        end = _line_end(text, at)
        closure = _CLOSURE.search(text, at, end)
        if closure:
            last = partner(text, closure.end() - 1, _BRACES)
            stop = _line_end(text, last) if last is not None else end
            if pattern.search(text, at, stop) or text.find(STACK, at, stop) >= 0:
                out.append(text[at:stop])
                at = stop + 1
                continue
        kept, cursor, n = [], at, 0
        while hit := pattern.search(text, cursor, end):
            last = partner(text, hit.end() - 1)
            if last is None:
                break
            kept.append(text[cursor:hit.start()])
            if guarded:
                kept.append(f'{hit.group("prefix") or ""}{hit.group("name")}("")' if hit.group("name") in quiet else "assert(true)")
            cursor, n = last + 1, n + 1
            end = _line_end(text, cursor)
        line = "".join(kept) + text[cursor:end]
        n += line.count(STACK)
        line = re.sub(re.escape(STACK) + r"(?=\s*\.)", "[]", line).replace(STACK, '""')
        for passed in text[at:end].split("\n"):
            guarded = bool(_NEEDS.match(passed)) or (guarded and not _FREE.match(passed))
        out.append(tidy(line) if n else line)
        removed += n
        at = end + 1
    return "\n".join(out), removed

"""Comment removal that knows strings, raw strings, interpolation and nested blocks."""

from __future__ import annotations

import re

_MARK = re.compile(r'//|/\*|(?P<raw>#*)(?P<quote>"""|")|(?P<regex>#*/)|(?P<paren>[()])')
_BLOCK = re.compile(r"/\*|\*/")
# What may stand before a regex literal.
_REGEX_BEFORE = re.compile(r"(?:^|[=(,\[:{!&|^+\-*%<>~;]|(?<![A-Za-z0-9])(?:return|where))\Z")


def strip_comments(text: str | None) -> str | None:
    """Text without comments. A line that starts with a comment loses its line
    break too, and blanks before a comment are dropped. Null stays null."""
    if text is None:
        return None
    out: list[str] = []
    _copy_code(text, 0, out, nested=False)
    return "".join(out)


def _copy_code(text: str, at: int, out: list[str], nested: bool) -> int:
    """Copy code from ``at``; inside an interpolation, stop after its closing parenthesis."""
    depth = 1
    while mark := _MARK.search(text, at):
        start, token = mark.start(), mark.group()
        out.append(text[at:start])
        if mark.group("quote"):
            at = _copy_string(text, mark, out)
        elif mark.group("paren"):
            out.append(token)
            at = mark.end()
            depth += 1 if token == "(" else -1
            if nested and depth == 0:
                return at
        elif mark.group("regex"):
            at = _copy_regex(text, mark, out)
        else:
            _drop_blanks(out)
            line_start = text.rfind("\n", 0, start) + 1
            alone = not text[line_start:start].strip(" \t")
            if token == "//":
                newline = text.find("\n", start)
                at = len(text) if newline < 0 else newline + alone
            else:
                at = _block_end(text, mark.end())
                at += alone and text.startswith("\n", at)
    out.append(text[at:])
    return len(text)


def _copy_string(text: str, mark: re.Match, out: list[str]) -> int:
    hashes = mark.group("raw")
    close, start, at = mark.group("quote") + hashes, mark.start(), mark.end()
    stop = re.compile(r"\\\(|\\.|" + re.escape(close), re.S)
    while piece := stop.search(text, at):
        at = piece.end()
        if piece.group() == close:
            break
        if piece.group() == "\\(":
            out.append(text[start:at])
            start = at = _copy_code(text, at, out, nested=True)
    else:
        at = len(text)
    out.append(text[start:at])
    return at


def _copy_regex(text: str, mark: re.Match, out: list[str]) -> int:
    end = mark.start()
    while end and text[end - 1].isspace():
        end -= 1
    # The words that may stand here are short; one more character tells whether they are whole.
    if not _REGEX_BEFORE.search(text, max(0, end - 7), end):
        out.append(mark.group())
        return mark.end()
    close = "/" + "#" * (len(mark.group()) - 1)
    end = re.compile(r"(?:\\.|(?!" + re.escape(close) + r").)*" + re.escape(close), re.S).match(text, mark.end())
    at = end.end() if end else len(text)
    out.append(text[mark.start():at])
    return at


def _block_end(text: str, at: int) -> int:
    depth = 1
    for part in _BLOCK.finditer(text, at):
        depth += 1 if part.group() == "/*" else -1
        if depth == 0:
            return part.end()
    return len(text)


def _drop_blanks(out: list[str]) -> None:
    while out:
        out[-1] = out[-1].rstrip(" \t")
        if out[-1]:
            return
        out.pop()

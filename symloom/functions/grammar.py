"""Pieces of declaration patterns, from which the operators build theirs."""

from __future__ import annotations

NAME = r"[A-Za-z_]\w*"
ATTRIBUTE = r"@[\w.:]+(?:\([^()\n]*\))?"
# Any word may be a modifier, with an argument in parentheses; an import is no declaration.
MODIFIER = r"(?!import\b)\w+(?:\(\w+\))?"
ATTRIBUTES = rf"(?:{ATTRIBUTE}\s*)*"
MODIFIERS = rf"(?:{MODIFIER}\s+)*"
GENERICS = r"<[^<>]*(?:<[^<>]*>[^<>]*)*>"
# A parameter list may hold one level of parentheses, as function types and tuples do.
PARAMETERS = r"(?:[^()]|\([^()]*\))*"
# ``class`` may also be the modifier of a member.
NOT_A_MEMBER = r"(?!(?:func|var|let|subscript|init)\b)"
SAME_LINE = r"[ \t]*"


def type_head(kinds: str, name: str = rf"({NAME})") -> str:
    """A type's keyword and name; the kinds are captured if they are given in parentheses."""
    return rf"{ATTRIBUTES}{MODIFIERS}\b{kinds}\s+{NOT_A_MEMBER}{name}"


def function_head(modifiers: str = MODIFIERS, name: str = r"\w+", parameters: str = PARAMETERS) -> str:
    """A function up to the end of its parameter list."""
    return rf"{ATTRIBUTES}{modifiers}func\s+{name}\s*(?:{GENERICS})?\s*\({parameters}\)"

"""Query languages: driver-side parsers from a query string to a small plan."""

from __future__ import annotations

import re
import shlex
from dataclasses import dataclass, field

COLOURS = ("gold", "silver", "bronze")
#: Fixed value: no integer of an entity is above.
TOP = 10000


@dataclass
class AttributeQuery:
    """Attribute language: ``country:``, ``sport:``, ``name:``, medal comparisons; the rest is a name."""

    country: str | None = None
    sport: str | None = None
    name: str | None = None
    medals: list[tuple[str, str, int]] = field(default_factory=list)


def parse_attributes(query: str) -> AttributeQuery:
    """Words are split as a shell does (an open quote raises ValueError); each part is a medal comparison, an attribute
    (the last of its kind counts), or a word of the name, which counts unless ``name:`` is given."""
    out, loose = AttributeQuery(), []
    for part in shlex.split(query):
        if m := re.fullmatch(r"(gold|silver|bronze)\s*(<=|>=|==|=|<|>)\s*(\d+)", part, re.I):
            out.medals.append((m[1].lower(), m[2], int(m[3])))
        elif m := re.fullmatch(r"(country|sport|name)\s*:\s*(.+)", part, re.I):
            setattr(out, m[1].lower(), m[2])
        else:
            loose.append(part)
    if loose and not out.name:
        out.name = " ".join(loose)
    return out


@dataclass(frozen=True)
class Range:
    column: str
    low: int
    high: int


def to_range(column: str, op: str, value: int) -> Range:
    """Closed integer range of a comparison, within 0 and TOP as the open side."""
    low, high = {">": (value + 1, TOP), ">=": (value, TOP), "<": (0, value - 1), "<=": (0, value)}.get(op, (value, value))
    return Range(column, low, high)


@dataclass
class FilterQuery:
    """Filter language: integer ranges, and the text that is left (None if blank)."""

    ranges: list[Range]
    text: str | None


#: How clauses are written.
_CLAUSES = (
    (re.compile(r"\b(gold|silver|bronze)\s*(>=|<=|>|<|==?)\s*(\d+)\b", re.I), None),
    (re.compile(r"\b(yob|year|born)\s*(>=|<=|>|<|==?)?\s*(\d{1,4})\b", re.I), "yob"),
    (re.compile(r"\b(participations)\s*(>=|<=|>|<|==?)\s*(\d+)\b", re.I), "participations"),
)


def parse_filters(query: str) -> FilterQuery:
    """Clauses are found in the whole query; their words are then taken out of the text one clause after the other. A
    year without an operator means that year."""
    ranges, text = [], query
    for pattern, column in _CLAUSES:
        ranges += [to_range(column or m[1].lower(), m[2] or "==", int(m[3])) for m in pattern.finditer(query)]
        text = pattern.sub("", text)
    return FilterQuery(ranges, text if text else None)


@dataclass(frozen=True)
class Token:
    text: str
    phrase: bool


def text_tokens(text: str) -> list[Token]:
    """Quoted stretches are one token and phrases; everything else is split at white space."""
    return [Token(t.strip('"'), t.startswith('"') and t.endswith('"')) for t in re.findall(r'"[^"]*"|\S+', text)]

"""Patterns of literals, {type} and {property=type} variables, [optional parts] and (groups), compiled to regular
expressions that run in generated code.

Matching takes as much as a variable's type allows and never gives back, so quantifiers are possessive.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The types of variables, as classes of the characters they take.
TYPES = {
    "urlString": r"[\p{L}\p{Nd}$\-_.+!*'(),]++",
    "identifier": r"[\p{L}_$][\p{L}\p{Nd}_$]*+",
    "alphaNumString": r"[\p{L}\p{Nd}]++",
    "escapedString": r"[^\"\x00\n]++",
    "urlPath": r"[\p{L}\p{Nd}$\-_.+!*'(),/]++",
    "integer": r"\d++",
    "integerLiteral": r"\d++",
    "digits": r"\d++",
    "whiteSpace": r"\s++",
    "quoteChar": r"[\"']",
}


class PatternError(ValueError):
    """A text that is no pattern."""


@dataclass(frozen=True)
class Variable:
    kind: str
    name: str | None = None


@dataclass(frozen=True)
class Part:
    """A group: optional, repeated, or negated (anything but)."""

    elements: tuple
    optional: bool = False
    repeated: bool = False
    negated: bool = False


@dataclass(frozen=True)
class Pattern:
    elements: tuple

    @property
    def names(self) -> list[str]:
        return list(_names(self.elements))

    def regex(self) -> str:
        return "".join(map(_regex, self.elements))

    def matches(self, s: Column) -> Column:
        """Whether the whole string matches."""
        return s.rlike("^(?:" + self.regex() + ")$")

    def extract(self, s: Column) -> Column:
        """A map of the variables by name, null if the whole string doesn't match; a variable in an absent optional part
        is null."""
        whole = "^(?:" + self.regex() + ")$"
        pairs = []
        for i, name in enumerate(self.names, 1):
            pairs += [F.lit(name), F.nullif(F.regexp_extract(s, whole, i), F.lit(""))]
        return F.when(self.matches(s), F.create_map(*pairs))

    def replace(self, s: Column) -> Column:
        """Every match in the string, with its variables' values replaced by their names."""
        out, group = [], 0
        for e in _flat(self.elements):
            if isinstance(e, Variable):
                group += e.name is not None
                out.append(re.sub(r"([\\$])", r"\\\1", e.name) if e.name else "")
            else:
                out.append(re.sub(r"([\\$])", r"\\\1", e))
        return F.regexp_replace(s, self.regex(), "".join(out))

    def build(self, properties: dict[str, Column]) -> Column:
        """The string of the properties' values: null if a required one is null; an optional part with one is left out."""
        return _built(self.elements, properties)


def _names(elements):
    for e in elements:
        if isinstance(e, Part):
            yield from _names(e.elements)
        elif isinstance(e, Variable) and e.name:
            yield e.name


def _flat(elements):
    for e in elements:
        if isinstance(e, Part):
            if e.optional or e.repeated or e.negated:
                raise PatternError("a pattern for replacing has no optional, repeated or negated part")
            yield from _flat(e.elements)
        else:
            yield e


def _regex(e) -> str:
    if isinstance(e, str):
        return re.sub(r"([^\w\s])", r"\\\1", e)
    if isinstance(e, Variable):
        return f"({TYPES[e.kind]})" if e.name else TYPES[e.kind]
    inner = "".join(map(_regex, e.elements))
    if e.negated:
        return f"(?:(?!{inner}).)++"
    return f"(?:{inner})" + ("*+" if e.repeated else "?+" if e.optional else "")


def _built(elements, properties: dict[str, Column]) -> Column:
    parts = []
    for e in elements:
        if isinstance(e, str):
            parts.append(F.lit(e))
        elif isinstance(e, Variable):
            if e.name is None:
                raise PatternError("a pattern to build from has only named variables")
            parts.append(properties.get(e.name, F.lit(None)).cast("string"))
        else:
            inner = _built(e.elements, properties)
            parts.append(F.coalesce(inner, F.lit("")) if e.optional else inner)
    return F.concat(*parts) if parts else F.lit("")


def compile_pattern(text: str) -> Pattern:
    elements, at = _parse(text, 0, "")
    return Pattern(tuple(elements))


def _parse(text: str, at: int, until: str) -> tuple[list, int]:
    out: list = []
    while at < len(text):
        c = text[at]
        if c == until and until:
            return out, at + 1
        if c == "\\" and at + 1 < len(text):
            _literal(out, text[at + 1])
            at += 2
        elif c == "{":
            end = text.find("}", at)
            if end < 0:
                raise PatternError(f"{{ is not closed in {text!r}")
            name, eq, kind = text[at + 1 : end].partition("=")
            kind = kind if eq else name
            if kind not in TYPES:
                raise PatternError(f"there is no type {kind!r}")
            out.append(Variable(kind, name if eq else None))
            at = end + 1
        elif c in "[(" or c == "!" and text[at + 1 : at + 2] == "(":
            negated = c == "!"
            at += negated
            inner, at = _parse(text, at + 1, "]" if text[at] == "[" else ")")
            repeated = text[at : at + 1] == "*"
            at += repeated
            out.append(Part(tuple(inner), optional=c == "[" and not repeated, repeated=repeated, negated=negated))
        else:
            _literal(out, c)
            at += 1
    if until:
        raise PatternError(f"{until} is missing in {text!r}")
    return out, at


def _literal(out: list, c: str) -> None:
    if out and isinstance(out[-1], str):
        out[-1] += c
    else:
        out.append(c)


#: A product of a user agent: name, version, comment.
_AGENT = r"([\p{L}\p{Nd} .]+?)(?:/([\p{L}\p{Nd}\-.]+))?(?:\s+|$)(?:[(\[]([\p{L}\p{Nd}+.:/; ,\-&_]*)[)\]]\s*)?"


def user_agent(s: Column) -> Column:
    """The extensions of a user-agent string: an array of (name, version, comment), empty where absent."""
    whole = F.regexp_extract_all(s, F.lit(_AGENT), F.lit(0))
    part = lambda x, i: F.trim(F.regexp_extract(x, _AGENT, i))
    return F.transform(whole, lambda x: F.struct(part(x, 1).alias("name"), part(x, 2).alias("version"), part(x, 3).alias("comment")))

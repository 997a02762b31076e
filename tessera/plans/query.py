"""Predicate trees over entity properties, and the text form of them."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

#: Comparisons by name, and their sign in text.
SIGNS = {"eq": "==", "neq": "!=", "gt": ">", "lt": "<", "gteq": ">=", "lteq": "<="}


class QueryError(ValueError):
    """A text that is no query, or a query over properties that don't exist."""


class Query:
    """A predicate; combine with & | ~."""

    def __and__(self, other: Query) -> Query:
        return Combined("and", (self, other))

    def __or__(self, other: Query) -> Query:
        return Combined("or", (self, other))

    def __invert__(self) -> Query:
        return Negated(self)

    def leaves(self) -> Iterator[Compared]:
        """The comparisons, in order."""
        raise NotImplementedError

    def names(self) -> list[str]:
        """Property paths, each once, in order of first use."""
        return list(dict.fromkeys(x.name for x in self.leaves()))

    def values(self) -> list[Any]:
        return [x.value for x in self.leaves()]


@dataclass(frozen=True)
class Compared(Query):
    """A property path against a value: eq neq gt lt gteq lteq match in, or true for a boolean property alone."""

    name: str
    op: str
    value: Any = None

    def leaves(self) -> Iterator[Compared]:
        yield self

    def __str__(self) -> str:
        if self.op == "true":
            return self.name
        if self.op == "match":
            return f"{self.name}.contains({_literal(self.value)})"
        if self.op == "in":
            return f"{self.name} in ({', '.join(map(_literal, self.value))})"
        return f"{self.name} {SIGNS[self.op]} {_literal(self.value)}"


@dataclass(frozen=True)
class Combined(Query):
    op: str
    parts: tuple[Query, ...]

    def leaves(self) -> Iterator[Compared]:
        for p in self.parts:
            yield from p.leaves()

    def __str__(self) -> str:
        sign = " && " if self.op == "and" else " || "
        return sign.join(f"({p})" if isinstance(p, Combined) else str(p) for p in self.parts)


@dataclass(frozen=True)
class Negated(Query):
    part: Query

    def leaves(self) -> Iterator[Compared]:
        yield from self.part.leaves()

    def __str__(self) -> str:
        return f"!{self.part}" if isinstance(self.part, Compared) and self.part.op == "true" else f"!({self.part})"


def _literal(value: Any) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, str):
        return '"' + value.replace("\\", "\\\\").replace('"', '\\"') + '"'
    return str(value)


def eq(name: str, value: Any) -> Query:
    return Compared(name, "eq", value)


def neq(name: str, value: Any) -> Query:
    return Compared(name, "neq", value)


def gt(name: str, value: Any) -> Query:
    return Compared(name, "gt", value)


def lt(name: str, value: Any) -> Query:
    return Compared(name, "lt", value)


def gteq(name: str, value: Any) -> Query:
    return Compared(name, "gteq", value)


def lteq(name: str, value: Any) -> Query:
    return Compared(name, "lteq", value)


def match(name: str, text: str) -> Query:
    return Compared(name, "match", text)


def one_of(name: str, *values: Any) -> Query:
    return Compared(name, "in", tuple(values))


def is_true(name: str) -> Query:
    return Compared(name, "true")


def all_of(*parts: Query) -> Query:
    return parts[0] if len(parts) == 1 else Combined("and", tuple(parts))


def any_of(*parts: Query) -> Query:
    return parts[0] if len(parts) == 1 else Combined("or", tuple(parts))


_TOKEN = re.compile(
    r"""\s*(?:(?P<number>-?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)|(?P<string>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')
    |(?P<name>[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)*)|(?P<sign>&&|\|\||==|!=|>=|<=|[<>!(),]))""",
    re.X,
)
_BY_SIGN = {sign: op for op, sign in SIGNS.items()}
_MIRRORED = {"gt": "lt", "lt": "gt", "gteq": "lteq", "lteq": "gteq"}
_NAMED = {"true": True, "false": False, "null": None}


def parse(text: str) -> Query:
    """The query that a text expression stands for: == != > < >= <=, && ||, !x, parentheses, x.contains("text"), a boolean
    property alone, and literals of any type. A literal may stand on either side."""
    tokens, at = [], 0
    while text[at:].strip():
        found = _TOKEN.match(text, at)
        if not found:
            raise QueryError(f"cannot read {text[at:]!r}")
        tokens.append((found.lastgroup, found.group(found.lastgroup)))
        at = found.end()
    parser = _Parser(tokens, text)
    out = parser.either()
    if parser.at < len(tokens):
        raise QueryError(f"{tokens[parser.at][1]!r} is not expected in {text!r}")
    return out


class _Parser:
    def __init__(self, tokens: list[tuple[str, str]], text: str):
        self.tokens, self.text, self.at = tokens, text, 0

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def take(self, sign: str | None = None) -> tuple[str, str]:
        token = self.peek()
        if token[0] == "end" or sign and token[1] != sign:
            raise QueryError(f"{sign or 'an operand'} is missing in {self.text!r}")
        self.at += 1
        return token

    def chain(self, sign: str, op: str, inner) -> Query:
        parts = [inner()]
        while self.peek() == ("sign", sign):
            self.at += 1
            parts.append(inner())
        return parts[0] if len(parts) == 1 else Combined(op, tuple(parts))

    def either(self) -> Query:
        return self.chain("||", "or", self.both)

    def both(self) -> Query:
        return self.chain("&&", "and", self.unary)

    def unary(self) -> Query:
        if self.peek() == ("sign", "!"):
            self.at += 1
            return Negated(self.unary())
        if self.peek() == ("sign", "("):
            self.at += 1
            out = self.either()
            self.take(")")
            return out
        return self.comparison()

    def operand(self) -> tuple[bool, Any]:
        """Whether it is a property, and its name or value."""
        kind, value = self.take()
        if kind == "number":
            return False, float(value) if re.search(r"[.eE]", value) else int(value)
        if kind == "string":
            return False, re.sub(r"\\(.)", r"\1", value[1:-1])
        if kind == "name":
            return (False, _NAMED[value]) if value in _NAMED else (True, value)
        raise QueryError(f"{value!r} is no operand in {self.text!r}")

    def comparison(self) -> Query:
        is_name, left = self.operand()
        if is_name and left.endswith(".contains") and self.peek() == ("sign", "("):
            self.at += 1
            named, value = self.operand()
            self.take(")")
            if named or not isinstance(value, str):
                raise QueryError("contains takes a text")
            return Compared(left.removesuffix(".contains"), "match", value)
        op = _BY_SIGN.get(self.peek()[1])
        if op is None:
            if not is_name:
                raise QueryError(f"{left!r} alone is no query")
            return Compared(left, "true")
        self.at += 1
        named, right = self.operand()
        if is_name == named:
            raise QueryError("a comparison takes one property and one literal")
        return Compared(left, op, right) if is_name else Compared(right, _MIRRORED.get(op, op), left)

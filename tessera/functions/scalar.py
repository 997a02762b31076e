"""Functions as Column expressions; all stay in generated code, but for insert_linebreaks(), geometric_mean() and split_rows()."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructType


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


# Arithmetic: 32- and 64-bit whole numbers that wrap around, and division that truncates


def wrapped(x: Column, bits: int) -> Column:
    """A whole number (bigint or decimal) brought into the range of so many bits as two's complement does."""
    if bits == 32:
        return (F.pmod(x.cast("long") + F.lit(2**31), F.lit(2**32)) - F.lit(2**31)).cast("int")
    wide = "decimal(38,0)"
    half, whole = F.lit(str(2**63)).cast(wide), F.lit(str(2**64)).cast(wide)
    return (F.pmod(x.cast(wide) + half, whole) - half).cast("long")


def int_op(op: str, a, b, bits: int = 32) -> Column:
    """a op b for + - * / % & | ^ << >> >>>, null for a division by zero; shifts use the low bits of b."""
    a, b = _c(a), _c(b)
    kind = "int" if bits == 32 else "long"
    a = a.cast(kind)
    if op in ("+", "-", "*"):
        wide = "long" if bits == 32 else "decimal(38,0)"
        x, y = a.cast(wide), b.cast(wide)
        return wrapped({"+": x + y, "-": x - y, "*": x * y}[op], bits)
    if op in ("<<", ">>", ">>>"):
        n = b.cast("int").bitwiseAND(F.lit(bits - 1))
        made = {"<<": "shiftleft", ">>": "shiftright", ">>>": "shiftrightunsigned"}[op]
        return F.call_function(made, a, n)
    b = b.cast(kind)
    if op == "/":
        # the smallest number by -1 has no positive counterpart and stays
        least = F.lit(-(2 ** (bits - 1)))
        divided = F.call_function("div", a.cast("long"), F.nullif(b, F.lit(0).cast(kind)).cast("long")).cast(kind)
        return F.when((a == least) & (b == -1), a).otherwise(divided)
    if op == "%":
        return F.try_mod(a, b)
    return {"&": a.bitwiseAND(b), "|": a.bitwiseOR(b), "^": a.bitwiseXOR(b)}[op]


def float_op(op: str, a, b, kind: str = "double") -> Column:
    """a op b for + - * / %, as floating-point numbers have it: x / 0 is infinite (with both signs counted), 0 / 0 and x % 0
    are NaN. Null only where an operand is."""
    a, b = _c(a).cast(kind), _c(b).cast(kind)
    if op in ("+", "-", "*"):
        return {"+": a + b, "-": a - b, "*": a * b}[op].cast(kind)
    zero, nan = (b == 0) & a.isNotNull(), F.lit(float("nan"))
    if op == "%":
        return F.when(zero, nan).otherwise(F.try_mod(a, b)).cast(kind)
    if op != "/":
        raise ValueError(f"{op} is not for floating-point numbers")
    upwards = (a > 0) == (F.pow(b.cast("double"), F.lit(-1.0)) > 0)  # a power tells the sign of a zero
    by_zero = F.when(F.isnan(a) | (a == 0), nan).when(upwards, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    return F.when(zero, by_zero).otherwise(F.try_divide(a, b)).cast(kind)


def mixed_op(op: str, a: Column, a_type: str, b: Column, b_type: str) -> Column:
    """Promotion by types: a string on either side concatenates with +, two whole numbers are long, others double."""
    if "string" in (a_type, b_type):
        if op != "+":
            raise ValueError(f"{op} is not for strings")
        return F.concat(F.coalesce(a.cast("string"), F.lit("null")), F.coalesce(b.cast("string"), F.lit("null")))
    whole = {"tinyint", "smallint", "int", "bigint"}
    return int_op(op, a, b, 64) if {a_type, b_type} <= whole else float_op(op, a, b)


def unary_op(op: str, a: Column, bits: int = 32) -> Column:
    if op in ("+", "-"):
        return a if op == "+" else int_op("-", 0, a, bits)
    if op == "~":
        return F.bitwise_not(a)
    if op == "!":
        return ~a
    return int_op("+" if op == "++" else "-", a, 1, bits)


#: Fixed values. For a op b = r: the operator that gives a from (r, b) and whether its operands are swapped, then b from (r, a).
INVERSES = {"*": ("/", False, "/", False), "+": ("-", False, "-", False), "-": ("+", False, "-", True), "/": ("*", False, "/", True)}


def inverse_op(op: str, result: Column, other: Column, of_left: bool = True) -> Column:
    """The operand that makes a op b equal result, given the other one."""
    left, left_swap, right, right_swap = INVERSES[op]
    sign, swap = (left, left_swap) if of_left else (right, right_swap)
    return float_op(sign, other, result) if swap else float_op(sign, result, other)


def inverse_unary(op: str, result: Column) -> Column:
    """! ~ - and + are their own inverses."""
    return {"!": lambda: ~result, "~": lambda: F.bitwise_not(result), "-": lambda: -result, "+": lambda: result}[op]()


def ternary(condition: Column, yes, no) -> Column:
    """yes or no; null where the condition is null."""
    return F.when(condition, _c(yes)).when(~condition, _c(no))


def java_cast(x: Column, kind: str) -> Column:
    """Narrowing keeps the low bits; fractions are cut off and bounded by the range; null stays null."""
    if kind in ("tinyint", "smallint"):
        half = 2**7 if kind == "tinyint" else 2**15
        return (F.pmod(java_cast(x, "int").cast("long") + half, F.lit(2 * half)) - half).cast(kind)
    return x.cast(kind)


def narrowed(x: Column) -> Column:
    """A long as an int, of its low 32 bits."""
    return wrapped(x, 32)


def bounded(x: Column, kind: str = "int") -> Column:
    """A floating-point number as a whole number: towards zero, within the range; what is no number is 0."""
    top = 2**31 - 1 if kind == "int" else 2**63 - 1
    limits = F.when(F.isnan(x), F.lit(0)).when(x >= float(top), F.lit(top)).when(x <= -float(top) - 1, F.lit(-top - 1))
    return F.coalesce(limits.cast(kind), x.try_cast(kind))


def compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1 as a comes before, with or after b in their natural order; null where either is null."""
    return F.when(a < b, F.lit(-1)).when(a > b, F.lit(1)).when(a == b, F.lit(0))


def equal_objects(a: Column, b: Column, numeric: bool = False) -> Column:
    """Equality of values in memory: nulls are equal, and numbers within 1e-10."""
    if not numeric:
        return a.eqNullSafe(b)
    return F.coalesce(F.abs(a - b) < 1e-10, a.isNull() & b.isNull())


_DEFAULTS = {"boolean": False, "tinyint": 0, "smallint": 0, "int": 0, "bigint": 0, "float": 0.0, "double": 0.0}


def with_default(x: Column, kind: str) -> Column:
    """Null as the default of a primitive type: false or zero; other types keep null."""
    return F.coalesce(x, F.lit(_DEFAULTS[kind]).cast(kind)) if kind in _DEFAULTS else x


# Bits


def bit_is_set(x: Column, mask: int) -> Column:
    return x.bitwiseAND(F.lit(mask)) != 0


def bit_set(x: Column, mask: int, on: bool | Column) -> Column:
    """x with the bits of mask set or cleared, as assigning to bit_is_set() does."""
    set_, cleared = x.bitwiseOR(F.lit(mask)), x.bitwiseAND(F.lit(~mask))
    return F.when(on, set_).otherwise(cleared) if isinstance(on, Column) else (set_ if on else cleared)


# Arrays


def element(a: Column, i, *more) -> Column:
    """a[i][j]..., from 0; null where there is none."""
    return reduce(F.get, (_c(k) for k in (i, *more)), a)


def with_element(a: Column, i: int, value: Column) -> Column:
    return F.transform(a, lambda x, k: F.when(k == i, value).otherwise(x))


def array_length(a: Column) -> Column:
    return F.when(a.isNull(), F.lit(0)).otherwise(F.size(a))


def array_range(a: Column, begin: int, end: int) -> Column:
    """Elements from begin (from 0) up to end, end not included."""
    return F.slice(a, begin + 1, end - begin)


# Strings


def is_empty(s: Column) -> Column:
    return s.isNull() | (s == "")


def is_blank(s: Column) -> Column:
    return s.isNull() | (F.regexp_replace(s, r"\s", "") == "")


def equal_strings(a: Column, b: Column) -> Column:
    """Null and the empty string are equal."""
    return F.coalesce(a, F.lit("")) == F.coalesce(b, F.lit(""))


def split_plain(s: Column, separator: str) -> Column:
    """Parts between plain separators, not a regular expression."""
    return F.split(s, "\\Q" + separator + "\\E", -1)


def split_quoted(s: Column) -> Column:
    """Tokens at white space; a token in double quotes may hold white space."""
    found = F.regexp_extract_all(s, F.lit(r'"[^"]*"|\S+'), F.lit(0))
    return F.transform(found, lambda x: F.regexp_replace(x, '^"(.*)"$', "$1"))


def indent(n: Column | int, text: str = "   ") -> Column:
    return F.repeat(F.lit(text), _c(n))


def joined(a: Column, separator: str = ", ") -> Column:
    return F.array_join(a, separator)


def concat_set(*parts: Column) -> Column:
    """Concatenation that leaves out what is not set."""
    return F.concat_ws("", *[p.cast("string") for p in parts])


def concat_raw(*parts: Column) -> Column:
    """Concatenation that writes null as a word."""
    return F.concat(*[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])


def escape_html(s: Column) -> Column:
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        s = F.replace(s, F.lit(plain), F.lit(entity))
    return s


def escape_quotes(s: Column, single: bool = False) -> Column:
    return F.replace(s, F.lit("'" if single else '"'), F.lit("&apos;" if single else "&quot;"))


def ellipsis(s: Column, most: int, whole_words: bool = False) -> Column:
    """s cut to `most` characters with three dots at its end; by whole words at the last space, if there is one."""
    if most < 3:
        return F.when(F.length(s) <= most, s).otherwise(F.lit("." * most))
    end = F.lit(most - 3)
    if whole_words:
        space = F.lit(most - 2) - F.locate(" ", F.reverse(F.substring(s, 1, most - 2)))
        found = F.locate(" ", F.substring(s, 1, most - 2)) > 0
        end = F.when(found, space).otherwise(end)
    return F.when(s.isNull() | (F.length(s) <= most), s).otherwise(F.concat(F.substring(s, F.lit(1), end.cast("int")), F.lit("...")))


@F.pandas_udf(StringType())
def insert_linebreaks(s: pd.Series, width: pd.Series) -> pd.Series:
    """Line breaks in place of spaces, so that lines have `width` characters at most where words allow it."""

    def broken(text: str | None, n: int) -> str | None:
        if text is None:
            return None
        chars, at = list(text), 0
        while len(text) - at > n:
            cut = text.rfind(" ", at, at + n + 1)
            cut = text.find(" ", at + n) if cut <= at else cut
            if cut < 0:
                break
            chars[cut] = "\n"
            at = cut + 1
        return "".join(chars)

    return pd.Series([broken(t, int(n)) for t, n in zip(s, width)])


def sha1_hex(s: Column) -> Column:
    return F.sha1(s)


def salted_hash(s: Column, salt: Column, weak: bool = False) -> Column:
    """Base64url of SHA-512 (or SHA-1) of the salt's bytes and the text in UTF-8."""
    both = F.concat(F.coalesce(salt, F.lit(b"")), F.encode(s, "UTF-8"))
    digest = F.unhex(F.sha1(both) if weak else F.sha2(both, 512))
    return F.translate(F.base64(digest), "+/", "-_")


def format_float(x: Column) -> Column:
    """At most two decimals, half to even by the number's exact value, without trailing zeros."""
    return F.call_function("format_number", x.cast("double"), F.lit("#.##"))


@F.pandas_udf(DoubleType())
def geometric_mean(x: pd.Series) -> float:
    """A user's own aggregate: the geometric mean of a group's positive numbers, nulls left out."""
    return float(np.exp(np.log(x.dropna()).mean()))


@F.udtf(returnType=StructType().add("place", IntegerType()).add("word", StringType()))
class split_rows:  # noqa: N801  used as a function
    """A user's own table function: a row for each part of a text between plain separators."""

    def eval(self, text: str, separator: str):
        for i, part in enumerate(text.split(separator) if text is not None else ()):
            yield i, part


# Paths and names


def parent_path(s: Column) -> Column:
    return F.when(F.locate("/", s) > 0, F.regexp_extract(s, r"^(.*)/[^/]*$", 1))


def root_path(s: Column) -> Column:
    return F.when(F.locate("/", s) > 0, F.substring_index(s, "/", 1))


def file_name(s: Column) -> Column:
    return F.substring_index(F.regexp_replace(s, "/+$", ""), "/", -1)


def is_relative_url(s: Column) -> Column:
    return ~s.startswith("/") & ~s.startswith("#") & ~F.substring_index(s, "?", 1).contains("://")


def clean_file_name(s: Column) -> Column:
    """Letters, digits, - _ / and single dots; a space becomes _, anything else goes, as does a dot before a dot or at the end."""
    s = F.regexp_replace(s, r"\.(?=\.|$)", "")
    return F.regexp_replace(F.replace(s, F.lit(" "), F.lit("_")), r"[^\p{L}\p{Nd}.\-_/]", "")


def url_concat(*parts: Column | str | None) -> Column:
    """Path parts joined by one slash; ../ at a part's begin takes the last directory off. Empty and null parts are left out;
    null if all are."""
    out = F.lit(None).cast("string")
    for part in parts:
        part = F.lit(part).cast("string") if part is None or isinstance(part, str) else part
        ups = F.when(out.isNotNull(), F.length(F.regexp_extract(part, r"^((?:\.\./)*)", 1)) / 3).otherwise(F.lit(0)).cast("int")
        rest = F.substring(part, ups * 3 + 1, F.length(part))
        # each step up: what is before the last slash; a slash alone where there is none
        base = F.aggregate(
            F.when(ups > 0, F.sequence(F.lit(1), ups)).otherwise(F.array().cast("array<int>")),
            out,
            lambda o, _: F.when(F.locate("/", o) > 0, F.regexp_replace(o, r"/[^/]*$", "")).otherwise(F.lit("/")),
        )
        joined = F.when(out.isNull(), part).when(base.endswith("/"), F.concat(base, rest)).otherwise(F.concat(base, F.lit("/"), rest))
        out = F.when(part.isNull() | (part == ""), out).otherwise(joined)
    return out


def snake_case(s: Column) -> Column:
    return F.lower(F.regexp_replace(s, r"(?<!^)(\p{Lu})", "_$1"))


def camel_case(s: Column) -> Column:
    """The parts between underscores, each with a capital first letter."""
    parts = F.split(s, "_")
    return F.array_join(F.transform(parts, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 1 << 30))), "")


def enum_ordinal(s: Column, names: list[str]) -> Column:
    """The place of a constant's name, from 0; null for a name that isn't one."""
    at = F.array_position(F.array(*[F.lit(n) for n in names]), s)
    return F.when(at > 0, at - 1).cast("int")


def enum_name(i: Column, names: list[str]) -> Column:
    return F.get(F.array(*[F.lit(n) for n in names]), i)


# Dates


def parse_date(s: Column) -> Column:
    """An ISO date with time, or a date alone (midnight), in UTC; null if it is neither."""
    return F.coalesce(F.try_to_timestamp(s, F.lit("yyyy-MM-dd'T'HH:mm:ss[.SSS]X")), F.try_to_timestamp(s, F.lit("yyyy-MM-dd")))


def format_date(t: Column) -> Column:
    return F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def date_token(t: Column, now: Column) -> Column:
    """<recent-date> for a time within the last hour, <month-from-now-date> for one within an hour of 30 days ahead,
    else the ISO form."""
    ago = now.cast("timestamp").cast("double") - t.cast("timestamp").cast("double")
    month, hour = 30 * 86_400, 3_600
    return (
        F.when((ago >= 0) & (ago < hour), F.lit("<recent-date>"))
        .when((ago < 0) & (F.abs(-ago - month) < hour), F.lit("<month-from-now-date>"))
        .otherwise(format_date(t))
    )

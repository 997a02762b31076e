"""Named data sources, delimited and JSON files, and rows from markup."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


@dataclass
class DataSource:
    """Tables under a name: a folder of Parquet tables, or JDBC options. A read-only or disabled one is never written."""

    name: str
    folder: str | None = None
    jdbc: dict[str, str] = field(default_factory=dict)
    read_only: bool = False
    disabled: bool = False

    def table(self, spark: SparkSession, name: str) -> DataFrame:
        if self.disabled:
            raise ValueError(f"the source {self.name} is disabled")
        if self.folder is not None:
            return spark.read.parquet(f"{self.folder}/{name}.parquet")
        return spark.read.format("jdbc").options(**self.jdbc, dbtable=name).load()

    def write(self, df: DataFrame, name: str, mode: str = "errorifexists") -> None:
        if self.disabled or self.read_only:
            raise ValueError(f"the source {self.name} takes no writes")
        if self.folder is not None:
            df.write.mode(mode).parquet(f"{self.folder}/{name}.parquet")
        else:
            df.write.format("jdbc").options(**self.jdbc, dbtable=name).mode("append").save()


class Sources:
    """The registry of data sources."""

    def __init__(self):
        self.by_name: dict[str, DataSource] = {}

    def add(self, source: DataSource) -> DataSource:
        self.by_name[source.name] = source
        return source

    def __getitem__(self, name: str) -> DataSource:
        return self.by_name[name]


class NamedQueries:
    """Parametrised SQL by name: :name in the text stands for an argument, tables for registered views."""

    def __init__(self):
        self.by_name: dict[str, str] = {}

    def add(self, name: str, sql: str) -> None:
        self.by_name[name] = sql

    def run(self, spark: SparkSession, query: str, tables: dict[str, DataFrame], **args: Any) -> DataFrame:
        return spark.sql(self.by_name[query], args=args or None, **tables)


def read_delimited(spark: SparkSession, path: str, schema: StructType | str, separator: str = ",", header: bool = False, comment: str | None = None, skip: Sequence[str] = ()) -> DataFrame:
    """Rows of delimited files, typed by schema: an empty field is null, a missing last field is null, columns in skip
    aren't returned. Every row is read."""
    reader = spark.read.schema(schema).option("sep", separator).option("header", header).option("nullValue", "").option("mode", "PERMISSIVE").option("quote", "")
    if comment:
        reader = reader.option("comment", comment)
    return reader.csv(path).drop(*skip)


def parse_delimited(lines: DataFrame, line: str, fields: dict[str, str], separator: str = ",", comment: str | None = None) -> DataFrame:
    """The same for lines in a column: fields names the columns and their types, in order."""
    if comment:
        lines = lines.where(~F.col(line).startswith(comment))
    parts = F.split(F.col(line), "\\Q" + separator + "\\E", -1)
    columns = [F.nullif(F.get(parts, i), F.lit("")).try_cast(kind).alias(name) for i, (name, kind) in enumerate(fields.items())]
    return lines.select(*columns)


def to_delimited(df: DataFrame, separator: str = ",") -> DataFrame:
    """Each row as a line; null is an empty field."""
    return df.select(F.concat_ws(separator, *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]).alias("line"))


def parse_json(column: Column, schema: str) -> Column:
    """A JSON text as a typed value; what doesn't parse is null."""
    return F.from_json(column, schema)


def typed_json(column: Column, types: dict[str, str]) -> Column:
    """A JSON object of one of several classes, told by its member `class`: a struct of class and, for each of the types (by
    name, with a schema), the object as that type, null where it is of another. An unknown class gives only its name."""
    kind = F.get_json_object(column, "$.class")
    return F.struct(kind.alias("class"), *[F.when(kind == name, F.from_json(column, schema)).alias(name) for name, schema in types.items()])


def json_enum(column: Column, names: Sequence[str]) -> Column:
    """The constant that a JSON text names, null if there is none such."""
    return F.when(column.isin(*names), column)


def json_text(column: Column) -> Column:
    """A JSON text as it was meant: a backslash before ref: only says that it is no reference."""
    return F.when(column.startswith("\\ref:"), F.substring(column, 2, 1 << 30)).otherwise(column)


def json_reference(column: Column, prefix: str = "ref:db:") -> Column:
    """The id in a reference such as ref:db:12, null for anything else."""
    return F.when(column.startswith(prefix), F.substring(column, len(prefix) + 1, 64)).try_cast("long")


def to_json(value: Column) -> Column:
    """A struct as JSON without null members, dates in ISO form."""
    return F.to_json(value, {"ignoreNullFields": "true", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss'Z'"})


def tag_text(html: Column, tag: str) -> Column:
    """The text between the first <tag ...> and its end tag, null if there is none."""
    return F.nullif(F.regexp_extract(html, rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>", 1), F.lit(""))


def tag_attributes(html: Column, tag: str, attribute: str) -> Column:
    """The values of an attribute of all tags of a name, in order."""
    return F.regexp_extract_all(html, F.lit(rf'(?i)<{tag}\s[^>]*?{attribute}="([^"]*)"'), F.lit(1))


def parse_xml(column: Column, schema: str) -> Column:
    """An XML element as a typed value: child elements by name, attributes with _ before theirs; what doesn't parse is null."""
    return F.from_xml(column, schema, {"mode": "PERMISSIVE"})


def css_rules(column: Column) -> Column:
    """The rules of a style sheet in order: an array of (selector, declarations), these a map. Comments are left out; rules within
    an @media block come one by one."""
    plain = F.regexp_replace(column, r"(?s)/\*.*?\*/", "")
    found = F.regexp_extract_all(plain, F.lit(r"([^{}]+)\{([^{}]*)\}"), F.lit(0))
    part = lambda rule, i: F.trim(F.regexp_extract(rule, r"(?s)^\s*([^{}]+)\{([^{}]*)\}$", i))

    def declared(rule: Column) -> Column:
        items = F.filter(F.split(part(rule, 2), ";"), lambda x: x.contains(":"))
        pairs = F.transform(items, lambda x: F.struct(F.trim(F.regexp_extract(x, r"(?s)^([^:]*):", 1)).alias("key"), F.trim(F.regexp_extract(x, r"(?s):(.*)$", 1)).alias("value")))
        # of a name that is declared twice the last counts
        return F.map_from_entries(F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda later: later["key"] == p["key"])))

    return F.transform(found, lambda rule: F.struct(F.regexp_replace(part(rule, 1), r"\s+", " ").alias("selector"), declared(rule).alias("declarations")))


def markdown_blocks(column: Column) -> Column:
    """The blocks of a Markdown text in order: an array of (kind, level, text), kind being heading, item, quote, code or
    paragraph; level is that of a heading, else 0. Lines of a paragraph are joined by spaces; fenced code is one block."""
    fenced = F.regexp_extract_all(F.concat(column, F.lit("\n")), F.lit(r"(?m)^```[^\n]*\n(?:[^\n]*\n)*?```[ \t]*$|^[ \t]*(?:#{1,6}[ \t]|[-*+][ \t]|\d+[.)][ \t]|>)[^\n]*|(?:^(?![ \t]*(?:#{1,6}[ \t]|[-*+][ \t]|\d+[.)][ \t]|>|```))[^\n]*\S[^\n]*\n)+"), F.lit(0))

    def block(x: Column) -> Column:
        line = F.trim(x)
        kind = (
            F.when(line.startswith("```"), "code")
            .when(line.rlike(r"^#{1,6}[ \t]"), "heading")
            .when(line.rlike(r"^([-*+]|\d+[.)])[ \t]"), "item")
            .when(line.startswith(">"), "quote")
            .otherwise("paragraph")
        )
        text = (
            F.when(line.startswith("```"), F.regexp_replace(line, r"(?s)^```[^\n]*\n|\n?```\s*$", ""))
            .when(kind == "paragraph", F.regexp_replace(F.regexp_replace(x, r"^\s+|\s+$", ""), r"[ \t]*\n[ \t]*", " "))
            .otherwise(F.trim(F.regexp_replace(line, r"^(#{1,6}|[-*+]|\d+[.)]|>)[ \t]*", "")))
        )
        level = F.when(kind == "heading", F.length(F.regexp_extract(line, r"^(#+)", 1))).otherwise(F.lit(0))
        return F.struct(kind.alias("kind"), level.alias("level"), text.alias("text"))

    return F.transform(fenced, block)

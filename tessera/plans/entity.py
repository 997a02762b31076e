"""Entity types over tables, and queries over them as lazily joined DataFrames."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.plans.query import Combined, Compared, Negated, Query, QueryError, all_of, eq, parse

#: Builds a table's DataFrame from a session.
Source = Callable[[SparkSession], DataFrame]


@dataclass(frozen=True)
class Reference:
    """A property that holds the id of another entity: columns here, matched with that entity's id columns."""

    target: str
    columns: tuple[str, ...]


@dataclass(frozen=True)
class Auxiliary:
    """A table with more columns of the same entity, at most one row for each id."""

    source: Source
    id_columns: tuple[str, ...]
    columns: tuple[str, ...]


@dataclass(frozen=True)
class Reverse:
    """The entities of `target` that refer to this one: their columns hold its id. One at most if single. They come in
    `order`, by default that of their id."""

    target: str
    columns: tuple[str, ...]
    single: bool = False
    order: tuple[str, ...] = ()


@dataclass(frozen=True)
class Mapping:
    """The entities of `target` that rows of a mapping table link with this one: columns there that hold this entity's id, and
    those that hold the other's. A pair that is listed twice is one link."""

    target: str
    source: Source
    columns: tuple[str, ...]
    target_columns: tuple[str, ...]
    order: tuple[str, ...] = ()


@dataclass
class EntityType:
    """An entity: its primary table, id, references, relations, auxiliary tables, dynamic and computed properties, subtypes.

    groups: named sets of properties that are fetched together; the default group is the primary table's columns but
    for those in on_demand. dynamic: property -> (JSON column, path, type). computed: property -> Column factory.
    discriminator: (column, values) of a subtype.
    """

    name: str
    source: Source
    id_columns: tuple[str, ...]
    references: dict[str, Reference] = field(default_factory=dict)
    relations: dict[str, Reverse | Mapping] = field(default_factory=dict)
    auxiliaries: dict[str, Auxiliary] = field(default_factory=dict)
    dynamic: dict[str, tuple[str, str, str]] = field(default_factory=dict)
    computed: dict[str, Callable[[Callable[[str], Column]], Column]] = field(default_factory=dict)
    groups: dict[str, tuple[str, ...]] = field(default_factory=dict)
    on_demand: frozenset[str] = frozenset()
    discriminator: tuple[str, tuple[Any, ...]] | None = None


class Catalog:
    """Entity types by name."""

    def __init__(self, *types: EntityType):
        self.types = {t.name: t for t in types}

    def of(self, spark: SparkSession, name: str) -> EntityQuery:
        return EntityQuery(spark, self, self.types[name])

    def subtype(self, base: str, name: str, column: str, *values: Any) -> EntityType:
        """Registers a subtype of base: its rows are those whose discriminator has one of values."""
        b = self.types[base]
        made = EntityType(**{**b.__dict__, "name": name, "discriminator": (column, values)})
        self.types[name] = made
        return made


class _Joins:
    """The joins that one query needs, each path once, added when first used: unused references cost nothing."""

    def __init__(self, spark: SparkSession, catalog: Catalog, root: EntityType):
        self.spark, self.catalog = spark, catalog
        self.df = root.source(spark).alias("root")
        self.entity = {"": root}
        self.columns = {"": set(self.df.columns)}
        self.aux: dict[tuple[str, str], str] = {}
        self.n = 0

    def _alias(self, path: str) -> str:
        return "root" if not path else "r_" + path.replace(".", "_")

    def column(self, path: str) -> Column:
        """The column of a property path such as customer.nation.n_name."""
        *refs, name = path.split(".")
        at = ""
        for i, ref in enumerate(refs):
            entity = self.entity[at]
            if ref in entity.references:
                at = self._follow(at, ref)
                continue
            if ref in entity.relations and getattr(entity.relations[ref], "single", False):
                at = self._back(at, ref)
                continue
            rest = ".".join(path.split(".")[i + 1 :])
            if ref in self.columns[at]:
                return self._inside(F.col(f"{self._alias(at)}.{ref}"), self.df.select(F.col(f"{self._alias(at)}.{ref}")).schema[0].dataType, rest)
            raise QueryError(f"{entity.name} has no property {ref}")
        return self._property(at, name)

    def _inside(self, column: Column, kind: T.DataType, rest: str) -> Column:
        return column.getField(rest) if isinstance(kind, T.StructType) and "." not in rest else F.get_json_object(column, "$." + rest)

    def _property(self, at: str, name: str) -> Column:
        entity, alias = self.entity[at], self._alias(at)
        if name in self.columns[at]:
            return F.col(f"{alias}.{name}")
        if name in entity.computed:
            prefix = at + "." if at else ""
            return entity.computed[name](lambda p: self.column(prefix + p))
        if name in entity.dynamic:
            column, path, kind = entity.dynamic[name]
            return F.get_json_object(F.col(f"{alias}.{column}"), path).cast(kind)
        for key, aux in entity.auxiliaries.items():  # the first that has it
            if name in aux.columns:
                return F.col(f"{self._auxiliary(at, key, aux)}.{name}")
        if name in entity.references and len(entity.references[name].columns) == 1:
            return F.col(f"{alias}.{entity.references[name].columns[0]}")
        raise QueryError(f"{entity.name} has no property {name}")

    def _follow(self, at: str, ref: str) -> str:
        path = f"{at}.{ref}" if at else ref
        if path not in self.entity:
            link = self.entity[at].references[ref]
            target = self.catalog.types[link.target]
            alias = self._alias(path)
            other = target.source(self.spark)
            on = [F.col(f"{self._alias(at)}.{a}") == F.col(f"{alias}.{b}") for a, b in zip(link.columns, target.id_columns)]
            self.df = self.df.join(other.alias(alias), reduce(lambda x, y: x & y, on), "left")
            self.entity[path], self.columns[path] = target, set(other.columns)
        return path

    def _back(self, at: str, ref: str) -> str:
        """Joins the one entity that refers to this one."""
        path = f"{at}.{ref}" if at else ref
        if path not in self.entity:
            link = self.entity[at].relations[ref]
            target, alias = self.catalog.types[link.target], self._alias(path)
            other = target.source(self.spark)
            on = [F.col(f"{self._alias(at)}.{a}") == F.col(f"{alias}.{b}") for a, b in zip(self.entity[at].id_columns, link.columns)]
            self.df = self.df.join(other.alias(alias), reduce(lambda x, y: x & y, on), "left")
            self.entity[path], self.columns[path] = target, set(other.columns)
        return path

    def _auxiliary(self, at: str, key: str, aux: Auxiliary) -> str:
        if (at, key) not in self.aux:
            alias = f"{self._alias(at)}_{key}"
            on = [F.col(f"{self._alias(at)}.{a}") == F.col(f"{alias}.{b}") for a, b in zip(self.entity[at].id_columns, aux.id_columns)]
            self.df = self.df.join(aux.source(self.spark).alias(alias), reduce(lambda x, y: x & y, on), "left")
            self.aux[at, key] = alias
        return self.aux[at, key]


def contains(column: Column, text: str, wildcards: bool) -> Column:
    """Whether a column has the text anywhere, in whatever case."""
    if not wildcards:
        return F.lower(column).contains(text.lower()) if text else column.isNotNull()
    out, at, pattern = [], 0, f"%{text}%"
    while at < len(pattern):
        plain = pattern[at] == "\\" and at + 1 < len(pattern)
        at += plain
        c = pattern[at]
        out.append("\\" + c if c == "\\" or plain and c in "%_" else c)
        at += 1
    return column.ilike("".join(out))


def compile_query(query: Query, column: Callable[[str], Column], escape: bool = False) -> Column:
    """The Column of a predicate. Comparisons with null are IS NULL and IS NOT NULL; otherwise three-valued logic holds.

    match is a case-insensitive search for the text anywhere; % and _ in it are wildcards, and a backslash makes the next
    character plain, unless escape is set, which makes all characters plain.
    """
    if isinstance(query, Combined):
        parts = [compile_query(p, column, escape) for p in query.parts]
        return reduce(lambda a, b: a & b if query.op == "and" else a | b, parts)
    if isinstance(query, Negated):
        return ~compile_query(query.part, column, escape)
    assert isinstance(query, Compared)
    c, v = column(query.name), query.value
    if query.op == "true":
        return c
    if query.op == "match":
        return contains(c, v or "", not escape)
    if query.op == "in":
        return c.isin(list(v))
    if v is None:
        if query.op not in ("eq", "neq"):
            raise QueryError("null has no order")
        return c.isNull() if query.op == "eq" else c.isNotNull()
    return {"eq": c.__eq__, "neq": c.__ne__, "gt": c.__gt__, "lt": c.__lt__, "gteq": c.__ge__, "lteq": c.__le__}[query.op](v)


class EntityQuery:
    """A lazily built query over one entity type; each method returns a new one, frame() the DataFrame."""

    def __init__(self, spark: SparkSession, catalog: Catalog, entity: EntityType, **state: Any):
        self.spark, self.catalog, self.entity = spark, catalog, entity
        self.state = {"where": (), "select": None, "order": (), "start": 0, "most": 0, "escape": False, "including": (), **state}

    def _with(self, **more: Any) -> EntityQuery:
        return EntityQuery(self.spark, self.catalog, self.entity, **{**self.state, **more})

    # predicates

    def where(self, query: Query | str) -> EntityQuery:
        """Adds a predicate tree, or a text expression."""
        return self._with(where=(*self.state["where"], parse(query) if isinstance(query, str) else query))

    def by(self, **values: Any) -> EntityQuery:
        """Rows whose properties equal values (query by example); dots in paths are written __."""
        return self.where(all_of(*[eq(k.replace("__", "."), v) for k, v in values.items()])) if values else self

    def like(self, prototype: dict[str, Any], names: Sequence[str]) -> EntityQuery:
        """Rows that equal the prototype in the named properties."""
        return self.where(all_of(*[eq(n, prototype.get(n)) for n in names]))

    def search(self, text: str, wildcards: bool = False, **values: Any) -> EntityQuery:
        """Rows with the text in any string column (any case), or equal to it in a whole-number column if it is a
        number; and with values, if any. Without a column to search nothing is found. With wildcards, % and _ in the text
        stand for any characters, as in match."""
        return self._with(where=(*self.state["where"], _Search(text, wildcards))).by(**values)

    def escaped(self, on: bool = True) -> EntityQuery:
        """Takes % and _ in the texts of match as plain characters."""
        return self._with(escape=on)

    def refresh(self) -> EntityQuery:
        """Forgets what Spark holds of the entity's files, so that the next frame reads them as they are now."""
        for path in {f.rsplit("/", 1)[0] for f in self.entity.source(self.spark).inputFiles()}:
            self.spark.catalog.refreshByPath(path)
        return self

    def with_id(self, *ids: Any) -> EntityQuery:
        """The row of an id; a composite id has several parts."""
        return self.where(all_of(*[eq(c, v) for c, v in zip(self.entity.id_columns, ids, strict=True)]))

    def with_ids(self, ids: Iterable[Any]) -> EntityQuery:
        """Rows of a list of ids (of one column)."""
        (column,) = self.entity.id_columns
        return self.where(Compared(column, "in", tuple(ids)))

    # relations

    def _linked(self, name: str, paths: Sequence[str], where: Query | str | None) -> tuple[DataFrame, list[str]]:
        """The related entities' properties with this entity's id, in columns that are named last."""
        link = self.entity.relations.get(name)
        if link is None:
            raise QueryError(f"{self.entity.name} has no relation {name}")
        target = self.catalog.of(self.spark, link.target)
        target = target.where(where) if where is not None else target
        own = [f"_owner{i}" for i in range(len(self.entity.id_columns))]
        if isinstance(link, Reverse):
            return target.select(*paths, *[f"{c} as {o}" for c, o in zip(link.columns, own)]).frame(), own
        ids = target.entity.id_columns
        keys = [f"_target{i}" for i in range(len(ids))]
        rows = target.select(*paths, *[f"{c} as {k}" for c, k in zip(ids, keys)]).frame()
        pairs = [*[F.col(c).alias(o) for c, o in zip(link.columns, own)], *[F.col(c).alias("_m" + k) for c, k in zip(link.target_columns, keys)]]
        mapping = link.source(self.spark).select(*pairs)
        # the filtered side first: links that lead nowhere need not be made distinct
        joined = mapping.join(rows, reduce(lambda x, y: x & y, [F.col("_m" + k) == F.col(k) for k in keys]))
        return joined.drop(*keys, *["_m" + k for k in keys]).dropDuplicates([*own, *ids]), own

    def related(self, name: str, *paths: str, where: Query | str | None = None) -> DataFrame:
        """A row for each related entity of each of the query's rows: the id here (as owner_<column>), then the other's id and
        properties. A query without conditions takes the links as they are."""
        rows, own = self._linked(name, paths, where)
        ids = self.entity.id_columns
        if self.state["where"] or self.entity.discriminator:
            here = self.select().frame().select(*[F.col(c).alias(f"_id{i}") for i, c in enumerate(ids)])
            rows = rows.join(here, reduce(lambda x, y: x & y, [F.col(f"_id{i}") == F.col(o) for i, o in enumerate(own)]), "left_semi")
        else:
            rows = rows.where(reduce(lambda x, y: x & y, [F.col(o).isNotNull() for o in own]))
        rest = [c for c in rows.columns if c not in own]
        return rows.select(*[F.col(o).alias(f"owner_{c}") for c, o in zip(ids, own)], *rest)

    def collected(self, name: str, path: str, where: Query | str | None = None) -> DataFrame:
        """A row for each of the query's rows that has related entities: its id, their number n, and their property as a list, in
        the relation's order."""
        link = self.entity.relations[name]
        ids = self.catalog.types[link.target].id_columns
        by = [p.removeprefix("-") for p in link.order] + list(ids)
        rows = self.related(name, path, *[f"{p} as _by{i}" for i, p in enumerate(by)], where=where)
        values = [F.col(f"_by{i}") for i in range(len(by))]
        kinds = dict(rows.dtypes)
        for i, p in enumerate(link.order):
            if p.startswith("-"):
                if kinds[f"_by{i}"] in ("string", "binary", "boolean") or not re.match(r"(tinyint|smallint|int|bigint|float|double|decimal)", kinds[f"_by{i}"]):
                    raise QueryError("a list is in descending order of numbers only")
                values[i] = -values[i]
        value = _named(path)[0]
        listed = F.array_sort(F.collect_list(F.struct(*[v.alias(f"k{i}") for i, v in enumerate(values)], F.col(value).alias("value"))))
        grouped = rows.groupBy(*[f"owner_{c}" for c in self.entity.id_columns]).agg(F.count("*").alias("n"), listed.alias("_listed"))
        return grouped.select(*[F.col(f"owner_{c}").alias(c) for c in self.entity.id_columns], "n", F.transform("_listed", lambda x: x["value"]).alias(value))

    def including(self, name: str, where: Query | str | None = None) -> EntityQuery:
        """Rows that have a related entity (for which the condition holds)."""
        return self._with(including=(*self.state["including"], (name, where)))

    # projection and order

    def select(self, *paths: str) -> EntityQuery:
        """The properties to return; a path may be renamed by 'path as name'. The id comes first by itself."""
        return self._with(select=paths)

    def group(self, *names: str) -> EntityQuery:
        """The properties of named fetch groups, each auxiliary table and each eager reference being one."""
        return self._with(select=tuple(p for n in names for p in self._group(n)))

    def _group(self, name: str) -> tuple[str, ...]:
        e = self.entity
        if name in e.groups:
            return e.groups[name]
        if name in e.auxiliaries:
            return e.auxiliaries[name].columns
        if name in e.references:
            target = self.catalog.types[e.references[name].target]
            return tuple(f"{name}.{c}" for c in target.source(self.spark).columns)
        if name == "default":
            return tuple(c for c in e.source(self.spark).columns if c not in e.on_demand)
        raise QueryError(f"{e.name} has no group {name}")

    def order(self, *paths: str) -> EntityQuery:
        """Order by properties, -path for descending. Nulls are last when ascending and first when descending."""
        return self._with(order=paths)

    def page(self, start: int = 0, most: int = 0) -> EntityQuery:
        """Skips start rows and keeps most rows, where these are positive."""
        return self._with(start=start, most=most)

    # results

    def _built(self) -> tuple[_Joins, list[Column]]:
        joins = _Joins(self.spark, self.catalog, self.entity)
        conditions = []
        for q in self.state["where"]:
            conditions.append(q.column(joins) if isinstance(q, _Search) else compile_query(q, joins.column, self.state["escape"]))
        if self.entity.discriminator:
            name, values = self.entity.discriminator
            conditions.append(joins.column(name).isin(list(values)))
        for i, (name, where) in enumerate(self.state["including"]):
            rows, own = self._linked(name, (), where)
            wanted = rows.select(*[F.col(o).alias(f"_in{i}{o}") for o in own])
            on = [F.col(f"root.{c}") == F.col(f"_in{i}{o}") for c, o in zip(self.entity.id_columns, own)]
            joins.df = joins.df.join(wanted, reduce(lambda x, y: x & y, on), "left_semi")
        return joins, conditions

    def frame(self) -> DataFrame:
        joins, conditions = self._built()
        paths = self.state["select"] if self.state["select"] is not None else self._group("default")
        named = dict(_named(p) for p in (*self.entity.id_columns, *paths))
        columns = {alias: joins.column(path) for alias, path in named.items()}
        order = []
        for p in self.state["order"]:
            c = joins.column(p.removeprefix("-"))
            order.append(c.desc_nulls_first() if p.startswith("-") else c.asc_nulls_last())
        df = joins.df
        for c in conditions:
            df = df.where(c)
        if order:
            df = df.orderBy(*order)
        if self.state["start"] > 0:
            df = df.offset(self.state["start"])
        if self.state["most"] > 0:
            df = df.limit(self.state["most"])
        return df.select(*[c.alias(a) for a, c in columns.items()])

    def count_frame(self) -> DataFrame:
        """One row with the number of rows, over the same joins and conditions."""
        joins, conditions = self._built()
        df = joins.df
        for c in conditions:
            df = df.where(c)
        return df.agg(F.count("*").alias("n"))

    def count(self) -> int:
        return self.count_frame().first()["n"]

    def one(self, strict: bool = True):
        """The only row, or None; more than one is an error if strict, else the first in order is returned."""
        rows = self.frame().limit(2).collect()
        if len(rows) > 1 and strict:
            raise QueryError(f"more than one {self.entity.name} found")
        return rows[0] if rows else None


@dataclass(frozen=True)
class _Search:
    text: str
    wildcards: bool = False

    def column(self, joins: _Joins) -> Column:
        tests = []
        number = int(self.text) if re.fullmatch(r"\s*-?[0-9]+\s*", self.text) else None
        for f in joins.df.select("root.*").schema:
            c = F.col(f"root.{f.name}")
            if isinstance(f.dataType, T.StringType):
                tests.append(contains(c, self.text, self.wildcards))
            elif number is not None and isinstance(f.dataType, (T.IntegerType, T.LongType)):
                half = 2 ** (31 if isinstance(f.dataType, T.IntegerType) else 63)
                if -half <= number < half:
                    tests.append(c == number)
        return reduce(lambda a, b: a | b, tests) if tests else F.lit(False)


def _named(path: str) -> tuple[str, str]:
    source, _, alias = path.partition(" as ")
    return (alias or source.replace(".", "_")), source


@dataclass(frozen=True)
class FindBy:
    """A generated finder: required properties, optional ones, the order (None: chosen by the caller), and whether the
    result is one row."""

    names: tuple[str, ...]
    options: tuple[str, ...] = ()
    order: tuple[str, ...] | None = ()
    paged: bool = False
    unique: bool = False

    def finder(self, spark: SparkSession, catalog: Catalog, entity: str) -> Callable[..., Any]:
        """find(value..., option=value..., order=..., start=..., most=...): an EntityQuery, or one row if unique.
        An option that isn't given adds no condition."""

        def find(*values: Any, order: Sequence[str] | None = None, start: int = 0, most: int = 0, **options: Any):
            unknown = set(options) - set(self.options)
            if unknown or len(values) != len(self.names):
                raise QueryError(f"the finder takes {self.names} and the options {self.options}")
            if order is not None and self.order is not None:
                raise QueryError("the finder's order is fixed")
            query = catalog.of(spark, entity)
            tests = [eq(n, v) for n, v in zip(self.names, values)] + [eq(n, options[n]) for n in self.options if n in options]
            if tests:
                query = query.where(all_of(*tests))
            query = query.order(*(order if self.order is None and order is not None else self.order or ()))
            if self.paged:
                query = query.page(start, most)
            return query.one() if self.unique else query

        return find

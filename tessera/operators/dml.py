"""Inserts, updates, deletes and list changes as DataFrames: each gives the new state of a table, in one plan."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.session import checkpointed

#: Marks the columns that this module adds.
_NEW = "_new_"


def free_name(columns: Sequence[str], name: str) -> str:
    """name, with underscores before it until no column is called so, in whatever case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def _on(left: str, right: str, keys: Sequence[str], prefix: str = "") -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & (F.col(f"{left}.{k}") == F.col(f"{right}.{prefix}{k}"))
    return out


def inserted(base: DataFrame, rows: DataFrame, key: str | None = None, modified: tuple[str, Column] | None = None) -> DataFrame:
    """base and rows. Rows without a key get ids after the largest one, in the order of all their columns; modified is the
    column that holds the time of the last change, and that time."""
    if modified:
        rows = rows.withColumn(*modified)
    if key and key not in rows.columns:
        # one range for each partition of the sorted rows, so that numbering needs no single task
        top = base.agg(F.coalesce(F.max(key), F.lit(0)).alias("_top"))
        rows = numbered(rows, rows.columns, key).crossJoin(F.broadcast(top)).withColumn(key, F.col(key) + F.col("_top")).drop("_top")
    return base.unionByName(rows.select(*base.columns))


def numbered(rows: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """rows with numbers from 1 in the given order: ranges are sorted apart, and numbered after the counts before them."""
    spread = rows.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order)
    spread = checkpointed(spread.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()))
    sizes = spread.groupBy("_part").agg(F.count("*").alias("_size"), F.min("_at").alias("_low"))
    starts = sizes.select(F.col("_part").alias("_of"), "_low", (F.sum("_size").over(Window.orderBy("_part")) - F.col("_size")).alias("_before"))
    joined = spread.join(F.broadcast(starts), F.col("_part") == F.col("_of"))
    return joined.withColumn(name, F.col("_at") - F.col("_low") + F.col("_before") + 1).drop("_part", "_at", "_of", "_low", "_before")


def updated(
    base: DataFrame, changes: DataFrame, keys: Sequence[str], version: str | None = None, modified: tuple[str, Column] | None = None
) -> DataFrame:
    """base with the columns of changes in rows of equal keys. With a version column, only changes of the row's version
    apply, and the version goes up by one; stale_rows() has the others. A null in changes is the new value. Of changes that
    repeat a key (and version) the greatest by their columns, in order, applies: no row of base is multiplied."""
    by = [*keys, version] if version else list(keys)
    rest = [c for c in changes.columns if c not in by]
    if rest:
        greatest = changes.groupBy(*by).agg(F.max(F.struct(*rest)).alias(_NEW))
        changes = greatest.select(*by, *[F.col(f"{_NEW}.{c}").alias(c) for c in rest])
    else:
        changes = changes.distinct()
    columns = [c for c in changes.columns if c not in keys and c != version]
    other = changes.select(*[F.col(c).alias(_NEW + c) for c in changes.columns], F.lit(True).alias("_hit"))
    joined = base.alias("b").join(other.alias("n"), _on("b", "n", by, _NEW), "left")
    hit = F.col("_hit").isNotNull()
    new = {c: F.when(hit, F.col(_NEW + c)).otherwise(F.col(f"b.{c}")) for c in columns}
    if version:
        new[version] = F.when(hit, F.col(f"b.{version}") + 1).otherwise(F.col(f"b.{version}"))
    if modified:
        new[modified[0]] = F.when(hit, modified[1]).otherwise(F.col(f"b.{modified[0]}"))
    return joined.select(*[new.get(c, F.col(f"b.{c}")).alias(c) for c in base.columns])


def stale_rows(base: DataFrame, changes: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """The changes whose row is gone or has another version."""
    return changes.join(base.select(*keys, version), [*keys, version], "left_anti").select(*changes.columns)


def deleted(base: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    """base without the rows of equal keys (keys may include the version)."""
    return base.join(gone.select(*keys).distinct(), list(keys), "left_anti").select(*base.columns)


def delete_parts(tables: dict[str, tuple[DataFrame, Sequence[str]]], gone: DataFrame, keys: Sequence[str]) -> dict[str, DataFrame]:
    """An entity's auxiliary, list and primary tables without the rows of gone; each table names its key columns."""
    out = {}
    for name, (table, columns) in tables.items():
        renamed = gone.select(*[F.col(k).alias(c) for k, c in zip(keys, columns)])
        out[name] = deleted(table, renamed, columns)
    return out


def upserted(base: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """base with rows in place of those of equal keys, and with the other rows added. One full join: rows has a key once."""
    new = rows.select(*[F.col(c).alias(_NEW + c) for c in base.columns], F.lit(True).alias("_hit"))
    joined = base.alias("b").join(new.alias("n"), _on("b", "n", keys, _NEW), "full")
    hit = F.col("_hit").isNotNull()
    return joined.select(*[F.when(hit, F.col(_NEW + c)).otherwise(F.col(f"b.{c}")).alias(c) for c in base.columns])


def classified(base: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys and action (insert, update or unchanged) of each of rows, as an import that updates treats it."""
    columns = [c for c in rows.columns if c not in keys]
    old = base.select(*[F.col(c).alias(_NEW + c) for c in (*keys, *columns)], F.lit(True).alias("_hit"))
    joined = rows.alias("b").join(old.alias("n"), _on("b", "n", keys, _NEW), "left")
    same = F.lit(True)
    for c in columns:
        same = same & F.col(f"b.{c}").eqNullSafe(F.col(_NEW + c))
    action = F.when(F.col("_hit").isNull(), "insert").when(same, "unchanged").otherwise("update")
    return joined.select(*[F.col(f"b.{k}").alias(k) for k in keys], action.alias("action"))


def json_merged(column: Column, changes: Column) -> Column:
    """A JSON object of text values with the changes (a map; a null value removes the property)."""
    old = F.coalesce(F.from_json(column, "map<string,string>"), F.create_map().cast("map<string,string>"))
    kept = F.map_filter(old, lambda k, v: ~F.map_contains_key(changes, k))
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(F.map_concat(kept, F.map_filter(changes, lambda k, v: v.isNotNull()))))))


# Lists


def exploded(parents: DataFrame, key: str, items: str, position: str = "pos", item: str = "child") -> DataFrame:
    """One row for each element of a list property: key, position (from 0), item."""
    return parents.select(F.col(key), F.posexplode(items).alias(position, item))


def list_without(rows: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    """List rows without those of gone: by parent alone, or by parent and child."""
    return deleted(rows, gone, keys)


def list_changes(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys and change: removed (in old only) or added (in new only). Lists count as sets, and nulls as equal. One shuffle."""
    was, now = free_name(keys, "_was"), free_name(keys, "_now")
    rows = old.select(*keys, F.lit(1).alias(was), F.lit(0).alias(now)).unionByName(new.select(*keys, F.lit(0).alias(was), F.lit(1).alias(now)))
    found = rows.groupBy(*keys).agg(F.max(was).alias(was), F.max(now).alias(now)).where(F.col(was) != F.col(now))
    return found.select(*keys, F.when(F.col(was) == 1, "removed").otherwise("added").alias("change"))


# Validation


@dataclass
class Validators:
    """Rules by property: a Column that is the message where the value is wrong, and null where it is right."""

    rules: dict[str, list[Callable[[Column], Column]]] = field(default_factory=dict)

    def add(self, name: str, wrong: Callable[[Column], Column], message: str) -> Validators:
        self.rules.setdefault(name, []).append(lambda c: F.when(wrong(c), F.lit(message)))
        return self

    def required(self, *names: str) -> Validators:
        for n in names:
            self.add(n, lambda c: c.isNull(), "required")
        return self

    def errors(self) -> Column:
        """A map from property to its first error, of those that have one."""
        pairs = []
        for n, rules in self.rules.items():
            pairs += [F.lit(n), F.coalesce(*[r(F.col(n)) for r in rules])]
        return F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull())

    def check(self, df: DataFrame) -> DataFrame:
        return df.withColumn("errors", self.errors())


# Transactions


class StaleData(Exception):
    """A change is of a version that its row no longer has."""


class Transaction:
    """Changes to named tables that are read as if made, and written together.

    Operations queue up as plans; reading a table gives its base with the queue applied (read your writes). commit()
    writes each changed table to a new folder, makes them current at once, and returns the folders; rollback() forgets the queue. A
    read-only table takes changes, which stay in memory.
    """

    def __init__(self, tables: dict[str, DataFrame], read_only: Sequence[str] = ()):
        self.base, self.now, self.read_only = dict(tables), dict(tables), set(read_only)

    def read(self, name: str) -> DataFrame:
        return self.now[name]

    def insert(self, name: str, rows: DataFrame, key: str | None = None) -> None:
        self.now[name] = inserted(self.now[name], rows, key)

    def update(self, name: str, changes: DataFrame, keys: Sequence[str], version: str | None = None) -> None:
        if version and not stale_rows(self.now[name], changes, keys, version).isEmpty():
            raise StaleData(name)
        self.now[name] = updated(self.now[name], changes, keys, version)

    def delete(self, name: str, gone: DataFrame, keys: Sequence[str]) -> None:
        self.now[name] = deleted(self.now[name], gone, keys)

    def changed(self) -> list[str]:
        return [n for n in self.now if self.now[n] is not self.base[n] and n not in self.read_only]

    def rollback(self) -> None:
        self.now = dict(self.base)

    def cascade(self, new: dict[str, New]) -> dict[str, DataFrame]:
        """Inserts new rows of several tables that refer to each other by keys of their own: each table after those it refers to. Rows get
        ids after the largest one; references to a new row get its id, and others stay. Gives the old key and the id of each table's rows."""
        ids: dict[str, DataFrame] = {}
        for name in cascade_order({n: [t for t in x.references.values() if t in new and t != n] for n, x in new.items()}):
            x = new[name]
            rows = x.rows
            top = self.now[name].agg(F.coalesce(F.max(x.id), F.lit(0)).alias("_top"))
            made = numbered(rows.select(F.col(x.key).alias("_old")), ["_old"], "_n").crossJoin(F.broadcast(top))
            ids[name] = checkpointed(made.select("_old", (F.col("_n") + F.col("_top")).alias("_new")))
            for column, target in {x.key: name, **x.references}.items():
                if target not in ids:
                    continue
                found = ids[target].withColumnRenamed("_new", "_found")
                joined = rows.join(found, F.col(column) == F.col("_old"), "left")
                rows = joined.withColumn(column, F.coalesce("_found", F.col(column))).drop("_old", "_found")
            self.insert(name, rows.withColumnRenamed(x.key, x.id).select(*self.now[name].columns))
        return ids

    def commit(self, spark: SparkSession, folder: str) -> dict[str, str]:
        """Writes the changed tables to new folders, and then, as the last step, the record that makes them the current ones: a commit
        that fails, or that another one of the same number overtakes, changes nothing that current_tables() finds."""
        number = max((n for n, _ in _records(spark, folder).values()), default=0) + 1
        written = {n: f"{folder.rstrip('/')}/{number}/{n}" for n in self.changed()}
        for n, path in written.items():
            self.now[n].write.mode("errorifexists").parquet(path)
        rows = [(number, n, path) for n, path in written.items()]
        record = spark.createDataFrame(rows, "number int, name string, path string").coalesce(1)
        record.write.mode("errorifexists").parquet(f"{folder.rstrip('/')}/commits/{number}")
        for n, path in written.items():
            self.base[n] = self.now[n] = spark.read.parquet(path)
        return written


def _records(spark: SparkSession, folder: str) -> dict[str, tuple[int, str]]:
    """The last commit of each table, and its path. A record that isn't complete has no rows."""
    try:
        rows = spark.read.schema("number int, name string, path string").parquet(f"{folder.rstrip('/')}/commits/*")
        last = rows.groupBy("name").agg(F.max(F.struct("number", "path")).alias("last")).collect()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return {}
        raise
    return {r["name"]: (r["last"]["number"], r["last"]["path"]) for r in last}


def current_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables of a folder as commits left them."""
    return {n: spark.read.parquet(path) for n, (_, path) in _records(spark, folder).items()}


@dataclass(frozen=True)
class New:
    """New rows: `key` tells them apart (it becomes the table's column `id`), and references name the tables that columns refer to."""

    rows: DataFrame
    key: str
    id: str
    references: dict[str, str] = field(default_factory=dict)


def cascade_order(references: dict[str, Sequence[str]]) -> list[str]:
    """Entities so that each comes after those it refers to: the order of inserts; deletes go in reverse."""
    from graphlib import TopologicalSorter

    return list(TopologicalSorter(references).static_order())

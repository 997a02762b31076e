"""Merging and comparing lists, property sets and schemas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merged_results(primary: DataFrame, others: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Two result lists by id: primary rows win, and others adds those it lacks. Order again after it if order matters."""
    return primary.unionByName(others.join(primary.select(*keys), list(keys), "left_anti").select(*primary.columns))


def ordered_changes(old: DataFrame, new: DataFrame, parent: str, position: str, child: str, content: Sequence[str] = ()) -> DataFrame:
    """parent, child, old_pos, new_pos and change of each element of two ordered lists: insert, remove, move (another
    place), replace (same place, other content) or keep. Elements are known by (parent, child), once in a list."""
    a = old.select(F.col(parent).alias("p1"), F.col(child).alias("c1"), F.col(position).alias("old_pos"), *[F.col(c).alias("o_" + c) for c in content])
    b = new.select(F.col(parent).alias("p2"), F.col(child).alias("c2"), F.col(position).alias("new_pos"), *[F.col(c).alias("n_" + c) for c in content])
    joined = a.join(b, (F.col("p1") == F.col("p2")) & (F.col("c1") == F.col("c2")), "full")
    other = F.lit(False)
    for c in content:
        other = other | ~F.col("o_" + c).eqNullSafe(F.col("n_" + c))
    change = (
        F.when(F.col("old_pos").isNull(), "insert")
        .when(F.col("new_pos").isNull(), "remove")
        .when(F.col("old_pos") != F.col("new_pos"), "move")
        .when(other, "replace")
        .otherwise("keep")
    )
    return joined.select(
        F.coalesce("p1", "p2").alias(parent), F.coalesce("c1", "c2").alias(child), "old_pos", "new_pos", change.alias("change")
    )


def schema_columns(tables: dict[str, DataFrame]) -> list[tuple[str, str, str]]:
    """table, column and type of each column of tables."""
    return [(t, c, kind) for t, df in tables.items() for c, kind in df.dtypes]


def schema_changes(wanted: DataFrame, found: DataFrame) -> DataFrame:
    """table_name, column_name and problem (missing, extra or type) of two frames of (table_name, column_name, data_type)."""
    a = wanted.select(F.col("table_name").alias("t1"), F.col("column_name").alias("c1"), F.col("data_type").alias("k1"))
    b = found.select(F.col("table_name").alias("t2"), F.col("column_name").alias("c2"), F.col("data_type").alias("k2"))
    joined = a.join(b, (F.col("t1") == F.col("t2")) & (F.col("c1") == F.col("c2")), "full")
    problem = F.when(F.col("t2").isNull(), "missing").when(F.col("t1").isNull(), "extra").when(F.col("k1") != F.col("k2"), "type")
    return joined.select(F.coalesce("t1", "t2").alias("table_name"), F.coalesce("c1", "c2").alias("column_name"), problem.alias("problem")).where(
        "problem IS NOT NULL"
    )

"""Joins by nearness and by ranges, as one shuffle each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.dml import free_name


def as_of(left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, right_at: str, columns: Sequence[str]) -> DataFrame:
    """left with the columns of the last row of right whose keys are equal and whose right_at isn't after `at`; null where there is none.

    Both sides are laid in one order by key and time, in which the last row of right is carried on: no pair of rows is made.
    Rows with a null key match none (but stay); a null `at` matches none. Of rows of right at one time the greatest by the columns counts.
    columns must not be named as those of left.
    """
    names = [*left.columns, *columns]
    row, time, side, found, there = (free_name(names, n) for n in ("_row", "_time", "_side", "_found", "_there"))
    key_names = [free_name(names, f"_key{i}") for i in range(len(keys))]
    carried = F.struct(*[F.col(c).alias(c) for c in columns])
    a = left.select(*[F.col(k).alias(n) for k, n in zip(keys, key_names)], F.col(at).alias(time), F.lit(1).alias(side), F.struct("*").alias(row))
    b = right.where(" AND ".join(f"`{c}` IS NOT NULL" for c in (*keys, right_at)))
    b = b.groupBy(*keys, right_at).agg(F.max(carried).alias(there))
    b = b.select(*[F.col(k).alias(n) for k, n in zip(keys, key_names)], F.col(right_at).alias(time), F.lit(0).alias(side), there)
    both = a.unionByName(b, allowMissingColumns=True)
    order = Window.partitionBy(*key_names).orderBy(F.col(time).asc_nulls_first(), side)
    known = F.when(F.col(time).isNotNull(), F.last(there, ignorenulls=True).over(order))
    rows = both.withColumn(found, known).where(F.col(side) == 1)
    return rows.select(f"{row}.*", *[F.col(f"{found}.{c}").alias(c) for c in columns])


def in_ranges(points: DataFrame, ranges: DataFrame, at: str, low: str, high: str, width: float) -> DataFrame:
    """Pairs of a point and a range that holds it (both ends included): an equi-join on stretches of `width`, of which a range has
    as many rows as it touches. Choose a width near that of most ranges. Nulls and empty ranges match nothing; columns of both sides
    must differ."""
    names = [*points.columns, *ranges.columns]
    mine, theirs = free_name(names, "_at"), free_name(names, "_in")
    cell = lambda c: F.floor(F.col(c) / F.lit(float(width))).cast("long")
    a = points.where(F.col(at).isNotNull()).withColumn(mine, cell(at))
    b = ranges.where(F.col(low) <= F.col(high)).withColumn(theirs, F.explode(F.sequence(cell(low), cell(high))))
    return a.join(b, (F.col(mine) == F.col(theirs)) & F.col(at).between(F.col(low), F.col(high))).drop(mine, theirs)

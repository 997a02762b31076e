"""Connected components of a graph of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import forgotten, stored


def components(links: DataFrame) -> DataFrame:
    """node and root (the smallest node reachable) for every node of links (columns a, b: long).

    Each round points every node's larger neighbours, and then its smaller ones, at its smallest neighbour; rounds end
    when nothing changes, after about log(n) of them. Minima are aggregated before the shuffle and joined back, so a
    node with very many links is no single task's work: Spark splits such a join's partition. Every round is a table in
    the shared folder, in place of the one before. Only counts and checksums reach the driver. Links to oneself and repeated links are harmless;
    an empty table gives an empty result.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    seen = _checksum(edges)
    while seen[0]:
        before, edges = edges, stored(_small_star(_large_star(edges)))
        forgotten(before)
        now = _checksum(edges)
        if now == seen:
            break
        seen = now
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def _checksum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.hash("v", "u").cast("long"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("of"), F.least("u", "m").alias("m"))
    joined = both.where("v > u").join(least, F.col("u") == F.col("of"))
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    others = edges.join(least.select(F.col("u").alias("of"), "m"), F.col("u") == F.col("of")).where("v <> m")
    return others.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.withColumnRenamed("m", "v")).distinct()

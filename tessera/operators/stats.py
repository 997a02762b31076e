"""Timing statistics of named operations."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def operation_stats(rows: DataFrame, name: str, value: str) -> DataFrame:
    """name, total, n, low and high of each operation's measurements; nulls are no measurements of size, but count."""
    return rows.groupBy(F.col(name).alias("name")).agg(F.sum(value).alias("total"), F.count("*").alias("n"), F.min(value).alias("low"), F.max(value).alias("high"))


class Timers:
    """Seconds that named operations of the driver took; off unless enabled, and then a measurement costs nothing."""

    def __init__(self, enabled: bool = True):
        self.enabled, self.seconds = enabled, []

    @contextmanager
    def measured(self, name: str) -> Iterator[None]:
        began = time.perf_counter()
        try:
            yield
        finally:
            if self.enabled:
                self.seconds.append((name, time.perf_counter() - began))

    def stats(self, spark: SparkSession) -> DataFrame:
        """operation_stats() of what was measured, in seconds."""
        return operation_stats(spark.createDataFrame(self.seconds, "name string, seconds double"), "name", "seconds")

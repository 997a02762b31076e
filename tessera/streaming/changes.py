"""Change logs as streams: the same results as the batch operators, kept up to date by foreachBatch."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_OUT = "obj long, prop string, val double, seq long, overrides long"


def latest_values(log: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """Last writer wins on a stream of (obj, prop, val, seq: long): a row whenever a property's value changes, with
    overrides: how many changes it has had. With ttl_ms, a property that isn't changed for so long is forgotten."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        val, seq, n = state.get if state.exists else (None, None, 0)
        before = val
        for pdf in batches:
            n += len(pdf)
            top = pdf.loc[pdf["seq"].idxmax()]
            if seq is None or top["seq"] > seq:
                val, seq = float(top["val"]), int(top["seq"])
        state.update((val, seq, n))
        if ttl_ms:
            state.setTimeoutDuration(ttl_ms)
        if val != before:
            yield pd.DataFrame([(key[0], key[1], val, seq, n)], columns=["obj", "prop", "val", "seq", "overrides"])

    timeout = GroupStateTimeout.ProcessingTimeTimeout if ttl_ms else GroupStateTimeout.NoTimeout
    return log.groupBy("obj", "prop").applyInPandasWithState(step, _OUT, "val double, seq long, n long", "update", timeout)


def list_events(log: DataFrame) -> DataFrame:
    """A list kept for each object on a stream of (obj, op, item: string, seq: long), op being add, remove or clear, which
    emits an event whenever the list changes: obj, size, items (an array). Items may be any text, empty ones and nulls too."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        items = json.loads(state.get[0]) if state.exists else []
        before = list(items)
        for pdf in batches:
            for op, item in pdf.sort_values("seq")[["op", "item"]].itertuples(index=False):
                if op == "clear":
                    items = []
                elif op == "add":
                    items.append(item)
                elif item in items:
                    items.remove(item)
        state.update((json.dumps(items),))
        if items != before:
            yield pd.DataFrame({"obj": [key[0]], "size": [len(items)], "items": [items]})

    return log.groupBy("obj").applyInPandasWithState(step, "obj long, size long, items array<string>", "items string", "update", GroupStateTimeout.NoTimeout)


def deduped(log: DataFrame, event_time: str, delay: str, keys: list[str]) -> DataFrame:
    """Events without repeats of their keys within the watermark, which bounds the state."""
    return log.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(keys)


def answered(calls: DataFrame, results: DataFrame, key: str, within: str) -> DataFrame:
    """Calls (key, called_at) joined with results (result_key, result, result_at) that come within an interval; calls that
    get none come out with null once the watermark has passed."""
    c, r = calls.withWatermark("called_at", within), results.withWatermark("result_at", within)
    on = (F.col(key) == F.col("result_key")) & F.expr(f"result_at BETWEEN called_at AND called_at + INTERVAL {within}")
    return c.join(r, on, "left")


#: Seconds between tries, and after which a batch that can't be merged is given up.
POLL, TIMEOUT = 0.5, 60.0


def retried(merge: Callable[[DataFrame, int], None], poll: float = POLL, timeout: float = TIMEOUT) -> Callable[[DataFrame, int], None]:
    """merge, tried again `poll` seconds after an error until `timeout` seconds have passed; the last error is then raised, and the
    stream stops before the batch, which is merged anew when it starts again."""

    def merged(batch: DataFrame, number: int) -> None:
        until = time.monotonic() + timeout
        while True:
            try:
                return merge(batch, number)
            except Exception:
                if time.monotonic() + poll > until:
                    raise
            time.sleep(poll)

    return merged


def prioritised(dispatch: Callable[[DataFrame, int, int], None], priority: str = "priority") -> Callable[[DataFrame, int], None]:
    """A merge that dispatches each batch by priority, the highest first: dispatch(events, priority, number) for each that occurs."""

    def merge(batch: DataFrame, number: int) -> None:
        rows = batch.persist()
        try:
            for r in rows.select(priority).distinct().orderBy(F.col(priority).desc()).toLocalIterator():
                dispatch(rows.where(F.col(priority).eqNullSafe(F.lit(r[0]))), r[0], number)
        finally:
            rows.unpersist()

    return merge


def maintain(log: DataFrame, merge: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "ON_DEMAND", interval: str = "1 second") -> StreamingQuery:
    """Runs merge(batch, number) exactly once a batch, if merge is idempotent by number. ON_DEMAND takes what is there and ends;
    IMMEDIATE takes events as they come; QUEUED takes what has come every interval."""
    triggers = {"ON_DEMAND": {"availableNow": True}, "IMMEDIATE": {"processingTime": "0 seconds"}, "QUEUED": {"processingTime": interval}}
    return log.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(**triggers[mode]).start()


def view_writer(spark: SparkSession, folder: str, buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """A merge that keeps a last-writer-wins view, read by view(). Keys are dealt to buckets by a hash; a batch reads and writes
    anew only the buckets that it touches. A batch that is tried again replaces its own folder."""
    bucket = F.pmod(F.xxhash64("obj", "prop"), F.lit(buckets)).cast("int")

    def merge(batch: DataFrame, number: int) -> None:
        rows = batch.select("obj", "prop", "val", "seq").withColumn("bucket", bucket).persist()
        try:
            touched = {r[0] for r in rows.select("bucket").distinct().collect()}  # `buckets` of them at most
            before = _current(spark, folder, number)
            old = {b: n for b, n in before.items() if b in touched}
            merged = rows
            if old:
                merged = rows.unionByName(_at(spark, folder, old))
            top = merged.groupBy("bucket", "obj", "prop").agg(F.max_by("val", "seq").alias("val"), F.max("seq").alias("seq"))
            top.write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/batch={number}")
        finally:
            rows.unpersist()

    return merge


def _current(spark: SparkSession, folder: str, below: int | None = None) -> dict[int, int]:
    """The last batch that wrote each bucket, from the names of folders."""
    try:
        rows = spark.read.parquet(folder).select("batch", "bucket")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return {}
        raise
    rows = rows if below is None else rows.where(F.col("batch") < below)
    return {r[0]: r[1] for r in rows.groupBy("bucket").agg(F.max("batch")).collect()}


def _at(spark: SparkSession, folder: str, current: dict[int, int]) -> DataFrame:
    paths = [f"{folder}/batch={n}/bucket={b}" for b, n in current.items()]
    return spark.read.option("basePath", folder).parquet(*paths).select("obj", "prop", "val", "seq", "bucket")


def view(spark: SparkSession, folder: str) -> DataFrame:
    """What view_writer() keeps: obj, prop, val, seq."""
    found = _current(spark, folder)
    if not found:
        raise ValueError(f"no view in {folder}")
    return _at(spark, folder, found).drop("bucket")

"""What the operators share: Arrow batches as bytes, tables in the shared folder."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Stands in for a null id where ids are ordered: null ids come last.
NULL_ID = 2**63 - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share.

    Only where that setting is empty and Spark runs in this process alone a temporary folder is used; on a cluster
    without it, this is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/tessera-{uuid.uuid4().hex}"


def stored(df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder: computed once, lineage cut, safe when executors go."""
    path = shared_folder(df.sparkSession)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    table_ = df.sparkSession.read.schema(df.schema).parquet(path)
    table_._tessera_path = path
    return table_


def forgotten(df: DataFrame) -> None:
    """Deletes a table that stored() made, when no frame reads it any more."""
    path, spark = getattr(df, "_tessera_path", None), df.sparkSession
    if path and hasattr(spark, "_jvm"):
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def free_names(columns: list[str], *names: str) -> list[str]:
    """names, each with underscores put before it until no column is called so, in whatever case."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


@lru_cache(maxsize=1)
def _zstd() -> tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor]:
    return zstandard.ZstdCompressor(3), zstandard.ZstdDecompressor()


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays as bytes: a line of their types and lengths, then their values, compressed byte plane by byte plane."""
    head = ";".join(f"{a.dtype.str},{len(a)}" for a in arrays).encode()
    planes = [np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T).tobytes() for a in arrays]
    return head + b"\n" + _zstd()[0].compress(b"".join(planes))


def unpacked(raw: bytes) -> list[np.ndarray]:
    head, data = raw.split(b"\n", 1)
    whole, out, at = np.frombuffer(_zstd()[1].decompress(data), np.uint8), [], 0
    for item in head.decode().split(";"):
        kind, n = item.split(",")
        kind, n = np.dtype(kind), int(n)
        size = n * kind.itemsize
        out.append(np.ascontiguousarray(whole[at : at + size].reshape(kind.itemsize, n).T).view(kind).reshape(n))
        at += size
    return out


def trim() -> None:
    """Gives free memory back, so that a worker keeps no more than it uses."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def widened(schema: StructType, **more: str) -> StructType:
    """schema with more columns, given by name and type."""
    return StructType([*schema.fields, *StructType.fromDDL(", ".join(f"{k} {v}" for k, v in more.items())).fields])


def id_key(column: str) -> Column:
    """An id column without nulls, for joins and order."""
    return F.coalesce(F.col(column).cast("long"), F.lit(NULL_ID))


def text_tie(column: str) -> Column:
    """XXH64 (seed 42) of a text, null as empty, to tell apart documents of one id."""
    return F.xxhash64(F.coalesce(F.col(column), F.lit("")))


def pieces(batches: Iterator[pa.RecordBatch], column: str, most: int = 8 << 20) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Runs of rows with about `most` bytes of text at most (one row at least), and their texts in UTF-8; null is empty."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column))
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        begin = total = 0
        for i, n in enumerate(sizes.tolist()):
            if total + n > most and i > begin:
                yield _piece(batch, texts, begin, i)
                begin, total = i, 0
            total += n
        if begin < len(sizes):
            yield _piece(batch, texts, begin, len(sizes))


def _piece(batch: pa.RecordBatch, texts: pa.Array, begin: int, end: int) -> tuple[pa.RecordBatch, list[bytes]]:
    part = texts.slice(begin, end - begin).cast(pa.binary())
    return batch.slice(begin, end - begin), [x or b"" for x in part.to_pylist()]

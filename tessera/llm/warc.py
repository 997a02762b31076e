"""WARC archives of captured pages, and capture histories merged from the archives' indexes."""

from __future__ import annotations

import base64
import gzip
import hashlib
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import id_key, shared_folder, stored

#: Compressed records of an archive: the next one begins a new file.
ARCHIVE_BYTES = 32 << 20
#: Keys of the runs that the driver sees at most, to choose where ranges end; they only say how evenly ranges are filled.
SAMPLE = 100_000
#: A gzip member of nothing, which ends each archive.
_NOTHING = gzip.compress(b"", mtime=0)
_INDEX = (
    "url_key string, timestamp string, page_id long, url string, record_type string, payload_digest string, payload_bytes long,"
    " refers_to long, file string, offset long, length long"
)
_ORDER = ("url_key", "timestamp", "page_id", "file", "offset")


# Writing


def _date(pages: DataFrame, page: str) -> Column:
    """A record's date: captured_at, if it is a date, a time, a number of seconds or a text that holds one; else the page id in
    seconds after 2020 (ids repeat after 100 years; a null id is 1970)."""
    by_id = F.timestamp_seconds(F.pmod(F.col(page).cast("long"), F.lit(3_155_760_000)) + 1_577_836_800)
    kind = dict(pages.dtypes).get("captured_at", "")
    if kind.split("(")[0] in ("string", "date", "timestamp", "timestamp_ntz", "int", "bigint", "double"):
        seen = F.col("captured_at").try_cast("timestamp")
        by_id = F.coalesce(F.when((F.year(seen) >= 1) & (F.year(seen) <= 9999), seen), by_id)
    return F.date_format(F.coalesce(by_id, F.timestamp_seconds(F.lit(0))), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def write_archives(pages: DataFrame, path: str, page: str = "page_id", url: str = "url", html: str = "html", size: int = ARCHIVE_BYTES) -> None:
    """Writes a WARC 1.1 record for each row of pages, to archives of about `size` bytes (one record at least) below path.

    A payload is the html in UTF-8, null as empty. Of equal payloads (by SHA-1), those with the smallest page id are
    responses, and all others revisits that name it (repeated rows of that id are responses as well; null ids come last, with the
    largest long, and are named by none). Payloads of revisits are not written. Any id, url and captured_at will do: _date() says
    what dates are, and characters of a url that a header can't hold are written as %XX.

    Each record is a gzip member of its own, so that an index's offset and length are all that is needed to read it; an archive
    ends with an empty member. Spark's text writer makes the files, a row and its line end for each, so tasks commit whole
    files wherever Spark can write. Only ids and digests are shuffled to find the revisits; payloads stay
    where they are read, unless the revisits are too many to be sent to all tasks.
    """
    rows = pages.select(
        F.col(page).cast("long").alias("page_id"),
        F.coalesce(F.col(url).cast("string"), F.lit("")).alias("url"),
        F.coalesce(F.col(html).cast("binary"), F.lit(b"")).alias("html"),
        _date(pages, page).alias("date"),
        F.sha1(F.coalesce(F.col(html).cast("binary"), F.lit(b""))).alias("sha"),
    )
    digests = stored(rows.select(id_key("page_id").alias("id"), "sha"))
    first = digests.groupBy("sha").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last")
    first = first.select(F.col("sha").alias("_sha"), "first")
    revisits = digests.join(first, F.col("sha") == F.col("_sha")).where("id <> first").select(F.col("id").alias("_id"), "_sha", "first")
    revisits = stored(revisits.distinct())
    joined = rows.join(revisits, (id_key("page_id") == F.col("_id")) & (F.col("sha") == F.col("_sha")), "left")

    def archived(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                for row in batch.slice(i, 64).to_pylist():
                    held.append(gzip.compress(record(**row), 6, mtime=0))
                    total += len(held[-1])
                    if total >= size:
                        yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["value"])
                        held, total = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["value"])

    files = joined.select("page_id", "url", "html", "date", "first").mapInArrow(archived, "value binary")
    # the writer passes bytes on as they are
    written = files.select(F.col("value").cast("string").alias("value")).write.option("maxRecordsPerFile", 1)
    written.option("encoding", "ISO-8859-1").option("lineSep", _NOTHING.decode("latin-1")).text(path)


def _one_line(value: str) -> str:
    return "".join(c if " " < c < "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in value)


def record(page_id: int | None, url: str, html: bytes, date: str, first: int | None) -> bytes:
    """A record: a response, or a revisit of the page `first` if that is given."""
    digest = base64.b32encode(hashlib.sha1(html).digest()).decode()
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = head + html if first is None else head
    fields = [
        "WARC/1.1",
        f"WARC-Type: {'response' if first is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {_one_line(url)}",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(html)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if first is not None:
        fields += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <urn:page:{first}>",
        ]
    return "\r\n".join(fields).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


# Reading


def members(content: bytes) -> Iterator[tuple[int, int, bytes]]:
    """Offset, length and content of each gzip member that isn't empty."""
    at, view, step = 0, memoryview(content), 1 << 16
    while at < len(content):
        reader, out, end = zlib.decompressobj(31), [], at
        while not reader.eof:
            if end >= len(content):
                raise ValueError(f"the member at {at} has no end")
            out.append(reader.decompress(view[end : end + step]))
            end = min(len(content), end + step)
        end -= len(reader.unused_data)
        raw = b"".join(out)
        if raw:
            yield at, end - at, raw
        at = end


def parsed(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and block of a record."""
    end = raw.index(b"\r\n\r\n")
    lines = raw[:end].decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    n = int(fields["Content-Length"])
    if raw[end + 4 + n :] != b"\r\n\r\n":
        raise ValueError("the record has no end")
    return fields, raw[end + 4 : end + 4 + n]


def url_key(url: str) -> str:
    """Host reversed, then path and query: captures of a site sort together. What is no URL is a key without a host."""
    try:
        parts = urlsplit(url)
        host = ",".join(reversed((parts.hostname or "").split(".")))
    except ValueError:
        return f"){url}"
    return f"{host}){parts.path or '/'}" + (f"?{parts.query}" if parts.query else "")


def sorted_runs(spark, path: str) -> DataFrame:
    """run, rows and index (an Arrow stream) of each archive below path: one index row for each record, sorted by URL key, time,
    page id, file and offset.

    Archives are read whole, each by one task; write_archives() bounds their bytes. A response's payload is hashed
    and measured anew, and must agree with its header.
    """

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0), batch.column(1)):
                name = file.as_py().rsplit("/", 1)[-1]
                rows = [_index_row(name, *x) for x in members(content.as_py())]
                rows.sort(key=lambda r: _key(*(r[c] for c in _ORDER)))
                columns = [pa.array([name]), pa.array([len(rows)], pa.int64()), pa.array([_stream(pa.Table.from_pylist(rows, _schema()))])]
                yield pa.RecordBatch.from_arrays(columns, ["run", "rows", "index"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path).select("path", "content")
    return files.mapInArrow(indexed, "run string, rows long, index binary")


def index_rows(runs: DataFrame) -> DataFrame:
    """The index rows of sorted_runs(), run by run in their order."""

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(batch.schema.get_field_index("index")).to_pylist():
                yield from _opened(raw).to_batches()

    return runs.mapInArrow(opened, _INDEX)


def _schema() -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64()}
    return pa.schema([(x.strip().split(" ")[0], kinds[x.strip().split(" ")[1]]) for x in _INDEX.split(",")])


def _stream(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(rows)
    return sink.getvalue().to_pybytes()


def _opened(raw: bytes) -> pa.Table:
    return pa.ipc.open_stream(raw).read_all()


def _page(value: str | None) -> int | None:
    inside = (value or "").removeprefix("<urn:page:").removesuffix(">")
    return int(inside) if inside else None


def _index_row(file: str, offset: int, length: int, raw: bytes) -> dict:
    fields, block = parsed(raw)
    digest, size = fields["WARC-Payload-Digest"].removeprefix("sha1:"), int(fields["X-Payload-Length"])
    if fields["WARC-Type"] == "response":
        payload = block[block.index(b"\r\n\r\n") + 4 :]
        if len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
            raise ValueError(f"{file}: the payload at {offset} is not what its header says")
    return {
        "url_key": url_key(fields["WARC-Target-URI"]),
        "timestamp": fields["WARC-Date"],
        "page_id": _page(fields["WARC-Record-ID"]),
        "url": fields["WARC-Target-URI"],
        "record_type": fields["WARC-Type"],
        "payload_digest": digest,
        "payload_bytes": size,
        "refers_to": _page(fields.get("WARC-Refers-To")),
        "file": file,
        "offset": offset,
        "length": length,
    }


def _key(key: str, timestamp: str, page: int | None, file: str, offset: int) -> tuple:
    return key, timestamp, page is None, page or 0, file, offset


def _keys(rows: pa.Table) -> list[tuple]:
    return [_key(*x) for x in zip(*(rows.column(c).to_pylist() for c in _ORDER))]


# Merging


def loser_tree(runs: list[Iterator]) -> Iterator:
    """Merges sorted runs of (order, row). Inner nodes hold losers, so each row that leaves costs one path to the root."""
    k = len(runs)
    heads = [next(r, None) for r in runs]
    losers = [-1] * max(k, 1)

    def beats(a: int, b: int) -> bool:
        if heads[a] is None or heads[b] is None:
            return heads[b] is None and (heads[a] is not None or a < b)
        return heads[a][0] < heads[b][0] or heads[a][0] == heads[b][0] and a < b

    def play(run: int) -> int:
        node = (run + k) // 2
        while node:
            if losers[node] < 0:  # while the tree is built: wait for the other side
                losers[node] = run
                return -1
            if beats(losers[node], run):
                losers[node], run = run, losers[node]
            node //= 2
        return run

    winner = -1
    for run in range(k):
        winner = max(play(run), winner)
    while k and heads[winner] is not None:
        yield heads[winner][1]
        heads[winner] = next(runs[winner], None)
        winner = play(winner)


def capture_histories(runs: DataFrame, rows_per_task: int = 200_000) -> DataFrame:
    """All index rows of sorted_runs() in one global order by URL key, timestamp and page id (nulls last): partition by
    partition, and within each. Adds position within the partition. No runs give an empty result.

    Ends of ranges are chosen among sampled keys, of which the driver sees SAMPLE at most. Each run is cut at them, still
    sorted, and a range's task merges its parts of all runs by a loser tree: nothing is sorted again. A range is about
    rows_per_task index rows, without payloads; one URL with very many captures is split by time.
    """
    total = runs.agg(F.sum("rows")).first()[0] or 0
    tasks = max(1, -(-total // rows_per_task))
    step = max(1, -(-total // min(SAMPLE, 50 * tasks)))
    ends: list[tuple] = []
    if tasks > 1:

        def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for name, raw in zip(*(batch.column(c).to_pylist() for c in ("run", "index"))):
                    rows = _opened(raw).select(list(_ORDER))
                    chosen = range(zlib.crc32(name.encode()) % step, rows.num_rows, step)
                    yield from rows.take(pa.array(chosen, pa.int64())).combine_chunks().to_batches()

        seen = runs.mapInArrow(sampled, "url_key string, timestamp string, page_id long, file string, offset long").collect()
        keys = sorted(_key(*r) for r in seen)
        ends = [keys[len(keys) * i // tasks] for i in range(1, tasks)] if keys else []

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, raw in zip(*(batch.column(c).to_pylist() for c in ("run", "index"))):
                rows = _opened(raw)
                keys = _keys(rows)
                edges = [0, *(bisect_left(keys, e) for e in ends), len(keys)]
                for k, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
                    if a < b:
                        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([name]), pa.array([_stream(rows.slice(a, b - a))])], ["range", "run", "index"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list[tuple[str, bytes]]] = {}
        for batch in batches:
            for k, name, raw in zip(*(c.to_pylist() for c in batch.columns)):
                parts.setdefault(k, []).append((name, raw))
        position = 0
        for k in sorted(parts):
            tables = [_opened(raw) for _, raw in sorted(parts.pop(k))]
            whole, begin, heads = pa.concat_tables(tables).combine_chunks(), 0, []
            for t in tables:
                heads.append(zip(_keys(t), range(begin, begin + t.num_rows)))
                begin += t.num_rows
            order = pa.array(list(loser_tree(heads)), pa.int64())
            for i in range(0, len(order), 10_000):
                rows = whole.take(order.slice(i, 10_000))
                yield from rows.append_column("position", pa.array(range(position, position + rows.num_rows), pa.int64())).combine_chunks().to_batches()
                position += rows.num_rows

    dealt = runs.mapInArrow(cut, "range long, run string, index binary").repartitionById(tasks, F.col("range").cast("int"))
    return dealt.mapInArrow(merged, _INDEX + ", position long")


def capture_index(pages: DataFrame) -> DataFrame:
    """Writes pages as archives in the shared folder, reads them back and merges their indexes.

    One row per row of pages, in the order of capture_histories(). An empty table gives an empty result; columns other than
    those named (and captured_at) are ignored.
    """
    spark = pages.sparkSession
    path = shared_folder(spark) + "/warc"
    write_archives(pages, path)
    return capture_histories(stored(sorted_runs(spark, path)))

"""Motion-JPEG in AVI files: lossless intra frames, their index, and shots by adaptive histogram differences."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import pieces

#: Pixels of a line; a line of three 8-bit components is the unit that payloads are padded to.
WIDTH = 64
LINE = 3 * WIDTH
#: Lines of a frame at most.
HEIGHT = 24
RATE = 25
_CLIPS = "clip int, first_frame int, last_frame int, start_ms long, end_ms long, mean_luma double, change double"


# Lossless JPEG (SOF3). A sample is coded as its difference from a prediction: with predictor 1 the sample to the left (in the
# first column, from above; at the start 128). Differences come in classes: class s has s more bits. Frames written here
# give class s a Huffman code of 9 - s bits, so that every sample takes 9 bits: frames are coded and decoded as whole arrays.
# Frames of other writers, with any Huffman tables and predictors, are decoded sample by sample.


def _classes() -> tuple[np.ndarray, np.ndarray]:
    """Code word by difference + 255, and difference by code word; code lengths run from 1 (class 8) to 9 (class 0)."""
    prefix, code = {}, 0
    for size in range(1, 10):
        prefix[9 - size] = code
        code = (code + 1) << 1
    diffs = np.arange(-255, 256)
    size = np.array([int(abs(d)).bit_length() for d in diffs])
    extra = np.where(diffs < 0, diffs + (1 << size) - 1, diffs)
    words = np.array([prefix[s] for s in size.tolist()]) << size | extra
    back = np.zeros(512, np.int16)
    back[words] = diffs
    return words.astype(np.uint16), back


_WORD, _DIFFERENCE = _classes()
_TABLE = b"\xff\xc4" + struct.pack(">HB", 2 + 1 + 16 + 9, 0) + bytes([1] * 9 + [0] * 7) + bytes(range(8, -1, -1))


def _header(lines: int) -> bytes:
    frame = struct.pack(">BHHB", 8, lines, WIDTH, 3) + b"".join(bytes([c, 0x11, 0]) for c in (1, 2, 3))
    scan = b"\x03" + b"".join(bytes([c, 0]) for c in (1, 2, 3)) + b"\x01\x00\x00"
    return b"\xff\xd8" + _TABLE + b"\xff\xc3" + struct.pack(">H", 2 + len(frame)) + frame + b"\xff\xda" + struct.pack(">H", 2 + len(scan)) + scan


def encode_frames(pixels: np.ndarray) -> list[bytes]:
    """JPEG files of frames: uint8, frames x lines x WIDTH x 3."""
    whole = pixels.astype(np.int16)
    before = np.empty_like(whole)
    before[:, :, 1:] = whole[:, :, :-1]
    before[:, 1:, 0] = whole[:, :-1, 0]
    before[:, 0, 0] = 128
    codes = _WORD[whole - before + 255].reshape(len(pixels), -1, 8)
    out = np.empty((len(pixels), codes.shape[1], 9), np.uint8)
    out[..., 0] = codes[..., 0] >> 1
    for i in range(1, 8):
        out[..., i] = (codes[..., i - 1] << (8 - i)) | (codes[..., i] >> (i + 1))
    out[..., 8] = codes[..., 7] & 0xFF
    head = _header(pixels.shape[1])
    return [head + x.tobytes().replace(b"\xff", b"\xff\x00") + b"\xff\xd9" for x in out]


def decode_frames(files: list[bytes]) -> np.ndarray:
    """Pixels (frames x lines x columns x components) of JPEG files of one size."""
    lines, at = _segments(files[0])
    head = _header(lines)
    if at != len(head) or not all(f.startswith(head) for f in files):
        return np.stack([decode_lossless(f) for f in files])
    scans = [f[at:-2].replace(b"\xff\x00", b"\xff") for f in files]
    coded = np.frombuffer(b"".join(scans), np.uint8).reshape(len(files), -1, 9).astype(np.uint16)
    codes = np.empty((*coded.shape[:2], 8), np.uint16)
    for i in range(8):
        codes[..., i] = (coded[..., i] << (i + 1) | coded[..., i + 1] >> (7 - i)) & 511
    diffs = _DIFFERENCE[codes].reshape(len(files), lines, WIDTH, 3)
    diffs[:, 0, 0] += 128
    diffs[:, :, 0] = np.cumsum(diffs[:, :, 0], axis=1, dtype=np.int16)
    return np.cumsum(diffs, axis=2, dtype=np.int16).astype(np.uint8)


def _markers(file: bytes) -> Iterator[tuple[int, int, int]]:
    """Marker, begin and end of the content of each segment up to the end of the image; a scan's data are skipped."""
    if file[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    at = 2
    while at + 4 <= len(file):
        marker, size = struct.unpack_from(">HH", file, at)
        if marker == 0xFFD9:
            return
        if marker < 0xFFC0:
            raise ValueError("a damaged JPEG file")
        yield marker, at + 4, at + 2 + size
        at += 2 + size
        if marker == 0xFFDA:
            while at + 1 < len(file) and not (file[at] == 0xFF and file[at + 1] not in (0, 0xFF)):
                at += 1


def _segments(file: bytes) -> tuple[int, int]:
    """Lines of the frame, and where its scan data begin, from the file's marker segments."""
    lines = 0
    for marker, begin, end in _markers(file):
        if marker == 0xFFC3:
            lines = struct.unpack_from(">xHH", file, begin)[0]
        if marker == 0xFFDA:
            return lines, end
    raise ValueError("a JPEG file without a scan")


def _lookup(table: bytes) -> tuple[list[int], list[int]]:
    """Code length and class by the next 16 bits, of a Huffman table as a file has it."""
    sizes, classes = [0] * 65_536, [0] * 65_536
    code, k = 0, 16
    for size in range(1, 17):
        for _ in range(table[size - 1]):
            low = code << (16 - size)
            high = low + (1 << (16 - size))
            if high > 65_536 or k >= len(table):
                raise ValueError("a damaged Huffman table")
            sizes[low:high], classes[low:high] = [size] * (high - low), [table[k]] * (high - low)
            code, k = code + 1, k + 1
        code <<= 1
    return sizes, classes


def decode_lossless(file: bytes) -> np.ndarray:
    """Lines x columns x components of a lossless JPEG file (SOF3): 8 bits, components without subsampling, one scan or several,
    any Huffman tables and any of the seven predictors. Restart intervals and point transforms are errors."""
    tables: dict[int, bytes] = {}
    names: list[int] = []
    out = np.zeros((0, 0, 0), np.uint8)
    for marker, begin, end in _markers(file):
        if marker == 0xFFC4:
            while begin < end:
                n = 16 + sum(file[begin + 1 : begin + 17])
                tables[file[begin]] = file[begin + 1 : begin + 1 + n]
                begin += 1 + n
        elif marker == 0xFFC3:
            bits, lines, columns, n = struct.unpack_from(">BHHB", file, begin)
            parts = [file[begin + 6 + 3 * i : begin + 9 + 3 * i] for i in range(n)]
            if bits != 8 or any(len(x) < 3 or x[1] != 0x11 for x in parts):
                raise ValueError("a lossless JPEG file of another kind")
            names, out = [x[0] for x in parts], np.zeros((lines, columns, n), np.uint8)
        elif marker in (0xFFC0, 0xFFC1, 0xFFC2, 0xFFDD):
            raise ValueError("not a lossless JPEG file, or one with restarts")
        elif marker == 0xFFDA:
            n = file[begin]
            chosen = [names.index(file[begin + 1 + 2 * i]) for i in range(n)]
            used = [_lookup(tables[file[begin + 2 + 2 * i] >> 4]) for i in range(n)]
            predictor, _, shift = file[begin + 1 + 2 * n : begin + 4 + 2 * n]
            if shift or not 1 <= predictor <= 7:
                raise ValueError("a lossless JPEG file of another kind")
            _scan(file, end, out, chosen, used, predictor)
    if not out.size:
        raise ValueError("a JPEG file without a frame")
    return out


def _scan(file: bytes, at: int, out: np.ndarray, chosen: list[int], used: list[tuple[list[int], list[int]]], predictor: int) -> None:
    data = file[at:]
    stop = next((i for i in range(len(data) - 1) if data[i] == 0xFF and data[i + 1] != 0), len(data))
    data = data[:stop].replace(b"\xff\x00", b"\xff") + b"\xff" * 8
    lines, columns = out.shape[:2]
    held = bits = k = 0
    above = [[0] * columns for _ in chosen]
    for y in range(lines):
        row = [[0] * columns for _ in chosen]
        for x in range(columns):
            for c, (sizes, classes) in enumerate(used):
                while bits < 32:
                    if k >= len(data):
                        raise ValueError("a JPEG file that is cut off")
                    held, bits, k = held << 8 | data[k], bits + 8, k + 1
                head = held >> (bits - 16) & 0xFFFF
                if not sizes[head]:
                    raise ValueError("a code that no table has")
                bits -= sizes[head]
                size = classes[head]
                if size == 16:
                    difference = 32_768
                else:
                    bits -= size
                    difference = held >> bits & ((1 << size) - 1)
                    if size and not difference >> (size - 1):
                        difference += 1 - (1 << size)
                held &= (1 << bits) - 1
                left, up, corner = (row[c][x - 1], above[c][x], above[c][x - 1]) if x else (0, above[c][x], 0)
                if not y:
                    guess = left if x else 128
                elif not x:
                    guess = up
                else:
                    guess = (left, up, corner, left + up - corner, left + (up - corner >> 1), up + (left - corner >> 1), left + up >> 1)[predictor - 1]
                row[c][x] = guess + difference & 0xFF
        for c, i in enumerate(chosen):
            out[y, :, i] = row[c]
        above = row


# AVI


def _chunk(name: bytes, data: bytes) -> bytes:
    return name + struct.pack("<I", len(data)) + data + b"\0" * (len(data) & 1)


def _list(name: bytes, kind: bytes, data: bytes) -> bytes:
    return _chunk(name, kind + data)


def write_avi(payload: bytes) -> bytes:
    """The AVI file of a payload (a positive multiple of LINE bytes), its bytes in reading order as RGB samples.

    Frames have up to HEIGHT lines; lines that only fill the last frame are zero, and the payload's length is kept in
    the file's INFO list.
    """
    lines = len(payload) // LINE
    count = -(-lines // HEIGHT)
    height = -(-lines // count)
    pixels = np.zeros(count * height * LINE, np.uint8)
    pixels[: len(payload)] = np.frombuffer(payload, np.uint8)
    frames = encode_frames(pixels.reshape(count, height, WIDTH, 3))
    movie, index, at = [], [], 4
    for f in frames:
        chunk = _chunk(b"00dc", f)
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        movie.append(chunk)
        at += len(chunk)
    largest = max(map(len, frames))
    main = struct.pack("<14I", 1_000_000 // RATE, largest * RATE, 0, 0x10, count, 0, 1, largest, WIDTH, height, 0, 0, 0, 0)
    stream = struct.pack("<4s4sIHHIIIIIIII4H", b"vids", b"MJPG", 0, 0, 0, 0, 1, RATE, 0, count, largest, 0xFFFFFFFF, 0, 0, 0, WIDTH, height)
    bitmap = struct.pack("<IiiHH4sIiiII", 40, WIDTH, height, 1, 24, b"MJPG", WIDTH * height * 3, 0, 0, 0, 0)
    body = b"AVI " + b"".join(
        (
            _list(b"LIST", b"hdrl", _chunk(b"avih", main) + _list(b"LIST", b"strl", _chunk(b"strh", stream) + _chunk(b"strf", bitmap))),
            _list(b"LIST", b"INFO", _chunk(b"ICMT", f"payload={len(payload)}".encode() + b"\0")),
            _list(b"LIST", b"movi", b"".join(movie)),
            _chunk(b"idx1", b"".join(index)),
        )
    )
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read_avi(file: bytes) -> tuple[np.ndarray, int, int]:
    """Frames (frames x lines x columns x components), payload length (all of the frames, unless the INFO list says less), and
    microseconds per frame. Frames are found by the file's index: idx1, with places from the movi list or from the file's
    begin, or OpenDML's indx and ix chunks; a file without one is read chunk by chunk."""
    if file[:4] != b"RIFF" or file[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    found: dict[bytes, list[tuple[int, int]]] = {}
    chunks: list[tuple[int, int]] = []  # of frames, as they lie

    def walk(at: int, end: int) -> None:
        while at + 8 <= end:
            name, size = struct.unpack_from("<4sI", file, at)
            if name in (b"LIST", b"RIFF"):
                found.setdefault(file[at + 8 : at + 12], []).append((at + 8, size))
                walk(at + 12, min(end, at + 8 + size))
            else:
                found.setdefault(name, []).append((at + 8, size))
                if name[2:] in (b"dc", b"db"):
                    chunks.append((at + 8, size))
            at += 8 + size + (size & 1)

    walk(0, len(file))
    places = _indexed(file, found) or chunks
    comment = next((file[a : a + n].rstrip(b"\0") for a, n in found.get(b"ICMT", []) if file[a : a + 8] == b"payload="), None)
    frames = [file[a : a + n] for a, n in places if n]
    if not frames or b"avih" not in found:
        raise ValueError("an AVI file without frames")
    pixels = decode_frames(frames)
    return pixels, int(comment[8:]) if comment else pixels.size, struct.unpack_from("<I", file, found[b"avih"][0][0])[0]


def _indexed(file: bytes, found: dict[bytes, list[tuple[int, int]]]) -> list[tuple[int, int]]:
    out = []
    for at, size in found.get(b"indx", [])[:1]:
        for i in range(struct.unpack_from("<HBBI", file, at)[3]):
            where, length, _ = struct.unpack_from("<QII", file, at + 24 + 16 * i)
            _, _, _, n, _, base, _ = struct.unpack_from("<HBBI4sQI", file, where + 8)
            for k in range(n):
                offset, length = struct.unpack_from("<II", file, where + 32 + 8 * k)
                out.append((base + offset, length & 0x7FFFFFFF))
    if out:
        return out
    for at, size in found.get(b"idx1", [])[:1]:
        base = found[b"movi"][0][0]
        for name, _, offset, length in struct.iter_unpack("<4sIII", file[at : at + size - size % 16]):
            if name[2:] in (b"dc", b"db"):
                if not out and file[base + offset : base + offset + 4] != name:
                    base = 0
                out.append((base + offset + 8, length))
    return out


# Shots


def shots(pixels: np.ndarray, microseconds: int, window: int = 8, factor: float = 3.0, least: float = 0.08) -> list[dict]:
    """Clips between cuts. The difference of two frames is half the L1 distance of their 32-bin luma histograms; a cut
    is a difference over `least` that exceeds the median of the `window` differences before it by `factor` of their
    median deviations, which a cut among them hardly moves (the first difference needs `least` alone)."""
    n = len(pixels)
    if pixels.shape[-1] != 3:  # grey, or more than colours
        pixels = np.repeat(pixels[..., :1], 3, axis=-1)
    weighted = pixels.reshape(n, -1, 3).astype(np.uint16) @ np.array([77, 150, 29], np.uint16)
    bins = (weighted >> 11).astype(np.int64) + 32 * np.arange(n)[:, None]
    histogram = np.bincount(bins.ravel(), minlength=32 * n).reshape(n, 32) / weighted.shape[1]
    luma = histogram @ (np.arange(32) * 8 + 4.0)
    change = np.abs(np.diff(histogram, axis=0)).sum(axis=1) / 2
    if n > 1:
        before = np.sort(np.lib.stride_tricks.sliding_window_view(np.concatenate([np.full(window, change[0]), change[:-1]]), window), axis=1)
        middle = (before[:, (window - 1) // 2] + before[:, window // 2]) / 2
        spread = np.sort(np.abs(before - middle[:, None]), axis=1)[:, window // 2]
        cuts = np.flatnonzero((change > least) & ((np.arange(n - 1) == 0) | (change > middle + factor * spread))) + 1
    else:
        cuts = np.zeros(0, np.int64)
    edges = [0, *cuts.tolist(), n]
    return [
        {
            "clip": k,
            "first_frame": a,
            "last_frame": b - 1,
            "start_ms": a * microseconds // 1000,
            "end_ms": b * microseconds // 1000,
            "mean_luma": float(luma[a:b].mean()),
            "change": float(change[a - 1]) if a else 0.0,
        }
        for k, (a, b) in enumerate(zip(edges[:-1], edges[1:]))
    ]


# DataFrames


def payload_of(text: bytes) -> bytes:
    """text with spaces up to a positive multiple of LINE."""
    return text + b" " * (max(LINE, -(-len(text) // LINE) * LINE) - len(text))


def to_media(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_bytes and media (an AVI file) of every row. Null texts are empty: one line of spaces. A narrow pass."""

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches, text):
            media = pa.array([write_avi(payload_of(x)) for x in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(map(len, texts)), pa.int64()), media], ["key", "n_bytes", "media"])

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias(text))
    return rows.mapInArrow(written, "key long, n_bytes long, media binary").withColumnRenamed("key", key)


def from_media(rows: DataFrame, media: str = "media", key: str = "doc_id") -> DataFrame:
    """key, payload (binary, as decoded) and clips (timed rows of the shots found) of every media file; null gives nulls, and so does a
    file that can't be read."""
    clip = pa.struct([(x.strip().split(" ")[0], {"int": pa.int32(), "long": pa.int64(), "double": pa.float64()}[x.strip().split(" ")[1]]) for x in _CLIPS.split(",")])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 128):
                part = batch.slice(i, 128)
                payloads, clips = [], []
                for file in part.column(1).to_pylist():
                    try:
                        pixels, n, microseconds = read_avi(file or b"")
                    except (ValueError, IndexError, KeyError, struct.error):
                        payloads.append(None)
                        clips.append(None)
                        continue
                    payloads.append(pixels.tobytes()[:n])
                    clips.append(shots(pixels, microseconds))
                arrays = [*part.columns, pa.array(payloads, pa.binary()), pa.array(clips, pa.list_(clip))]
                yield pa.RecordBatch.from_arrays(arrays, [*part.schema.names, "payload", "clips"])

    out = rows.select(F.col(key).alias("key"), F.col(media).alias("media"), *[F.col(c) for c in rows.columns if c not in (key, media, "payload", "clips")])
    schema = ", ".join(f"`{n}` {t}" for n, t in out.dtypes) + f", payload binary, clips array<struct<{_CLIPS.replace(' int', ': int').replace(' long', ': long').replace(' double', ': double')}>>"
    return out.mapInArrow(read, schema).withColumnRenamed("key", key)


def clip_rows(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row for each clip of from_media(): key, clip, first_frame, last_frame, start_ms, end_ms, mean_luma, change."""
    return rows.select(key, F.inline("clips"))


def media_digests(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Lengths and digests of what was stored and of what was read back, and the clips as one string."""
    rows = from_media(to_media(docs, text, key), key=key)
    clip = F.transform("clips", lambda c: F.concat(c["start_ms"], F.lit("-"), c["end_ms"], F.lit(":"), F.format_string("%.3f", c["mean_luma"])))
    return rows.select(
        key,
        "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -16, 16)).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.array_join(clip, ";").alias("feature"),
    )

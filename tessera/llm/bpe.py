"""Byte-pair encoding by a priority queue of merge ranks, and decoding by concatenating vocabulary strings."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import pretokens
from tessera.llm.common import pieces, widened


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256))
    return [chr(b) if b in shown else chr(256 + next(spare)) for b in range(256)]


class BytePairs:
    """Encoder and decoder for a byte-level BPE file of the tokenizers library."""

    #: Encoded units that a worker remembers; beyond it starts anew.
    REMEMBERED = 600_000

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        self.path = path
        vocabulary = model["model"]["vocab"]
        symbols = byte_symbols()
        self.first = [vocabulary[c] for c in symbols]
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["model"]["merges"])
        #: By a pair of ids (left in the high bits): the merge's rank in the high bits, and the id that it makes.
        self.merges = {vocabulary[a] << 32 | vocabulary[b]: rank << 32 | vocabulary[a + b] for rank, (a, b) in enumerate(pairs)}
        of = {c: b for b, c in enumerate(symbols)}
        self.strings = {i: bytes(of[c] for c in s) for s, i in vocabulary.items() if all(c in of for c in s)}
        self.special = {t["content"]: t["id"] for t in model.get("added_tokens", [])}
        self.strings |= {i: s.encode() for s, i in self.special.items()}
        self.memory: dict[str, bytes] = {}

    def merged(self, raw: bytes) -> list[int]:
        """Token ids of one pre-token.

        Symbols form a doubly linked list; the queue has the rank and the place of each neighbouring pair, as one number. An
        entry is stale, and skipped, once the pair at its place is gone or has another rank.
        """
        ids = [self.first[b] for b in raw]
        n, find = len(ids), self.merges.get
        if n == 1:
            return ids
        pairs = [find(a << 32 | b) for a, b in zip(ids, ids[1:])]  # by place: what the pair that begins there makes
        queue = [found >> 32 << 32 | i for i, found in enumerate(pairs) if found is not None]
        heapify(queue)
        pairs.append(None)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while queue:
            entry = heappop(queue)
            i = entry & 0xFFFFFFFF
            found = pairs[i]
            if found is None or found >> 32 != entry >> 32:
                continue
            j = after[i]
            new = ids[i] = found & 0xFFFFFFFF
            ids[j], pairs[j] = -1, None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                found = pairs[i] = find(new << 32 | ids[k])
                if found is not None:
                    heappush(queue, found >> 32 << 32 | i)
            else:
                pairs[i] = None
            h = before[i]
            if h >= 0:
                found = pairs[h] = find(ids[h] << 32 | new)
                if found is not None:
                    heappush(queue, found >> 32 << 32 | h)
        return [i for i in ids if i >= 0]

    def unit(self, unit: str) -> bytes:
        """Ids of a unit as little-endian 32-bit integers. Words are remembered apart from the marks that follow them."""
        memory, out = self.memory, []
        for x in pretokens.unit_pretokens(unit, self.path):
            found = memory.get(x) if x is not unit and x.removeprefix(" ").isalpha() else None
            if found is None:
                ids = self.merged(x.encode())
                found = struct.pack(f"<{len(ids)}I", *ids)
                if x.removeprefix(" ").isalpha():
                    memory[x] = found
            out.append(found)
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian 32-bit integers; special strings in it become their ids."""
        if not pretokens.plain(text, self.path):
            stretches, specials = pretokens.between_specials(text, self.path)
            out = []
            for i, s in enumerate(stretches):
                out += [self.whole(s)] if s else []
                out += [np.array([self.special[specials[i]]], "<u4").tobytes()] if i < len(specials) else []
            return b"".join(out)
        memory, units = self.memory, pretokens.UNITS(text)
        if len(memory) > self.REMEMBERED:
            memory.clear()
        for x in set(units).difference(memory):
            memory[x] = self.unit(x)
        return b"".join(map(memory.__getitem__, units))

    def whole(self, text: str) -> bytes:
        """Ids of a text without special strings, whose pre-tokens are the library's."""
        out = [i for x in pretokens.library_pretokens(text, self.path) for i in self.merged(x.encode())]
        return struct.pack(f"<{len(out)}I", *out)

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.strings.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def byte_pairs(path: str) -> BytePairs:
    return BytePairs(path)


def encode_texts(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key and ids (binary: little-endian unsigned 32-bit integers) of every text.

    A narrow pass without a shuffle: a worker remembers a bounded number of encoded units. Null texts are empty and have
    no ids; repeated rows give repeated results; other columns are ignored.
    """

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = byte_pairs(path)
        for batch, texts in pieces(batches, text):
            ids = pa.array([coder.encode(x.decode()) for x in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], ["key", "ids"])

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias(text)).mapInArrow(encoded, "key long, ids binary")
    return rows.withColumnRenamed("key", key)


def decode_ids(rows: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """rows with a column `decoded`: the text of the ids. Null ids give null."""

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = byte_pairs(path)
        for batch in batches:
            at = batch.schema.get_field_index(ids)
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                out = [None if x is None else coder.decode(np.frombuffer(x, "<u4").tolist()) for x in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.string())], [*part.schema.names, "decoded"])

    kept = rows.drop("decoded")
    return kept.mapInArrow(decoded, widened(kept.schema, decoded="string"))


def encoding_digests(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_tokens, ids_sha256, decoded_sha256 of every text."""
    rows = decode_ids(encode_texts(docs, path, text, key), path)
    return rows.select(
        key,
        F.floor(F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )



"""Removal of repeated passages: every byte of a string of 100 bytes that also starts earlier in the corpus."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import NULL_ID, free_names, id_key, packed, pieces, stored, text_tie, trim, unpacked
from tessera.llm.suffix_array import permuted_common_prefixes, suffix_array

#: Bytes of the strings that are compared, and of the grams of which each string's least is its anchor.
LENGTH, GRAM = 100, 32
#: Text of a block of documents, of a segment in which anchors are found, and of a shard whose suffixes are sorted.
BLOCK_BYTES, SEGMENT, SHARD_BYTES = 16 << 20, 1 << 19, 1 << 20
#: Contexts of one anchor that meet in one shard at most; more are dealt out as pairs of blocks.
CONTEXTS = 10_000
#: Text of the corpus whose lists of anchors, and whose contexts, one group gets: groups grow in number, not in size.
LISTED_TEXT, SENT_TEXT = 96 << 20, 16 << 20
_BLOCK = "block long, keys binary, texts binary, size long"


# Anchors


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    base, n = 0x9E3779B97F4A7C15, SEGMENT + LENGTH + 1
    out = []
    for b in (base, pow(base, -1, 2**64)):
        p = np.full(n, b, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p))
    return out[0], out[1]


def _grams(buf: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each position of buf."""
    up, down = _powers()
    n = len(buf)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
    x = (total[GRAM:] - total[:-GRAM]) * down[: n - GRAM + 1]
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def contexts(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of window starts (first, last) with one anchor, and 48 bits of the anchor's hash, over the documents of buf.

    A window is LENGTH bytes of one document; its anchor is its least gram, the leftmost of equals. Equal windows have
    equal anchors at the same place, so they can only be found among the contexts of one hash.
    """
    n = len(buf)
    edge = np.zeros(n + 1, np.int32)
    long = ends - starts >= LENGTH
    np.add.at(edge, starts[long], 1)
    np.add.at(edge, ends[long] - LENGTH + 1, -1)
    valid = np.cumsum(edge[:n]) > 0
    los, his, hashes = [], [], []
    for s in range(0, max(0, n - LENGTH + 1), SEGMENT):
        part = buf[s : s + SEGMENT + LENGTH - 1]
        count = len(part) - LENGTH + 1
        ok = valid[s : s + count]
        if not ok.any():
            continue
        gram = _grams(part)
        key = (gram & ~np.uint64(0x1FFFFF)) | np.arange(len(gram), dtype=np.uint64)
        span, least = 1, key
        while 2 * span <= LENGTH - GRAM + 1:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        rest = LENGTH - GRAM + 1 - span
        least = np.minimum(least[: len(least) - rest], least[rest:])[:count] if rest else least[:count]
        anchor = (least & np.uint64(0x1FFFFF)).astype(np.int64)
        at = np.flatnonzero(ok)
        a = anchor[at]
        first = np.concatenate([[True], (a[1:] != a[:-1]) | (at[1:] != at[:-1] + 1)])
        lo = at[first]
        hi = at[np.concatenate([np.flatnonzero(first)[1:] - 1, [len(at) - 1]])]
        los.append(lo + s)
        his.append(hi + s)
        hashes.append(gram[a[first]] >> np.uint64(16))
    if not los:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64)
    return np.concatenate(los), np.concatenate(his), np.concatenate(hashes)


class _Docs:
    """Documents of a block in order: by key, then by a hash of the text; of repeated rows one."""

    def __init__(self, keys: bytes, texts: bytes):
        raw = zstandard.ZstdDecompressor().decompress(texts)
        table = np.frombuffer(keys, np.int64).reshape(-1, 3)
        ends = np.cumsum(table[:, 2])
        self.rows = table
        self.texts = [raw[e - n : e] for e, n in zip(ends.tolist(), table[:, 2].tolist())]
        order = np.lexsort((table[:, 1], table[:, 0]))
        sorted_keys = table[order, :2]
        new = np.concatenate([[True], (sorted_keys[1:] != sorted_keys[:-1]).any(axis=1)]) if len(order) else np.zeros(0, bool)
        self.order = order[new]
        #: The row that stands for each row: the first of its key and hash.
        self.stands = np.empty(len(order), np.int64)
        self.stands[order] = self.order[np.cumsum(new) - 1]

    def runs(self, skipped: np.ndarray | None = None, most: int = 2 << 20) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Consecutive documents of about `most` bytes: their numbers, joined bytes, starts and ends."""
        held, size = [], 0
        for i in (self.order if skipped is None else self.order[~np.isin(self.order, skipped)]).tolist():
            held.append(i)
            size += len(self.texts[i])
            if size >= most:
                yield self._run(held)
                held, size = [], 0
        if held:
            yield self._run(held)

    def _run(self, numbers: list[int]):
        texts = [self.texts[i] for i in numbers]
        ends = np.cumsum([len(x) for x in texts])
        return np.array(numbers), np.frombuffer(b"".join(texts), np.uint8), ends - np.array([len(x) for x in texts]), ends


# Passes


def repeated_passages(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, tie (XXH64 of the text), n_bytes, spans (array of begin and end: the maximal removed runs of bytes) and kept
    (binary) of every row.

    A byte goes if a string of LENGTH bytes that covers it also starts earlier: in a document of a smaller id, or earlier
    in the same one. Strings are judged on the input; they never cross documents. Null texts are empty; null
    ids come last, and the largest long counts as null; rows of one id are ordered by a hash of their text, and repeated rows
    get the same result. Other columns are ignored. An empty table gives an empty result.

    1. Documents are read once and stored in blocks. Each block lists its anchors' hashes with their numbers, and the
       SHA-256 of its documents.
    2. The lists are dealt out by hash; hashes with two or more anchors return to their blocks, with their numbers, and so
       do documents that an earlier one equals: all of such a copy goes, and none of it is looked at again.
    3. Each block sends the contexts (the windows of one anchor, about 140 bytes) of repeated anchors, each distinct one once,
       as compressed arrays. Contexts that the block has already are compared with those as bytes, and stay there.
    4. Contexts meet by hash in shards. A shard's suffixes are sorted by induction; neighbours whose common prefix has
       LENGTH bytes or more are equal windows, of which the earliest stays.
    5. Spans return to their blocks, which cut them out.
    Groups in which lists and contexts meet grow in number with the text, not in size. Anchors that are everywhere come
    once a block, and an anchor of very many contexts is dealt out as pairs of blocks.
    """
    rows = docs.select(id_key(key).alias("key"), F.col(text).alias(text))
    blocks = stored(rows.mapInArrow(_blocked(text), _BLOCK))
    total = blocks.agg(F.sum("size")).first()[0] or 0
    listed = blocks.mapInArrow(_listed(1 + total // LISTED_TEXT), "part long, block long, anchors binary, docs binary")
    repeated = listed.groupBy("part").applyInArrow(_repeated, "of long, anchors binary, copies binary")
    sent = blocks.groupBy("block").cogroup(repeated.groupBy("of")).applyInArrow(_contexts(1 + total // SENT_TEXT), "part long, block long, contexts binary, own binary")
    spans = sent.groupBy("part").applyInArrow(_matched, "of long, spans binary")
    schema = "key long, tie long, n_bytes long, spans array<struct<begin: long, end: long>>, kept binary"
    out = blocks.groupBy("block").cogroup(spans.groupBy("of")).applyInArrow(_cut, schema)
    return out.withColumnRenamed("key", key)


def signed(x: int) -> int:
    """A 64-bit number as Spark's long."""
    return x - (1 << 64) if x >> 63 else x


def _blocked(text: str):
    def blocked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        number = (task.partitionId() if task else 0) << 24
        keys, texts, size = [], [], 0

        def row() -> pa.RecordBatch:
            packed_texts = zstandard.ZstdCompressor(3).compress(b"".join(texts))
            columns = [pa.array([number], pa.int64()), pa.array([np.array(keys, np.int64).tobytes()]), pa.array([packed_texts]), pa.array([size], pa.int64())]
            return pa.RecordBatch.from_arrays(columns, ["block", "keys", "texts", "size"])

        for batch, found in pieces(batches, text):
            for k, raw in zip(batch.column(0).to_pylist(), found):
                keys.append((k, signed(xxhash.xxh64_intdigest(raw, 42)), len(raw)))
                texts.append(raw)
                size += len(raw)
            if size >= BLOCK_BYTES:
                yield row()
                number, keys, texts, size = number + 1, [], [], 0
        if keys:
            yield row()

    return blocked


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _parts(part: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each part that occurs and the places, in order, where it does."""
    order = np.argsort(part, kind="stable")
    edges = np.searchsorted(part[order], np.arange(parts + 1)).tolist()
    for p, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
        if a < b:
            yield p, order[a:b]


def _steps(ascending: np.ndarray) -> np.ndarray:
    return np.diff(ascending, prepend=ascending[:1] * 0)


def _table(rows: list[tuple], **kinds: pa.DataType) -> pa.Table:
    columns = zip(*rows) if rows else ([],) * len(kinds)
    return pa.table([pa.array(list(c), t) for c, t in zip(columns, kinds.values())], list(kinds))


def _listed(parts: int):
    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, keys, texts in zip(*(batch.column(c).to_pylist() for c in ("block", "keys", "texts"))):
                docs = _Docs(keys, texts)
                hashes = [contexts(buf, starts, ends)[2] for _, buf, starts, ends in docs.runs()]
                names, counts = np.unique(np.concatenate([np.zeros(0, np.uint64), *hashes]), return_counts=True)
                out = []
                for p, at in _parts((_mixed(names) % np.uint64(parts)).astype(np.int64), parts):
                    out.append((p, block, packed(_steps(names[at]), counts[at].astype(np.int32)), None))
                long = np.array([i for i in docs.order.tolist() if len(docs.texts[i]) >= LENGTH], np.int32)
                sha = np.array([np.frombuffer(hashlib.sha256(docs.texts[i]).digest(), np.uint64) for i in long.tolist()], np.uint64).reshape(-1, 4)
                for p, at in _parts((sha[:, 0] % np.uint64(parts)).astype(np.int64), parts):
                    out.append((p, block, None, packed(sha[at].ravel(), docs.rows[long[at], 0], docs.rows[long[at], 1], long[at])))
                yield from _table(out, part=pa.int64(), block=pa.int64(), anchors=pa.binary(), docs=pa.binary()).to_batches()

    return listed


def _repeated(_, rows):
    """To each block, of the anchors it lists, those that occur twice or more, with their numbers; and its copies."""
    out = []
    held = [(b, x) for b, x in zip(rows.column("block").to_pylist(), rows.column("anchors").to_pylist()) if x]
    if held:
        lists = [unpacked(x) for _, x in held]
        hashes = [np.cumsum(h, dtype=np.uint64) for h, _ in lists]
        names, at = np.unique(np.concatenate(hashes), return_inverse=True)
        total = np.bincount(at, np.concatenate([c for _, c in lists])).astype(np.int64)
        begin = 0
        for (block, _), part in zip(held, hashes):
            here = at[begin : begin + len(part)]
            begin += len(part)
            here = here[total[here] > 1]
            if len(here):
                out.append((block, packed(_steps(names[here]), total[here]), None))
    held = [(b, unpacked(x)) for b, x in zip(rows.column("block").to_pylist(), rows.column("docs").to_pylist()) if x]
    if held:
        sha = np.concatenate([x[0] for _, x in held]).reshape(-1, 4)
        doc, tie, row = (np.concatenate([x[i] for _, x in held]) for i in (1, 2, 3))
        block = np.repeat([b for b, _ in held], [len(x[3]) for _, x in held])
        order = np.lexsort((tie, doc, *sha.T))
        new = np.concatenate([[True], (sha[order[1:]] != sha[order[:-1]]).any(axis=1)])
        first = order[new][np.cumsum(new) - 1]
        copy = order[(doc[order] != doc[first]) | (tie[order] != tie[first])]
        for b in np.unique(block[copy]).tolist():
            out.append((b, None, packed(row[copy[block[copy] == b]])))
    return _table(out, of=pa.int64(), anchors=pa.binary(), copies=pa.binary())


def _contexts(parts: int):
    def found(_, blocks: pa.Table, repeated: pa.Table) -> pa.Table:
        trim()
        lists = [unpacked(x) for x in repeated.column("anchors").to_pylist() if x]
        hashes = np.concatenate([np.zeros(0, np.uint64), *(np.cumsum(h, dtype=np.uint64) for h, _ in lists)])
        counts = np.concatenate([np.zeros(0, np.int64), *(c for _, c in lists)])
        order = np.argsort(hashes)
        hashes, counts = hashes[order], counts[order]
        copies = np.concatenate([np.zeros(0, np.int32), *(unpacked(x)[0] for x in repeated.column("copies").to_pylist() if x)])
        out: list[tuple] = []
        for block, keys, texts in zip(*(blocks.column(c).to_pylist() for c in ("block", "keys", "texts"))):
            if len(hashes) or len(copies):
                out += _sent(block, _Docs(keys, texts), copies, hashes, counts, parts)
        return _table(out, part=pa.int64(), block=pa.int64(), contexts=pa.binary(), own=pa.binary())

    return found


def _sent(block: int, docs: _Docs, copies: np.ndarray, hashes: np.ndarray, counts: np.ndarray, parts: int) -> Iterator[tuple]:
    """Rows of a block: its contexts, each distinct one once, by part; and the spans that it knows of itself."""
    seen: dict[bytes, int] = {}
    kept, own = [], [(copies.astype(np.int64), np.zeros(len(copies), np.int64), docs.rows[copies, 2])]
    for numbers, buf, starts, ends in docs.runs(copies):
        lo, hi, anchor = contexts(buf, starts, ends)
        at = np.minimum(np.searchsorted(hashes, anchor), len(hashes) - 1) if len(hashes) else np.zeros(len(anchor), np.int64)
        known = hashes[at] == anchor if len(hashes) else np.zeros(len(anchor), bool)
        lo, size, anchor, total = lo[known], hi[known] + LENGTH - lo[known], anchor[known], counts[at[known]]
        of = np.searchsorted(starts, lo, "right") - 1
        raw, before = buf.tobytes(), len(seen)
        place = np.fromiter((seen.setdefault(raw[a : a + n], len(seen)) for a, n in zip(lo.tolist(), size.tolist())), np.int64, len(lo))
        new = np.diff(np.maximum.accumulate(np.concatenate([[before - 1], place]))) > 0  # places are given in order
        row, lo = numbers[of], lo - starts[of]
        kept.append((row[new], lo[new], size[new], anchor[new], total[new]))
        own.append((row[~new], lo[~new], size[~new]))
    row, lo, size = (np.concatenate(x) for x in zip(*own))
    if len(row):
        yield block % parts, block, None, packed(*(x.astype(np.int32) for x in merged_spans(row, lo, size)))
    if not seen:
        return
    row, lo, size, anchor, total = (np.concatenate(x) for x in zip(*kept))
    at = np.cumsum(size) - size
    which, pair = _dealt(list(seen), -(-total // CONTEXTS))
    text = np.frombuffer(b"".join(seen), np.uint8)
    part = (_mixed(anchor[which] + _mixed(pair.astype(np.uint64) + np.uint64(1))) % np.uint64(parts)).astype(np.int64)
    for p, here in _parts(part, parts):
        k = which[here]
        names, of = np.unique(row[k], return_inverse=True)
        arrays = [anchor[k], pair[here], lo[k].astype(np.int32), size[k].astype(np.int32), of.astype(np.int32)]
        arrays += [names.astype(np.int32), docs.rows[names, 0], docs.rows[names, 1]]
        n = size[k]
        take = np.repeat(at[k] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        yield p, block, packed(*arrays, text[take]), None


def _dealt(texts: list[bytes], many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Contexts, and the pair of blocks of contexts to which each goes: those of an anchor that is cut in `many` blocks
    go to each pair that has their own block."""
    which, pair = [np.flatnonzero(many <= 1)], [np.zeros(int((many <= 1).sum()), np.int64)]
    for k in np.flatnonzero(many > 1).tolist():
        m = int(many[k])
        mine, j = xxhash.xxh64_intdigest(texts[k], 7) % m, np.arange(m)
        which.append(np.full(m, k))
        pair.append(np.minimum(j, mine) * m + np.maximum(j, mine))
    return np.concatenate(which), np.concatenate(pair)


def merged_spans(row: np.ndarray, lo: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The union of spans (row, begin, size) as maximal runs, in order."""
    begin = (row.astype(np.int64) << 32) + lo
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], (begin + size)[order]
    reach = np.maximum.accumulate(end)
    first = np.flatnonzero(np.concatenate([[True], begin[1:] > reach[:-1]])) if len(begin) else np.zeros(0, np.int64)
    last = np.append(first[1:], len(begin)) - 1 if len(first) else first
    return begin[first] >> 32, begin[first] & 0xFFFFFFFF, reach[last] - begin[first]


def _matched(_, rows):
    """To each block, the spans of windows that start earlier elsewhere, from the contexts of one part."""
    trim()
    spans: list[np.ndarray] = [np.zeros((0, 4), np.int64)]
    fields: list[list[np.ndarray]] = [[] for _ in range(8)]
    texts: list[bytes] = []
    for block, sent, own in zip(*(rows.column(c).to_pylist() for c in ("block", "contexts", "own"))):
        if own:
            row, lo, size = unpacked(own)
            spans.append(np.stack([np.full(len(row), block), row, lo, size], axis=1).astype(np.int64))
        if sent:
            anchor, pair, lo, size, of, names, doc, tie, text = unpacked(sent)
            ends, raw = np.cumsum(size, dtype=np.int64), text.tobytes()
            texts += [raw[e - n : e] for e, n in zip(ends.tolist(), size.tolist())]
            for held, x in zip(fields, (anchor, pair, np.full(len(of), block), names[of], doc[of], tie[of], lo, size)):
                held.append(x)
    if texts:
        anchor, pair, block, row, doc, tie, lo, size = (np.concatenate(x) for x in fields)
        row, lo, size = row.astype(np.int64), lo.astype(np.int64), size.astype(np.int64)
        order = np.lexsort((pair, anchor))
        a, p = anchor[order], pair[order]
        edges = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (p[1:] != p[:-1]), [True]]))
        volume = np.concatenate([[0], np.cumsum(size[order])])[edges]
        begin = 0
        while begin < len(edges) - 1:  # shards of whole groups, of SHARD_BYTES of text or of one group
            end = max(begin + 1, int(np.searchsorted(volume, volume[begin] + SHARD_BYTES)))
            end = min(end, len(edges) - 1)
            here = order[edges[begin] : edges[end]]
            columns = (x[here] for x in (anchor, block, row, doc, tie, lo, size))
            spans.append(_shard([texts[i] for i in here.tolist()], *columns))
            begin = end
    block, row, lo, size = np.concatenate(spans).T
    order = np.argsort(block, kind="stable")
    edges = np.flatnonzero(np.concatenate([[True], block[order[1:]] != block[order[:-1]], [True]])).tolist() if len(order) else [0]
    out = []
    for a, b in zip(edges[:-1], edges[1:]):
        here = order[a:b]
        out.append((int(block[here[0]]), packed(*(x.astype(np.int32) for x in merged_spans(row[here], lo[here], size[here])))))
    return _table(out, of=pa.int64(), spans=pa.binary())


def _shard(texts: list[bytes], anchor, block, row, doc, tie, lo, size) -> np.ndarray:
    """Spans (block, row, begin, size) among contexts, all of any anchor (or pair of blocks of it)."""
    order = np.lexsort((lo, tie, doc))
    first: dict[bytes, int] = {}
    for i in order.tolist():  # the earliest of equal contexts stands for them
        first.setdefault(texts[i], i)
    of = np.fromiter((first[x] for x in texts), np.int64, len(texts))
    same = (doc == doc[of]) & (tie == tie[of]) & (lo == lo[of])
    names = np.fromiter(first.values(), np.int64, len(first))
    # equal windows have equal anchors: a context that is its anchor's only distinct one has none to find. Pairs of one
    # anchor may share the shard, and a context then stands in one of them only, so it is the anchor's that are counted
    _, at, count = np.unique(anchor[names], return_inverse=True, return_counts=True)
    names = names[count[at] > 1]
    begins, lows, sizes = _repeats([texts[i] for i in names.tolist()], names, doc, tie, lo)
    whole = np.stack([block, row, lo, size], axis=1)[~same]
    # a run of a context is one of each row that stands for it: usually itself, and repeated rows of its document
    members = np.flatnonzero(same)
    sorted_runs = np.argsort(begins, kind="stable")
    begins, lows, sizes = begins[sorted_runs], lows[sorted_runs], sizes[sorted_runs]
    a, b = np.searchsorted(begins, of[members]), np.searchsorted(begins, of[members], "right")
    n = b - a
    who = np.repeat(members, n)
    k = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    return np.concatenate([whole, np.stack([block[who], row[who], lo[who] + lows[k], sizes[k]], axis=1)]).astype(np.int64)


def _repeats(texts: list[bytes], names: np.ndarray, doc: np.ndarray, tie: np.ndarray, lo: np.ndarray):
    """Among distinct contexts: name, offset and size of each run of bytes covered by windows that start earlier elsewhere."""
    lengths = np.array([len(x) for x in texts])
    if len(texts) < 2:
        none = np.zeros(0, np.int64)
        return none, none, none
    # UTF-8 has no byte over 247: bytes move up by one, 255 ends a context, and what wraps to 0 the text
    whole = np.frombuffer(b"\xfe".join(texts) + b"\xfe\xff", np.uint8) + np.uint8(1)
    order = suffix_array(whole)
    before, common = permuted_common_prefixes(whole, order)
    starts = np.cumsum(lengths + 1) - lengths - 1
    context = np.repeat(np.arange(len(texts)), lengths + 1)
    inside = np.arange(len(context)) - starts[context]
    window = np.concatenate([inside + LENGTH <= lengths[context], [False]])
    at = order[window[order]]
    linked = common[at] >= LENGTH  # with the suffix before, which then is a window as well
    group = np.cumsum(~linked) - 1
    _, rank = np.unique(np.stack([doc[names], tie[names]], axis=1), axis=0, return_inverse=True)
    place = (rank.ravel()[context[at]] << 32) + lo[names][context[at]] + inside[at]
    least = np.full(group[-1] + 1 if len(group) else 0, np.iinfo(np.int64).max)
    np.minimum.at(least, group, place)
    again = np.zeros(len(whole), bool)
    again[at[place > least[group]]] = True
    edge = np.diff(np.concatenate([[0], again.astype(np.int8), [0]]))
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1
    return names[context[first]], inside[first], last - first + LENGTH


def _cut(_, blocks: pa.Table, spans: pa.Table) -> pa.Table:
    trim()
    lists = [unpacked(x) for x in spans.column("spans").to_pylist()]
    row, lo, size = (np.concatenate([np.zeros(0, np.int32), *(x[i] for x in lists)]) for i in range(3))
    row, lo, size = merged_spans(row, lo, size)
    hi = lo + size
    out: list[tuple] = []
    for keys, texts in zip(*(blocks.column(c).to_pylist() for c in ("keys", "texts"))):
        docs = _Docs(keys, texts)
        a, b = np.searchsorted(row, docs.stands).tolist(), np.searchsorted(row, docs.stands, "right").tolist()
        for (d, t, n), raw, i, j in zip(docs.rows.tolist(), docs.texts, a, b):
            removed = list(zip(lo[i:j].tolist(), hi[i:j].tolist()))
            kept, at = [], 0
            for x, y in removed:
                kept.append(raw[at:x])
                at = y
            kept.append(raw[at:])
            out.append((None if d == NULL_ID else d, t, n, [{"begin": x, "end": y} for x, y in removed], b"".join(kept)))
    span = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
    return _table(out, key=pa.int64(), tie=pa.int64(), n_bytes=pa.int64(), spans=span, kept=pa.binary())


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of spans as maximal runs in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def passage_digests(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_bytes, n_removed, n_spans and kept_sha256 of every row."""
    rows = repeated_passages(docs, text, key)
    return rows.select(
        key,
        "n_bytes",
        (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def without_passages(docs: DataFrame, text: str = "text", key: str = "doc_id", length: str = "n_chars") -> DataFrame:
    """The rows of docs, all columns, with repeated passages cut from their texts and, where there is such a column,
    their lengths in characters anew. A character that a cut goes through is cut as a whole. Columns of any name are kept as
    they are; a null text becomes an empty one; an empty table stays empty; repeated rows stay repeated."""
    kept = repeated_passages(docs, text, key).select(F.coalesce(F.col(key), F.lit(NULL_ID)).alias("k"), F.col("tie").alias("t"), "kept")

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([x.decode("utf-8", "ignore") for x in batch.column(2).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], texts], ["k", "t", "kept"])

    id_, hash_, k, t, cut = free_names(docs.columns, "_id", "_hash", "_key", "_tie", "_kept")
    texts = kept.mapInArrow(decoded, "k long, t long, kept string").dropDuplicates(["k", "t"]).toDF(k, t, cut)
    rest = docs.withColumn(id_, id_key(key)).withColumn(hash_, text_tie(text)).drop(text)
    joined = rest.join(texts, (F.col(id_) == F.col(k)) & (F.col(hash_) == F.col(t)))
    new = {text: F.col(cut), length: F.length(cut).cast(dict(docs.dtypes).get(length, "long"))}
    return joined.select(*[new.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])

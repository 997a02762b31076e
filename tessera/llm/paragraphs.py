"""Removal of repeated paragraphs: MinHash bands for near copies, equal windows for passages inside longer paragraphs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import NULL_ID, id_key, packed, stored, trim, unpacked
from tessera.llm.components import components
from tessera.llm.passages import _BLOCK, _Docs, _blocked, merge_spans
from tessera.llm.simhash import Sets

#: Words of a shingle, of the shortest paragraph that counts, and of a window; window starts of which one is taken. Shorter
#: lines are the marks and notices that many sound documents share.
SHINGLE, PARAGRAPH, WINDOW, STARTS = 5, 20, 20, 28
#: Text of the corpus whose units one group gets: groups grow in number, not in size.
LISTED_TEXT = 96 << 20
#: Bands and rows: a pair of similarity 0.8 shares a band with a probability of 1 - (1 - 0.8 ** 4) ** 10 = 0.995.
BANDS, ROWS = 10, 4
#: Paragraphs of a bucket that one task compares; more are dealt out as pairs of blocks.
BUCKET = 2_000
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15
_SEEDS = (np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0xBF58476D1CE4E5B9)) | np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of values[start:end] for each pair: differences of one running polynomial."""
    n = len(values)
    up, down = np.full(n + 1, _BASE, np.uint64), np.full(n + 1, pow(_BASE, -1, 2**64), np.uint64)
    up[0] = down[0] = 1
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((values + np.uint64(1)) * np.cumprod(up)[:n], out=total[1:])
    size = (ends - starts).astype(np.uint64)
    return _mixed((total[ends] - total[starts]) * np.cumprod(down)[starts] + size)


class Units:
    """The paragraphs and windows of a run of documents: digest, check, document, begin and size in bytes.

    A paragraph is a line of PARAGRAPH words or more. Windows are WINDOW words of a document, line ends ignored;
    of any STARTS consecutive ones the one with the least first shingle is taken, so that two texts that share
    WINDOW + STARTS - 1 = 47 words in a row share a window. Words are compared in lower case (A-Z). The digest comes from
    hashes of words; the check is a hash of the words themselves (XXH3), so that equal units agree in 128 bits.
    """

    def __init__(self, texts: list[bytes]):
        joined = b"\n".join(texts) + b"\n"
        buf = np.frombuffer(joined, np.uint8)
        size = np.array([len(x) for x in texts]) + 1
        first_byte = np.cumsum(size) - size
        space = _SPACE[buf]
        before = np.concatenate([[True], space[:-1]])
        start = np.flatnonzero(~space & before)
        end = np.flatnonzero(space & ~before)
        self.word = word = _hashes(_LOWER[buf], start, end)
        n = len(word)
        document = np.searchsorted(first_byte, start, "right") - 1
        line = np.concatenate([[0], np.cumsum(buf == 10)])[start]
        index = np.arange(n)
        self.shingle = _hashes(word, index[: max(0, n - SHINGLE + 1)], index[SHINGLE - 1 :] + 1)
        edges = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1], [True]])) if n else np.zeros(1, np.int64)
        a, b = edges[:-1], edges[1:]
        long = b - a >= PARAGRAPH
        a, b = a[long], b[long]
        self.n_paragraphs = len(a)
        self.first, self.last = a, b
        w = self._windows(document)
        digests = [_hashes(word, a, b) | np.uint64(1), _hashes(word, w, w + WINDOW) & ~np.uint64(1)]
        self.digest = np.concatenate(digests)
        a, b = np.concatenate([a, w]), np.concatenate([b, w + WINDOW])
        words = b" ".join(joined.lower().split())
        at = np.cumsum(np.concatenate([[0], end - start + 1]))
        of = xxhash.xxh3_64_intdigest
        self.check = np.fromiter((of(words[i:j]) for i, j in zip(at[a].tolist(), (at[b] - 1).tolist())), np.uint64, len(a))
        self.document = document[a] if n else np.zeros(0, np.int64)
        self.begin = start[a] - first_byte[self.document] if n else np.zeros(0, np.int64)
        self.size = end[b - 1] - start[a] if n else np.zeros(0, np.int64)

    def _windows(self, document: np.ndarray) -> np.ndarray:
        n = len(document) - WINDOW + 1
        if n < STARTS:
            return np.zeros(0, np.int64)
        key = (self.shingle[:n] & ~np.uint64(0xFFFFFF)) | (np.arange(n, dtype=np.uint64) & np.uint64(0xFFFFFF))
        span, least = 1, key
        while 2 * span <= STARTS:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if rest := STARTS - span:
            least = np.minimum(least[:-rest], least[rest:])
        m = len(least)
        inside = document[:m] == document[STARTS + WINDOW - 2 : STARTS + WINDOW - 2 + m]
        at = np.flatnonzero(inside)
        offset = ((least[at] & np.uint64(0xFFFFFF)).astype(np.int64) - at) & 0xFFFFFF
        return np.unique(at + offset)

    def shingles(self, k: int) -> np.ndarray:
        """The distinct shingles of paragraph k."""
        return np.unique(self.shingle[self.first[k] : self.last[k] - SHINGLE + 1])

    def bands(self, chosen: np.ndarray) -> np.ndarray:
        """Band keys (paragraphs x BANDS) of the paragraphs chosen."""
        a, size = self.first[chosen], self.last[chosen] - self.first[chosen] - SHINGLE + 1
        if not len(a):
            return np.zeros((0, BANDS), np.uint64)
        at = np.cumsum(size) - size
        flat = self.shingle[np.repeat(a - at, size) + np.arange(int(size.sum()))]
        keys = np.empty((len(a), BANDS), np.uint64)
        for band in range(BANDS):
            key = np.full(len(a), band + 1, np.uint64)
            for row in range(ROWS):
                seed = _SEEDS[band * ROWS + row]
                key = _mixed(key * np.uint64(_BASE) + np.minimum.reduceat(_mixed(flat * seed), at))
            keys[:, band] = key
        return keys


def _runs(keys: bytes, texts: bytes) -> Iterator[tuple[np.ndarray, Units]]:
    """Ids of the documents of each run of a block, in order, and their units."""
    docs = _Docs(keys, texts)
    held, size = [], 0
    for i in docs.order.tolist():
        held.append(i)
        size += len(docs.texts[i])
        if size >= 2 << 20:
            yield docs.rows[held, 0], Units([docs.texts[k] for k in held])
            held, size = [], 0
    if held:
        yield docs.rows[held, 0], Units([docs.texts[k] for k in held])


def _dealt(part: np.ndarray, parts: int, block: int, *columns: np.ndarray) -> pa.RecordBatch:
    """Rows (part, block, the columns' values) of the values whose part it is."""
    order = np.argsort(part, kind="stable")
    edges = np.searchsorted(part[order], np.arange(parts + 1)).tolist()
    cut = [(p, a, b) for p, (a, b) in enumerate(zip(edges[:-1], edges[1:])) if a < b]
    lists = [packed(*(c[order[a:b]] for c in columns)) for _, a, b in cut]
    return pa.RecordBatch.from_arrays([pa.array([p for p, _, _ in cut], pa.int64()), pa.array([block] * len(cut), pa.int64()), pa.array(lists, pa.binary())], ["part", "block", "lists"])


def _part(x: np.ndarray, parts: int) -> np.ndarray:
    return (x >> np.uint64(33)).astype(np.int64) % parts


def _columns(rows: pa.Table, name: str, *kinds: type) -> list[np.ndarray]:
    """The columns that a column of packed arrays holds, of these types, and the row of each value."""
    held = [unpacked(x) for x in rows.column(name).to_pylist()]
    columns = [np.concatenate([np.zeros(0, k), *(x[i] for x in held)]) for i, k in enumerate(kinds)]
    return [*columns, np.repeat(np.arange(len(held)), [len(x[0]) for x in held]).astype(np.int64)]


def _firsts(digest: np.ndarray, doc: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """For each distinct digest, in order, the place where it has the smallest (doc, begin)."""
    order = np.lexsort((begin, doc, digest))
    sorted_digest = digest[order]
    return order[np.concatenate([[True], sorted_digest[1:] != sorted_digest[:-1]])] if len(order) else order


def repeated_paragraphs(docs: DataFrame, text: str = "text", key: str = "doc_id", similarity: float = 0.8) -> DataFrame:
    """One row for each document that loses text: key, n_paragraphs and n_windows (units that go), removed_bytes, spans
    (array of begin and end, in bytes of the UTF-8 text) and kept_in (ids of the documents with the copies that stay).

    Paragraphs are linked if they are equal or if the Jaccard similarity of their sets of 5-word shingles is at least
    `similarity`; windows if they are equal. Of each component of links the earliest unit (by document id, then by
    place) stays and all others go. Null texts are empty; null ids come last, as null, and the largest long counts as null;
    rows of one id count as one document; an empty table gives an empty result and other columns are ignored.

    1. Documents are stored in blocks; a block lists its units' digests, and the band keys of its distinct paragraphs.
    2. Keys are dealt out by band; paragraphs that share one are asked of one block that has them, with their bucket.
       Buckets of the same members, as near copies have in most bands, are one.
    3. In a bucket, shingle sets are compared exactly, and a spanning forest of the links is kept.
    4. Components of links give each digest its component's earliest unit; digests go back to all blocks that list them, and
       a unit goes if its check agrees too.
    Groups in which digests and keys meet grow in number with the text, not in size.
    """
    rows = docs.select(id_key(key).alias("key"), F.col(text).alias(text))
    blocks = stored(rows.mapInArrow(_blocked(text), _BLOCK))
    parts = 1 + (blocks.agg(F.sum("size")).first()[0] or 0) // LISTED_TEXT
    dealt = "part long, block long, lists binary"
    listed = stored(blocks.mapInArrow(_listed(parts), dealt))
    banded = blocks.mapInArrow(_banded(parts), dealt)
    asked = banded.groupBy("part").applyInArrow(_colliding, "of long, lists binary")
    members = blocks.groupBy("block").cogroup(asked.groupBy("of")).applyInArrow(_members, "bucket long, pair long, node long, shingles binary")
    sorted_members = members.repartition("bucket", "pair").sortWithinPartitions("bucket", "pair", "node")
    links = sorted_members.mapInArrow(_verified(similarity), "a long, b long")
    roots = stored(components(links).select(_part_of("node", parts).alias("at"), "node", "root"))
    firsts = listed.groupBy("part").cogroup(roots.groupBy("at")).applyInArrow(_first_units, "node long, root long, doc long, begin long")
    earliest = firsts.groupBy("root").agg(F.min(F.struct("doc", "begin")).alias("stays")).withColumnRenamed("root", "_root")
    named = roots.join(earliest, F.col("root") == F.col("_root")).select("at", "node", "stays.doc", "stays.begin")
    answers = listed.groupBy("part").cogroup(named.groupBy("at")).applyInArrow(_answers, "of long, lists binary")
    schema = "key long, n_paragraphs long, n_windows long, removed_bytes long, spans array<struct<begin: long, end: long>>, kept_in array<long>"
    out = blocks.groupBy("block").cogroup(answers.groupBy("of")).applyInArrow(_removed, schema)
    return out.withColumnRenamed("key", key)


def _part_of(column: str, parts: int):
    return F.pmod(F.shiftrightunsigned(column, 33), F.lit(parts)).cast("long")


def _units_of(block_keys: bytes, block_texts: bytes) -> tuple[np.ndarray, ...]:
    """digest, check, document id, begin, size of all units of a block, and whether each is a paragraph."""
    out = []
    for ids, u in _runs(block_keys, block_texts):
        out.append((u.digest, u.check, ids[u.document], u.begin, u.size, np.arange(len(u.digest)) < u.n_paragraphs))
    kinds = (np.uint64, np.uint64, np.int64, np.int64, np.int64, bool)
    return tuple(np.concatenate([np.zeros(0, k), *(x[i] for x in out)]) for i, k in enumerate(kinds))


def _listed(parts: int):
    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, keys, texts in zip(*(batch.column(c).to_pylist() for c in ("block", "keys", "texts"))):
                digest, check, doc, begin, _, _ = _units_of(keys, texts)
                first = _firsts(digest, doc, begin)
                names, counts = np.unique(digest, return_counts=True)
                yield _dealt(_part(names, parts), parts, block, names, check[first], doc[first], begin[first].astype(np.int32), counts.astype(np.int32))

    return listed


def _banded(parts: int):
    def banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, keys, texts in zip(*(batch.column(c).to_pylist() for c in ("block", "keys", "texts"))):
                seen, bands, nodes = np.zeros(0, np.uint64), [], []
                for _, u in _runs(keys, texts):
                    names, at = np.unique(u.digest[: u.n_paragraphs], return_index=True)
                    new = ~np.isin(names, seen)
                    names, at = names[new], at[new]
                    seen = np.concatenate([seen, names])
                    bands.append(u.bands(at).ravel())
                    nodes.append(np.repeat(names, BANDS))
                band, node = np.concatenate(bands), np.concatenate(nodes)
                yield _dealt(_part(band, parts), parts, block, band, node)

    return banded


def _colliding(_, rows):
    band, node, row = _columns(rows, "lists", np.uint64, np.uint64)
    block = np.array(rows.column("block").to_pylist(), np.int64)[row]
    order = np.lexsort((block, node, band))
    band, node, block = band[order], node[order], block[order]
    first = np.concatenate([[True], (band[1:] != band[:-1]) | (node[1:] != node[:-1])])  # one block speaks for a node
    band, node, block = band[first], node[first], block[first]
    starts = np.flatnonzero(np.concatenate([[True], band[1:] != band[:-1]]))
    sizes = np.diff(np.append(starts, len(band)))
    with np.errstate(over="ignore"):
        name = np.add.reduceat(_mixed(node), starts) * np.uint64(_BASE) + np.bitwise_xor.reduceat(_mixed(node * np.uint64(3)), starts)
    many = np.repeat(sizes > 1, sizes)
    bucket, size = np.repeat(name, sizes)[many], np.repeat(sizes, sizes)[many]
    node, block = node[many], block[many]
    _, once = np.unique(np.stack([bucket, node]), axis=1, return_index=True) if len(node) else (None, np.zeros(0, np.int64))
    bucket, size, node, block = bucket[once], size[once], node[once], block[once]
    order = np.argsort(block, kind="stable")
    bucket, size, node, block = bucket[order], size[order], node[order], block[order]
    edges = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1], [True]])).tolist() if len(block) else [0]
    cut = list(zip(edges[:-1], edges[1:]))
    lists = [packed(node[a:b], bucket[a:b], size[a:b].astype(np.int64)) for a, b in cut]
    return pa.table({"of": pa.array([int(block[a]) for a, _ in cut], pa.int64()), "lists": pa.array(lists, pa.binary())})


def _members(_, blocks: pa.Table, asked: pa.Table) -> pa.Table:
    trim()
    node, bucket, size, _ = _columns(asked, "lists", np.uint64, np.uint64, np.int64)
    order = np.argsort(node, kind="stable")
    node, bucket, size = node[order], bucket[order], size[order]
    out: dict[tuple[int, int, int], bytes] = {}
    wanted = np.unique(node)
    for keys, texts in zip(blocks.column("keys").to_pylist(), blocks.column("texts").to_pylist()):
        for _, u in _runs(keys, texts):
            names, at = np.unique(u.digest[: u.n_paragraphs], return_index=True)
            for name, k in zip(names[(here := np.isin(names, wanted))].tolist(), at[here].tolist()):
                raw = None
                for i in range(np.searchsorted(node, np.uint64(name)), np.searchsorted(node, np.uint64(name), "right")):
                    raw = raw or u.shingles(k).tobytes()
                    blocks_of = -(-int(size[i]) // BUCKET)
                    mine = (name >> 7) % blocks_of
                    for j in range(blocks_of):
                        out[int(bucket[i]), min(j, mine) * blocks_of + max(j, mine), name] = raw
    signed = lambda i: pa.array(np.array([k[i] for k in out], np.uint64).view(np.int64))
    return pa.table([signed(0), pa.array([k[1] for k in out], pa.int64()), signed(2), pa.array(list(out.values()), pa.binary())], ["bucket", "pair", "node", "shingles"])


def _verified(similarity: float):
    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches):
            node = group.column("node").to_numpy()
            node, at = np.unique(node, return_index=True)
            if len(node) < 2:
                continue
            raw = group.column("shingles").to_pylist()
            root = similar([np.frombuffer(raw[i], np.uint64) for i in at.tolist()], similarity)
            other = np.flatnonzero(root != np.arange(len(root)))
            if len(other):
                yield pa.RecordBatch.from_arrays([pa.array(node[other]), pa.array(node[root[other]])], ["a", "b"])

    return verified


def similar(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """The first set of each set's component of links by exact Jaccard similarity.

    Sets that nothing has reached are compared with all, until all are reached; then those outside the largest
    component are. Sets that were never compared are both in that component, so that no link between components is missed.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(n), sizes)
    found, reached, asked = Sets(n), np.zeros(n, bool), np.zeros(n, bool)

    def ask(k: int) -> None:
        common = np.bincount(owner[np.isin(flat, sets[k])], minlength=n)
        near = np.flatnonzero(common >= similarity * (sizes + sizes[k] - common) - 1e-9)
        asked[k] = True
        reached[near] = True
        reached[k] = True
        found.link(np.full(len(near), k), near)

    while not reached.all():
        ask(int(np.argmin(reached)))
    names, counts = np.unique(found.root, return_counts=True)
    for k in np.flatnonzero((found.root != names[np.argmax(counts)]) & ~asked).tolist():
        ask(k)
    return found.root


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of the rows of one (bucket, pair) each."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        b, p = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        edges = np.flatnonzero((b[1:] != b[:-1]) | (p[1:] != p[:-1])) + 1
        for i, j in zip([0, *edges.tolist()], [*edges.tolist(), len(b)]):
            if held and (b[i], p[i]) != last:
                yield pa.Table.from_batches(held)
                held = []
            last = (b[i], p[i])
            held.append(batch.slice(i, j - i))
    if held:
        yield pa.Table.from_batches(held)


def _first_units(_, listed: pa.Table, roots: pa.Table) -> pa.Table:
    node, root = roots.column("node").to_numpy(), roots.column("root").to_numpy()
    digest, _, doc, begin, _, _ = _columns(listed, "lists", np.uint64, np.uint64, np.int64, np.int64, np.int32)
    digest = digest.view(np.int64)
    order = np.argsort(node)
    node, root = node[order], root[order]
    at = np.minimum(np.searchsorted(node, digest), max(0, len(node) - 1))
    here = node[at] == digest if len(node) else np.zeros(len(digest), bool)
    return pa.table({"node": digest[here], "root": root[at[here]], "doc": doc[here], "begin": begin[here]})


def _answers(_, listed: pa.Table, named: pa.Table) -> pa.Table:
    """To each block: the digests it lists that others repeat or are linked to, their check, and the unit that stays."""
    digest, check, doc, begin, count, row = _columns(listed, "lists", np.uint64, np.uint64, np.int64, np.int64, np.int32)
    first = _firsts(digest, doc, begin)
    names, at = np.unique(digest, return_inverse=True)
    stays_doc, stays_begin = doc[first], begin[first]
    agrees = check == check[first][at]  # units of one digest that differ are not told of each other
    told = np.bincount(at, count * agrees, minlength=len(names)) > 1
    if named.num_rows:
        node = named.column("node").to_numpy().view(np.uint64)
        k = np.searchsorted(names, node)
        stays_doc[k], stays_begin[k], told[k] = named.column("doc").to_numpy(), named.column("begin").to_numpy(), True
    out = []
    tells = told[at] & agrees
    starts = np.searchsorted(row, np.arange(listed.num_rows + 1)).tolist()
    for block, a, b in zip(listed.column("block").to_pylist(), starts[:-1], starts[1:]):
        here = a + np.flatnonzero(tells[a:b])
        k = at[here]
        if len(k):
            out.append((block, packed(names[k], check[here], stays_doc[k], stays_begin[k].astype(np.int32))))
    return pa.table({"of": pa.array([b for b, _ in out], pa.int64()), "lists": pa.array([x for _, x in out], pa.binary())})


def _removed(_, blocks: pa.Table, answers: pa.Table) -> pa.Table:
    trim()
    name, known, stays_doc, stays_begin, _ = _columns(answers, "lists", np.uint64, np.uint64, np.int64, np.int64)
    order = np.argsort(name)
    name, known, stays_doc, stays_begin = name[order], known[order], stays_doc[order], stays_begin[order]
    lost: dict[int, list[tuple[int, int, bool, int]]] = {}
    for keys, texts in zip(blocks.column("keys").to_pylist(), blocks.column("texts").to_pylist()):
        if not len(name):
            continue
        digest, check, doc, begin, size, paragraph = _units_of(keys, texts)
        at = np.minimum(np.searchsorted(name, digest), len(name) - 1)
        goes = (name[at] == digest) & (known[at] == check) & ((stays_doc[at] != doc) | (stays_begin[at] != begin))
        for d, b, s, p, k in zip(*(x[goes].tolist() for x in (doc, begin, size, paragraph)), stays_doc[at[goes]].tolist()):
            lost.setdefault(d, []).append((b, b + s, p, k))
    out = []
    for d, units in lost.items():
        spans = merge_spans([(a, b) for a, b, _, _ in units])
        paragraphs = sum(p for _, _, p, _ in units)
        row = (
            None if d == NULL_ID else d,
            paragraphs,
            len(units) - paragraphs,
            sum(b - a for a, b in spans),
            [{"begin": a, "end": b} for a, b in spans],
            sorted({k for _, _, _, k in units}),
        )
        out.append(row)
    span = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), span, pa.list_(pa.int64()))
    columns = zip(*out) if out else ([],) * 6
    names = ["key", "n_paragraphs", "n_windows", "removed_bytes", "spans", "kept_in"]
    return pa.table([pa.array(list(c), t) for c, t in zip(columns, kinds)], names)

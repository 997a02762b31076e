"""SimHash fingerprints and near-duplicate classes by bit-sliced comparison."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import NULL_ID, free_names, id_key, pieces, stored, text_tie
from tessera.llm.components import components

#: Rows of a bucket that one task compares; larger buckets are cut into blocks.
BLOCK = 16_384
#: Up to so many rows of a bucket are compared by shifts, all buckets at once.
SMALL = 128
#: Planes that are counted before blocks are abandoned.
STEP = 8
#: Large buckets that are sent to all executors at most; more of them are joined by a shuffle.
BROADCAST = 10_000
#: Text of a coarse class that one task compares by shingles; larger ones are cut into blocks.
SET_BYTES = 16 << 20


# Fingerprints


def shingle_hashes(raw: bytes, width: int) -> np.ndarray:
    """XXH64 (seed 42) of the shingles of `width` words, repeats included; fewer words are one shingle; none: empty."""
    words = raw.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(size) - 1
    starts = ends - size + 1
    if len(words) > width:
        starts, ends = starts[: len(words) - width + 1], ends[width - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(line[a:b], 42) for a, b in zip(starts.tolist(), ends.tolist())), np.uint64, len(starts))


def fingerprint(hashes: np.ndarray, words: int = 1) -> np.ndarray:
    """Bits that over half the hashes set, as `words` 64-bit words. Further words come from hashes mixed anew."""
    votes = np.zeros((words, 64), np.int64)
    for begin in range(0, len(hashes), 65_536):
        part = hashes[begin : begin + 65_536]
        for w in range(words):
            bits = np.unpackbits((_mixed(part, w) if w else part).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            votes[w] += bits.sum(axis=0, dtype=np.int64)
    return np.packbits(2 * votes > len(hashes), axis=1, bitorder="little").view("<u8").reshape(words).astype(np.uint64)


def _mixed(x: np.ndarray, salt: int) -> np.ndarray:
    x = x + np.uint64(0x9E3779B97F4A7C15 * salt & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprints(docs: DataFrame, shingle: int = 4, words: int = 1, text: str = "text", key: str = "doc_id") -> DataFrame:
    """id (long; a null id is the largest long), tie (XXH64 of the text) and w0 ... of every row. A null text is empty, its
    fingerprint zero."""
    names = [f"w{i}" for i in range(words)]

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches, text):
            found = np.array([fingerprint(shingle_hashes(x, shingle), words) for x in texts], np.uint64).reshape(-1, words)
            columns = [pa.array(found[:, i].copy().view(np.int64)) for i in range(words)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *columns], ["id", "tie", *names])

    schema = "id long, tie long, " + ", ".join(f"{n} long" for n in names)
    return docs.select(id_key(key).alias("id"), text_tie(text).alias("tie"), F.col(text).alias(text)).mapInArrow(made, schema)


# Bit-sliced comparison


def planes(rows: np.ndarray) -> np.ndarray:
    """The bits of rows (n x words, uint64) stored vertically: one plane of packed lanes for each bit, and a spare word."""
    n = len(rows)
    lanes = -(-n // 64) * 64 + 64
    bits = np.zeros((rows.shape[1] * 64, lanes), np.uint8)
    bits[:, :n] = np.unpackbits(np.ascontiguousarray(rows).view(np.uint8).reshape(n, -1), axis=1, bitorder="little").T
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)


class Counters:
    """Distances of many lanes at once: bit i of every lane's distance is in plane i."""

    def __init__(self, shape: tuple, radius: int):
        self.radius = radius
        self.bits = [np.zeros(shape, np.uint64) for _ in range(max(1, radius.bit_length()))]
        self.over = np.zeros(shape, np.uint64)

    def add(self, x: np.ndarray, y: np.ndarray) -> None:
        """Carry-save: two planes of differences and the lowest plane make one sum and one carry."""
        low = self.bits[0]
        both = x ^ y
        carry = (x & y) | (low & both)
        self.bits[0] = low ^ both
        for i in range(1, len(self.bits)):
            self.bits[i], carry = self.bits[i] ^ carry, self.bits[i] & carry
        self.over |= carry

    def beyond(self) -> np.ndarray:
        """Lanes whose distance exceeds the radius."""
        greater, equal = np.zeros_like(self.over), ~np.zeros_like(self.over)
        for i in reversed(range(len(self.bits))):
            if self.radius >> i & 1:
                equal &= self.bits[i]
            else:
                greater |= equal & self.bits[i]
                equal &= ~self.bits[i]
        return greater | self.over

    def keep(self, at: np.ndarray) -> None:
        self.bits = [b[at] for b in self.bits]
        self.over = self.over[at]


def _lanes(live: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Numbers of the lanes that are set in live[i], the words[i]-th word."""
    bits = np.unpackbits(live.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    row, bit = np.nonzero(bits)
    return words[row] * 64 + bit


def shifted_matches(of: np.ndarray, same: np.ndarray, shift: int, radius: int) -> np.ndarray:
    """Lanes i with same[i] whose distance to lane i + shift is within the radius. Blocks are words of 64 lanes."""
    live = np.packbits(np.concatenate([same, np.zeros(-len(same) % 64, bool)]), bitorder="little").view(np.uint64)
    words = np.flatnonzero(live)
    live = live[words]
    skip, bit = divmod(shift, 64)
    last = of.shape[1] - 1
    counters = Counters((len(words),), radius)
    for p in range(0, len(of), STEP):
        here = of[p : p + STEP]
        there = here[:, np.minimum(words + skip, last)]
        if bit:
            there = (there >> np.uint64(bit)) | (here[:, np.minimum(words + skip + 1, last)] << np.uint64(64 - bit))
        there ^= here[:, words]
        for i in range(0, STEP, 2):
            counters.add(there[i], there[i + 1])
        live &= ~counters.beyond()
        at = np.flatnonzero(live)
        if len(at) < len(live):  # abandoned
            live, words = live[at], words[at]
            counters.keep(at)
            if not len(at):
                break
    return _lanes(live, words)


def query_matches(of: np.ndarray, n: int, rows: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, lane) within the radius; the queries are rows (q x words), the lanes the n first of `of`."""
    width = -(-n // 64)
    bits = np.unpackbits(np.ascontiguousarray(rows).view(np.uint8).reshape(len(rows), -1), axis=1, bitorder="little")
    masks = (np.uint64(0) - bits.astype(np.uint64)).T
    query, words = (x.ravel() for x in np.indices((len(rows), width)))
    live = np.full(len(query), ~np.uint64(0))
    if n % 64:
        live[words == width - 1] = np.uint64((1 << n % 64) - 1)
    counters = Counters(live.shape, radius)
    for p in range(0, len(of), STEP):
        for i in range(p, p + STEP, 2):
            counters.add(of[i][words] ^ masks[i][query], of[i + 1][words] ^ masks[i + 1][query])
        live &= ~counters.beyond()
        at = np.flatnonzero(live)
        if len(at) < len(live):
            live, words, query = live[at], words[at], query[at]
            counters.keep(at)
            if not len(at):
                break
    bits = np.unpackbits(live.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    row, bit = np.nonzero(bits)
    return query[row], words[row] * 64 + bit


class Sets:
    """Disjoint sets of 0 ... n-1, merged by arrays of links."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        root = self.root
        while len(a):
            a, b = root[a], root[b]
            apart = a != b
            a, b = a[apart], b[apart]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while (deeper := root[root] < root).any():
                root[deeper] = root[root[deeper]]


def linked(rows: np.ndarray, group: np.ndarray, radius: int) -> np.ndarray:
    """For rows (n x words) sorted by group: the first row of each row's component of links within its group.

    Small groups are compared by shifts, all at once. In a larger one, rows that nothing has reached yet are compared
    with all rows of the group until all are reached; then rows outside the largest component are. Two rows that were
    never compared are both in that component, so no link between components is missed.
    """
    n = len(rows)
    sets = Sets(n)
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if n else np.zeros(0, np.int64)
    sizes = np.diff(np.concatenate([starts, [n]]))
    size_of = np.repeat(sizes, sizes)
    small = np.flatnonzero((size_of <= SMALL) & (size_of > 1))
    shift = 1
    while len(small):
        of, key = planes(rows[small]), group[small]
        until = 2 * shift
        while shift < until and len(small) > shift:
            same = np.zeros(len(small), bool)
            same[:-shift] = key[:-shift] == key[shift:]
            if not same.any():
                break
            found = shifted_matches(of, same, shift, radius)
            sets.link(small[found], small[found + shift])
            shift += 1
        small = small[size_of[small] > shift]  # others are done: lanes are packed anew
        if len(small) <= shift:
            break
    for k in np.flatnonzero(sizes > SMALL).tolist():
        _large(rows[starts[k] : starts[k] + sizes[k]], sets, starts[k], radius)
    return sets.root


def _large(rows: np.ndarray, sets: Sets, base: int, radius: int) -> None:
    n, of = len(rows), planes(rows)
    reached, asked = np.zeros(n, bool), np.zeros(n, bool)

    def ask(who: np.ndarray) -> None:
        query, lane = query_matches(of, n, rows[who], radius)
        asked[who] = True
        reached[who] = True
        reached[lane] = True
        sets.link(base + who[query], base + lane)

    batch = max(1, min(64, (1 << 18) // -(-n // 64)))
    while len(left := np.flatnonzero(~reached)):
        ask(left[:: max(1, len(left) // 4)][:4] if len(left) > n // 2 and not asked.any() else left[:batch])
    root = sets.root[base : base + n]
    names, counts = np.unique(root, return_counts=True)
    outside = np.flatnonzero((root != names[np.argmax(counts)]) & ~asked)
    for i in range(0, len(outside), batch):
        ask(outside[i : i + batch])


# Classes


def _bits(word: str, low: int, size: int) -> Column:
    return F.shiftrightunsigned(word, low).bitwiseAND(F.lit((1 << size) - 1))


def pigeonhole_keys(radius: int = 4, spare: int = 2) -> list[Column]:
    """Keys of a 64-bit fingerprint: it is cut into radius + spare blocks, of which at least `spare` agree in any pair
    within the radius, so each choice of `spare` blocks is a key and no pair is missed."""
    n = radius + spare
    edges = [64 * i // n for i in range(n + 1)]
    keys = []
    for number, chosen in enumerate(combinations(range(n), spare)):
        key = F.lit(number).cast("long")
        for b in chosen:
            size = edges[b + 1] - edges[b]
            key = F.shiftleft(key, size).bitwiseOR(_bits("w0", edges[b], size))
        keys.append(key)
    return keys


def band_keys(words: int = 4, arrangements: int = 3) -> list[Column]:
    """Keys of a fingerprint of several words: four bits of each word; an arrangement pairs the words' nibbles anew."""
    keys = []
    for a in range(arrangements):
        for j in range(16):
            key = F.lit(16 * a + j).cast("long")
            for w in range(words):
                key = F.shiftleft(key, 4).bitwiseOR(_bits(f"w{w}", 4 * ((j + a * w) % 16), 4))
            keys.append(key)
    return keys


def near_classes(prints: DataFrame, keys: list[Column], radius: int) -> DataFrame:
    """The rows of fingerprints() with component_id (the smallest id reachable by links of `radius` differing bits or fewer).

    Rows of equal fingerprints are one node, named by its smallest id and aggregated before the shuffle, so exact copies
    never meet in a bucket. Nodes that share a key are compared within that bucket by task.
    A bucket of more than BLOCK nodes is cut into blocks twice (two_cuts), and what these leave apart is compared across
    them (outside_pairs). Tasks emit a spanning forest of the links they find, not the links.
    """
    words = [c for c in prints.columns if c not in ("id", "tie")]
    nodes = prints.groupBy(*words).agg(F.min("id").alias("node")).withColumn("root", F.col("node"))
    named = _linked_by(stored(nodes), keys, radius, words)
    named = named.select(*[F.col(w).alias(f"_{w}") for w in words], F.col("root").alias("component_id"))
    match = [F.col(w) == F.col(f"_{w}") for w in words]
    return prints.join(named, match).drop(*[f"_{w}" for w in words])


def _linked_by(named: DataFrame, keys: list[Column], radius: int, words: list[str]) -> DataFrame:
    """named (node, root: itself, words) with the roots that the links in the buckets of keys give."""
    keyed = named.withColumn("key", F.explode(F.array(*keys)))
    large = stored(keyed.groupBy("key").count().where(F.col("count") > BLOCK))
    many = large.limit(BROADCAST + 1).count()
    if many:
        large = large.select(F.col("key").alias("_bucket"), F.ceil(F.col("count") / BLOCK).alias("_blocks"))
        large = F.broadcast(large) if many <= BROADCAST else large
        blocks = keyed.join(large, F.col("key") == F.col("_bucket"), "left")
        blocks = blocks.withColumn("_pair", two_cuts(F.coalesce("_blocks", F.lit(1))))
    else:
        blocks = keyed.withColumn("_pair", F.lit(0).cast("long"))

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _whole_groups(batches):
            key, pair, root, core = (part.column(c).to_numpy() for c in ("key", "_pair", "root", "_inside"))
            rows = np.stack([part.column(w).to_numpy() for w in words], axis=1).view(np.uint64)
            starts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (pair[1:] != pair[:-1])]))
            sizes = np.diff(np.append(starts, len(key)))
            group = np.repeat(np.arange(len(starts)), sizes)
            names, at = np.unique(root, return_inverse=True)
            sets = Sets(len(names))
            apart = np.minimum.reduceat(at, starts) < np.maximum.reduceat(at, starts)
            with_core = np.logical_or.reduceat(core, starts)
            some = np.flatnonzero((apart & ~with_core)[group])
            sets.link(at[some], at[some[linked(rows[some], group[some], radius)]])
            for g in np.flatnonzero(apart & with_core).tolist():
                here = slice(starts[g], starts[g] + sizes[g])
                _link_to_core(rows[here], core[here], at[here], sets, radius)
            yield _links(names, names[sets.root])

    def links(dealt: DataFrame) -> DataFrame:
        dealt = dealt.select("key", "_pair", "_inside", "root", *words).repartition("key", "_pair").sortWithinPartitions("key", "_pair")
        return components(contracted(dealt.mapInArrow(compared, "a long, b long")))

    found = _joined(named, links(blocks.withColumn("_inside", F.lit(False))))
    if many:
        found = stored(found)
        rows = found.withColumn("key", F.explode(F.array(*keys))).join(large, F.col("key") == F.col("_bucket"))
        found = _joined(found, links(outside_pairs(rows, F.lit(1), BLOCK)))
    return found


def _links(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """The pairs of a and b that differ, each once."""
    apart = a != b
    found = np.unique(np.stack([a[apart], b[apart]], axis=1), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(found[:, 0].copy()), pa.array(found[:, 1].copy())], ["a", "b"])


def contracted(links: DataFrame) -> DataFrame:
    """Links (a to b) that connect the same nodes: each a is linked to the least of its b alone, and its other b to that.

    A node of a dense group has a link from each key, each to another node; the b are few, and so are their links. A list
    holds no more than a node's keys and blocks.
    """
    listed = links.groupBy("a").agg(F.collect_set("b").alias("bs")).withColumn("least", F.array_min("bs"))
    nodes = F.explode(F.concat(F.array("a"), "bs"))
    return listed.select(nodes.alias("a"), F.col("least").alias("b")).where("a <> b")


def _link_to_core(rows: np.ndarray, core: np.ndarray, at: np.ndarray, sets: Sets, radius: int) -> None:
    """Links the classes (at, of sets) of the rows outside the core to the core's if one of their rows is within the
    radius of one of the core's. A class that is linked already is asked no more."""
    inside, outside = np.flatnonzero(core), np.flatnonzero(~core)
    of, batch = planes(rows[inside]), max(1, min(64, (1 << 18) // -(-len(inside) // 64)))
    while len(outside):
        who, outside = outside[:batch], outside[batch:]
        query, _ = query_matches(of, len(inside), rows[who], radius)
        if len(query):
            found = np.unique(at[who[query]])
            sets.link(found, np.full(len(found), at[inside[0]]))
            outside = outside[sets.root[at[outside]] != sets.root[at[inside[0]]]]


def two_cuts(blocks: Column) -> Column:
    """The groups of a row (node) whose key is cut into so many blocks: its blocks in two cuts. A dense group gives a class
    in each block of the first cut, and those of the second connect these classes. A key of one block is one group."""
    first, second = (F.pmod(F.xxhash64("node", F.lit(salt)), blocks) for salt in (1, 2))
    return F.explode(F.when(blocks > 1, F.array(first, blocks + second)).otherwise(F.array(F.lit(0).cast("long"))))


def outside_pairs(rows: DataFrame, size: Column, limit: int) -> DataFrame:
    """Deals out the pairs of rows of a key that are left to compare when the rows' classes so far (root) are known.

    Rows of a key's largest class, its core, are connected and don't meet again. The others meet each other as pairs of
    blocks (_pair below zero) and each block of the core (_pair of zero or more; _inside tells its rows). Blocks have a
    size of about `limit`. So a key whose rows are nearly all connected costs rows in proportion to it, and a key that is
    one class none; any two rows of different classes share a group. rows has node, key and root.
    """
    parts = rows.groupBy("key", "root").agg(F.sum(size).alias("part"))
    cores = parts.groupBy("key").agg(F.max(F.struct("part", "root")).alias("core"), F.sum("part").alias("whole"))
    cores = stored(
        cores.where(F.col("whole") > F.col("core.part")).select(
            F.col("key").alias("_key"),
            F.col("core.root").alias("_core"),
            F.ceil(F.col("core.part") / limit).alias("_cores"),
            F.ceil((F.col("whole") - F.col("core.part")) / limit).alias("_outs"),
        )
    )
    few = cores.limit(BROADCAST + 1).count() <= BROADCAST
    dealt = rows.join(F.broadcast(cores) if few else cores, F.col("key") == F.col("_key"))
    inside, salt = F.col("root") == F.col("_core"), F.xxhash64("node", F.lit(3))
    core, out = F.pmod(salt, F.col("_cores")), F.pmod(salt, F.col("_outs"))
    outs = F.sequence(F.lit(0).cast("long"), F.col("_outs") - 1)
    groups = F.when(inside, F.transform(outs, lambda i: i * F.col("_cores") + core)).otherwise(
        F.concat(
            F.transform(F.sequence(F.lit(0).cast("long"), F.col("_cores") - 1), lambda j: out * F.col("_cores") + j),
            F.transform(outs, lambda i: -1 - (F.least(i, out) * F.col("_outs") + F.greatest(i, out))),
        )
    )
    return dealt.withColumn("_inside", inside).withColumn("_pair", F.explode(groups))


def _joined(named: DataFrame, roots: DataFrame) -> DataFrame:
    """named, its roots replaced by those that roots (node, root) has for them."""
    more = roots.select(F.col("node").alias("_of"), F.col("root").alias("_to"))
    return named.join(more, F.col("root") == F.col("_of"), "left").withColumn("root", F.coalesce("_to", "root")).drop("_of", "_to")


def _whole_groups(batches: Iterator[pa.RecordBatch], most: int = 65_536) -> Iterator[pa.Table]:
    """Tables of about `most` rows that end where a group (key, _pair) ends."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= most:
            whole = pa.Table.from_batches(held).combine_chunks()
            key, pair = whole.column("key").to_numpy(), whole.column("_pair").to_numpy()
            ends = np.flatnonzero((key[1:] != key[:-1]) | (pair[1:] != pair[:-1]))
            if len(ends):
                cut = int(ends[-1]) + 1
                yield whole.slice(0, cut)
                whole = whole.slice(cut)
            held, n = whole.to_batches(), whole.num_rows
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def simhash_classes(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row: 4-word shingles, links at 4 bits or fewer.

    Null and empty texts have fingerprint zero and are linked like any other. A null id stays null in doc_id; as a
    component it is the largest long, so it names a class only if all its ids are null. Repeated rows repeat.
    """
    prints = stored(fingerprints(docs, 4, 1, text, key))
    rows = near_classes(prints, pigeonhole_keys(4), 4)
    return rows.select(
        F.when(F.col("id") != NULL_ID, F.col("id")).alias("doc_id"),
        F.lpad(F.lower(F.hex("w0")), 16, "0").alias("fingerprint"),
        "component_id",
    )


def one_of_each(docs: DataFrame, shingle: int = 5, radius: int = 60, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of docs, all columns, with one document of each near-duplicate class: the one of the smallest id.

    A class is what links of a Jaccard similarity of 0.8 or more of the sets of 5-word shingles connect. Fingerprints only
    choose whom to compare: those of 256 bits over sets, linked at `radius` bits or fewer, give coarse classes, and within
    a coarse class all pairs whose sizes allow 0.8 are compared by their shingles, unless they are connected already. Texts
    at 0.8 differ in 39 bits on average with a deviation of 6, unrelated ones in 128. Links share 16 bits in one of 96
    bands, which 0.989 of the pairs at 0.8 do (0.998 at 0.85); a coarse class also holds pairs that share none. Texts of equal sets, empty
    ones too, are one. Rows of one id and different texts are different documents; repeated rows are one. Null ids come last,
    and the largest long counts as null. Columns may have any name; an empty table stays empty.
    """
    prints = stored(_set_prints(docs, shingle, 4, text, key))
    words = [f"w{i}" for i in range(4)]
    first = F.min(F.struct("id", "tie")).alias("first")
    sets = stored(prints.groupBy("set", *words).agg(first, F.max("size").alias("size")).where("size > 0"))
    coarse = near_classes(sets.select(F.col("set").alias("id"), F.lit(0).cast("long").alias("tie"), *words), band_keys(4, 6), radius)
    coarse = stored(coarse.select(F.col("id").alias("node"), F.col("component_id").alias("key")))
    named = coarse.join(sets.select(F.col("set").alias("node"), "first.id", "first.tie", "size"), "node")
    totals = named.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("total")).where("n > 1").drop("n")
    roots = _verified(docs, stored(named.join(totals, "key")), shingle, text, key)
    classes = prints.join(roots.withColumnRenamed("node", "set"), "set", "left").withColumn("class", F.coalesce("root", "set"))
    id_, tie, k, h = free_names(docs.columns, "_id", "_tie", "_key", "_hash")
    stays = classes.groupBy("class").agg(first).select(F.col("first.id").alias(id_), F.col("first.tie").alias(tie))
    keyed = docs.withColumn(k, id_key(key)).withColumn(h, text_tie(text))
    kept = keyed.join(stays, (F.col(k) == F.col(id_)) & (F.col(h) == F.col(tie)), "left_semi")
    return kept.dropDuplicates([k, h]).drop(k, h)


def _set_prints(docs: DataFrame, shingle: int, words: int, text: str, key: str) -> DataFrame:
    """id, tie, set (XXH64 of the sorted distinct shingles), size (bytes of the text; 0 if it has no shingle) and the
    fingerprint of the distinct shingles as w0 ... of every row."""
    names = [f"w{i}" for i in range(words)]

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches, text):
            sets = [np.unique(shingle_hashes(x, shingle)) for x in texts]
            found = np.array([fingerprint(x, words) for x in sets], np.uint64).reshape(-1, words)
            digests = np.array([xxhash.xxh64_intdigest(x.tobytes(), 42) for x in sets], np.uint64).view(np.int64)
            size = np.array([len(x) if len(s) else 0 for x, s in zip(texts, sets)], np.int64)
            columns = [digests, size, *(found[:, i].copy().view(np.int64) for i in range(words))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *map(pa.array, columns)], ["id", "tie", "set", "size", *names])

    schema = "id long, tie long, set long, size long, " + ", ".join(f"{n} long" for n in names)
    return docs.select(id_key(key).alias("id"), text_tie(text).alias("tie"), F.col(text).alias(text)).mapInArrow(made, schema)


def _verified(docs: DataFrame, members: DataFrame, shingle: int, text: str, key: str) -> DataFrame:
    """node and root: components of links of Jaccard similarity 0.8 or more within each key of members (node, key, size,
    total, and the id and tie of a document of the node); nodes without links may be missing. A key of more than SET_BYTES
    of text (total) is cut into blocks twice (two_cuts), and what these leave apart is compared across them (outside_pairs)."""
    of = members.select("node", "key", "size", "total", F.col("id").alias("_id"), F.col("tie").alias("_tie"))
    texts = docs.select(id_key(key).alias("_key"), text_tie(text).alias("_hash"), F.col(text).alias("text"))

    def dealt(groups: DataFrame) -> DataFrame:
        met = texts.join(groups, (F.col("_key") == F.col("_id")) & (F.col("_hash") == F.col("_tie")))
        return met.select("key", "_pair", "node", "root", "text").repartition("key", "_pair").sortWithinPartitions("key", "_pair")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _whole_groups(batches, 1000):
            key, pair, node, root = (part.column(c).to_numpy() for c in ("key", "_pair", "node", "root"))
            edges = np.flatnonzero((key[1:] != key[:-1]) | (pair[1:] != pair[:-1])) + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(key)]):
                _, at = np.unique(node[a:b], return_index=True)  # repeated rows
                names, known = np.unique(root[a:b][at], return_inverse=True)
                if len(names) > 1:
                    raw = part.column("text").slice(a, b - a).take(pa.array(at)).to_pylist()
                    first = similar([np.unique(shingle_hashes(x.encode(), shingle)) for x in raw], known)
                    sets = Sets(len(names))
                    sets.link(known, known[first])
                    yield _links(names, names[sets.root])

    blocks = F.greatest(F.ceil(F.col("total") / SET_BYTES), F.lit(1))
    first = dealt(of.withColumn("root", F.col("node")).withColumn("_pair", two_cuts(blocks)))
    roots = components(first.mapInArrow(compared, "a long, b long"))
    large = of.where(F.col("total") > SET_BYTES)
    if large.isEmpty():
        return roots
    large = large.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    groups = outside_pairs(stored(large), F.col("size"), SET_BYTES).drop("_key")
    more = components(dealt(groups).mapInArrow(compared, "a long, b long"))
    alone = more.join(roots, "node", "left_anti").select("node", F.col("node").alias("root"))
    return _joined(roots.unionByName(alone), more)


def similar(sets: list[np.ndarray], known: np.ndarray | None = None) -> np.ndarray:
    """For sets of distinct hashes, none empty: the first set of each one's component of links of a Jaccard similarity of
    0.8 or more. Sets are sorted by size, so that those a set can be linked to follow it in a row; of these, the ones
    that are connected to it already are left out, as are those of one class of `known` (0 ...) from the start."""
    n = len(sets)
    order = np.argsort([len(x) for x in sets], kind="stable")
    size = np.array([len(sets[i]) for i in order], np.int64)
    starts = np.concatenate([[0], np.cumsum(size)])
    names, ids = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)
    until = np.searchsorted(4 * size, 5 * size, "right")
    mark, root = np.zeros(len(names), bool), np.arange(n) if known is None else known[order]
    for i in range(n - 1):
        who = i + 1 + np.flatnonzero(root[i + 1 : until[i]] != root[i])
        if not len(who):
            continue
        mine = ids[starts[i] : starts[i + 1]]
        mark[mine] = True
        if 2 * len(who) > until[i] - i - 1:
            begin = starts[i + 1]
            common = np.add.reduceat(mark[ids[begin : starts[until[i]]]], starts[i + 1 : until[i]] - begin, dtype=np.int64)[who - i - 1]
        else:
            common = np.array([np.count_nonzero(mark[ids[starts[j] : starts[j + 1]]]) for j in who.tolist()])
        mark[mine] = False
        found = who[9 * common >= 4 * (size[i] + size[who])]  # common >= 0.8 (a + b - common)
        if len(found):
            joined = np.unique(np.append(root[found], root[i]))
            root[np.isin(root, joined)] = joined[0]
    least = np.full(n, n)
    np.minimum.at(least, root, order)
    out = np.empty(n, np.int64)
    out[order] = least[root]
    return out

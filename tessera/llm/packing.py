"""Best-fit packing of token sequences: leaf by leaf, then up a tree of underfull bins."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import pretokens
from tessera.llm.common import free_names, packed, pieces, stored, unpacked, widened

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def best_fit(sizes: list[int], capacity: int) -> tuple[list[int], list[int], list[int]]:
    """Best fit in decreasing order: bin and offset of each item, and the fill of each bin.

    Open bins are kept by free space; a bit mask of the spaces that occur gives the smallest that fits. Ties go to the
    item that comes first. plan() does the same for counts of items.
    """
    bins, offsets, fills = [0] * len(sizes), [0] * len(sizes), []
    by_space: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for i in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        n = sizes[i]
        fitting = mask >> n
        if fitting:
            space = n + (fitting & -fitting).bit_length() - 1
            b = by_space[space].pop()
            if not by_space[space]:
                mask ^= 1 << space
        else:
            b, space = len(fills), capacity
            fills.append(0)
        bins[i], offsets[i] = b, fills[b]
        fills[b] += n
        by_space[space - n].append(b)
        mask |= 1 << (space - n)
    return bins, offsets, fills


def token_pieces(docs: DataFrame, path: str, capacity: int = 2048, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Pieces of up to `capacity` tokens of each document: its ids, then id 0.

    doc_id, piece, start, length, ids_crc32. A null text is empty: one piece that holds id 0.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches, text):
            rows: list[tuple] = []
            for doc, ids in zip(batch.column(0).to_pylist(), _encoded(texts, path)):
                ids += b"\0\0\0\0"
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias(text)).mapInArrow(cut, _PIECES)


#: The letters of plain texts in lower case. Between one of them and anything else a pre-token ends, but at an apostrophe.
_LETTERS = "a-z\u00aa\u00b5\u00ba\u00df-\u00f6\u00f8-\u017f"
_UNITS = re.compile(f"[{_LETTERS}]+|[^\\s{_LETTERS}]+").findall
#: Stands between units that are encoded together: its first byte, and so its first id, is in no plain text.
_MARK = "\u4e00"
#: Encoded units that a worker remembers; beyond it starts anew.
_REMEMBERED = 500_000


@lru_cache(maxsize=2)
def _memory(path: str) -> dict[str, bytes]:
    return {}


def _encoded(texts: list[bytes], path: str) -> Iterator[bytes]:
    """Ids of each text, as little-endian 32-bit integers. The tokenizer ignores case and drops white space, so letters
    and what is between them stand alone; each such unit is encoded once while it is remembered."""
    tok, memory = pretokens.tokenizer(path), _memory(path)
    for raw in texts:
        whole = raw.decode()
        if not pretokens.plain(whole, path) or "\u0130" in whole:  # which lower-cases to two characters
            yield np.array(tok.encode(whole, add_special_tokens=False).ids, "<u4").tobytes()
            continue
        units = whole.lower().split() if "'" in whole else _UNITS(whole.lower())
        missing = list(set(units).difference(memory))
        if missing:
            if len(memory) > _REMEMBERED:
                memory.clear()
                missing = list(set(units))
            for i in range(0, len(missing), 1000):
                memory.update(_units(tok, missing[i : i + 1000]))
        yield b"".join(map(memory.__getitem__, units))


def _units(tok, units: list[str]) -> Iterator[tuple[str, bytes]]:
    mark = tok.encode(_MARK, add_special_tokens=False).ids
    if not mark or not (tok.id_to_token(mark[0]) or "").startswith("\u00e4"):
        return zip(units, (np.array(tok.encode(u, add_special_tokens=False).ids, "<u4").tobytes() for u in units))
    ids = np.array(tok.encode(f" {_MARK} ".join(units), add_special_tokens=False).ids, "<u4")
    at = np.flatnonzero(ids == mark[0])
    starts, ends = [0, *(4 * (at + len(mark))).tolist()], [*(4 * at).tolist(), 4 * len(ids)]
    raw = ids.tobytes()
    return zip(units, (raw[a:b] for a, b in zip(starts, ends)))


class Run:
    """Bins first ... first + count - 1, which are all filled alike."""

    __slots__ = ("count", "fill", "first")

    def __init__(self, first: int, count: int, fill: int):
        self.first, self.count, self.fill = first, count, fill


def plan(counts: dict[int, int], capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """best_fit over counts[n] items of each size n, without the items: the same fills, in a few steps for each size.

    Returns rows (size, first rank, bin, items a bin, offset), by size and rank, and runs (first bin, bins, fill) of all
    bins in order. The items of one size are ranked; those from a row's first rank to the next row's go to the bins from
    `bin` on, so many to each. Bins that are filled alike are one run; items take the runs of the least space that fits,
    and what is left opens new bins.
    """
    by_space: list[list[Run]] = [[] for _ in range(capacity + 1)]
    mask = bins = 0
    rows: list[tuple[int, int, int, int, int]] = []
    for n in sorted(counts, reverse=True):
        if not 0 < n <= capacity:
            raise ValueError(f"a length of {n} is not in 1 ... {capacity}")
        left, rank = counts[n], 0
        while left:
            fitting = mask >> n
            if fitting:
                space = n + (fitting & -fitting).bit_length() - 1
                run = by_space[space].pop()
                if not by_space[space]:
                    mask ^= 1 << space
            else:
                space = capacity
                run = Run(bins, -(-left // (capacity // n)), 0)
                bins += run.count
            each = space // n
            whole = min(run.count, left // each)  # bins that take `each` items; then one may take the rest
            rest = min(left - whole * each, each - 1) if whole < run.count else 0
            parts = [(whole, each), (1 if rest else 0, rest), (run.count - whole - (1 if rest else 0), 0)]
            first = run.first
            for count, items in parts:
                if not count:
                    continue
                if items:
                    rows.append((n, rank, first, items, run.fill))
                    rank += count * items
                    left -= count * items
                part = Run(first, count, run.fill + items * n)
                first += count
                by_space[capacity - part.fill].append(part)
                if part.fill < capacity:
                    mask |= 1 << (capacity - part.fill)
    runs = sorted((run.first, run.count, run.fill) for held in by_space for run in held)
    return np.array(sorted(rows), np.int64).reshape(-1, 5), np.array(runs, np.int64).reshape(-1, 3)


def _planned(capacity: int, open_below: int):
    """The best-fit round of a node: for each child a plan of its items; bins filled less than open_below go on as items."""

    def planned(rows):
        child, size, n = (rows.column(c).to_numpy() for c in ("child", "size", "n"))
        order = np.lexsort((child, size))
        child, size, n = child[order], size[order], n[order]
        names, first = np.unique(size, return_index=True)
        total = np.add.reduceat(n, first)
        places, runs = plan(dict(zip(names.tolist(), total.tolist())), capacity)
        before = np.cumsum(n) - n
        before -= np.repeat(before[first], np.diff(np.append(first, len(size))))  # items of that size of the children before
        goes_on = runs[:, 2] < open_below
        by_fill = np.lexsort((runs[:, 0], runs[:, 2]))[np.sort(goes_on)[::-1]] if len(runs) else np.zeros(0, np.int64)
        fills, at = np.unique(runs[by_fill, 2], return_index=True)
        counts = runs[by_fill, 1]
        ranks = np.cumsum(counts) - counts
        ranks -= np.repeat(ranks[at], np.diff(np.append(at, len(by_fill))))
        rank = np.full(len(runs), -1)
        rank[by_fill] = ranks
        shared = [*places.T, runs[:, 0], runs[:, 2], rank]
        out = []
        for c in np.unique(child).tolist():
            mine = child == c
            out.append((c, packed(size[mine], before[mine], *shared)))
        node = rows.column("node")[0].as_py()
        sums = np.add.reduceat(counts, at) if len(at) else np.zeros(0, np.int64)
        return pa.table(
            {
                "node": pa.array([node] * len(out), pa.int64()),
                "child": pa.array([c for c, _ in out], pa.int64()),
                "plan": pa.array([x for _, x in out], pa.binary()),
                "bins": pa.array([int(runs[:, 1].sum())] * len(out), pa.int64()),
                # on one row of the node: what goes on
                "fills": pa.array([fills.tolist()] + [[]] * (len(out) - 1), pa.list_(pa.int64())),
                "counts": pa.array([sums.tolist()] + [[]] * (len(out) - 1), pa.list_(pa.int64())),
            }
        )

    return planned


def seats(size: np.ndarray, chain: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Level, node, bin and offset of each piece of a leaf. chain has (level, node, plan) from the leaf to the root."""
    n = len(size)
    order = np.argsort(size, kind="stable")
    rank = np.empty(n, np.int64)
    _, first = np.unique(size[order], return_index=True)
    rank[order] = np.arange(n) - np.repeat(first, np.diff(np.append(first, n)))
    level, node, place, offset = (np.zeros(n, np.int64) for _ in range(4))
    live, size = np.arange(n), size.astype(np.int64)
    for at, name, raw in sorted(chain):
        names, before, of, first_rank, first_bin, each, base, run_bin, run_fill, run_rank = unpacked(raw)
        ranked = rank + before[np.searchsorted(names, size)]
        row = np.searchsorted((of << 48) + first_rank, (size << 48) + ranked, "right") - 1
        bins, slot = np.divmod(ranked - first_rank[row], each[row])
        bins += first_bin[row]
        level[live], node[live], place[live] = at, name, bins
        offset[live] += base[row] + slot * size
        run = np.searchsorted(run_bin, bins, "right") - 1
        on = run_rank[run] >= 0
        rank, size = (run_rank[run] + bins - run_bin[run])[on], run_fill[run][on]
        live = live[on]
        if not len(live):
            break
    return level, node, place, offset


def pack_pieces(parts: DataFrame, capacity: int = 2048, slack: int = 16, fan_in: int = 16, leaf: int = 65_536) -> DataFrame:
    """parts (with a column length from 1 to `capacity`; others are errors) with sequence_id and offset, in as few sequences
    as best fit makes. Rows are kept as they are, repeated ones and null columns too; an empty table gives an empty result.

    Pieces are dealt by a hash to leaves of about `leaf` of them, so that no leaf has pieces of one kind only because they lie
    together. Each leaf packs its own best-fit, by decreasing length. Bins with fewer than `slack` free tokens are
    emitted. The others become items: round by round, `fan_in` nodes meet in one, whose underfull bins are packed best-fit
    as items of their fill, and those that are now nearly full leave, until one node is left, which emits all.

    Items of one size are interchangeable, so a round needs only their counts (`capacity` sizes for each child, however
    many bins there are) and plans places by rank; no task holds bins, and no bin is closed early. Each leaf then gets the
    plans on its way to the root, and reads each of its pieces' place from them.
    """
    fields = parts.drop("sequence_id", "offset").schema
    number, of = free_names(fields.names, "_number", "_leaf")
    kept = parts.select(*[F.col(f"`{f.name}`") for f in fields])

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        at = (task.partitionId() if task else 0) << 36
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.arange(at, at + batch.num_rows))], [*batch.schema.names, number])
            at += batch.num_rows

    local = stored(kept.mapInArrow(numbered, widened(fields, **{number: "long"})))
    leaves = max(1, -(-local.count() // leaf))
    spread = local.withColumn(of, F.pmod(F.xxhash64(number), F.lit(leaves)))
    items = spread.groupBy(F.col(of).alias("child"), F.col("length").cast("long").alias("size")).agg(F.count("*").alias("n"))
    chains, most, width, level = [], [], leaves, 0
    schema = "node long, child long, plan binary, bins long, fills array<long>, counts array<long>"
    while True:
        width = -(-width // fan_in) if level else width
        node = F.floor(F.col("child") / fan_in).cast("long") if level else F.col("child")
        planned = stored(items.withColumn("node", node).groupBy("node").applyInArrow(_planned(capacity, 0 if width == 1 else capacity - slack + 1), schema))
        below = fan_in ** (level - 1) if level else 1  # leaves of a child
        ways = F.explode(F.sequence(F.col("child") * below, F.least((F.col("child") + 1) * below, F.lit(leaves)) - 1))
        chains.append(planned.select(ways.alias("leaf"), F.lit(level).cast("long").alias("level"), "node", "plan"))
        most.append(planned.agg(F.max("bins")).first()[0] or 1)
        if width == 1:
            break
        open_bins = planned.select(F.col("node").alias("child"), F.explode(F.arrays_zip("fills", "counts")).alias("x"))
        items = open_bins.select("child", F.col("x.fills").alias("size"), F.col("x.counts").alias("n"))
        level += 1
    names = [f.name for f in fields]

    def seated(_, pieces_of: pa.Table, plans: pa.Table) -> pa.Table:
        size = pieces_of.column("length").to_numpy()
        chain = list(zip(*(plans.column(c).to_pylist() for c in ("level", "node", "plan"))))
        level, node, place, offset = seats(size, chain)
        sequence = (node * np.array(most)[level] + place) * len(most) + level
        out = pieces_of.select(names)
        return out.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    ways = reduce(DataFrame.unionByName, chains)
    done = spread.drop(number).groupBy(of).cogroup(ways.groupBy("leaf"))
    return done.applyInArrow(seated, widened(fields, sequence_id="long", offset="long"))


def pack_documents(docs: DataFrame, path: str, capacity: int = 2048, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Token pieces of all documents, packed: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Every row of docs has its pieces, null and repeated ids included; only documents of more than `capacity` tokens are
    cut. Sequences have no gaps. An empty table gives an empty result.
    """
    return pack_pieces(token_pieces(docs, path, capacity, text, key), capacity)

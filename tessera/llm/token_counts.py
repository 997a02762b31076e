"""Token counts without token ids: pieces are counted once for each distinct pre-token."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import pretokens
from tessera.llm.common import packed, pieces, stored, unpacked

#: A block's documents and their frequencies, its units and their pre-tokens (arrays, compressed), and its vocabulary.
_BLOCK = "block long, keys binary, docs binary, units binary, vocabulary array<string>"
#: Text of a block, and bits of a slot (block and place in its vocabulary) that are the place.
BLOCK_BYTES, PLACE = 32 << 20, 24
#: Pre-tokens whose counts a task remembers, and counts that it holds before it sends them on.
REMEMBERED, HELD = 1_000_000, 2_000_000


def token_counts(docs: DataFrame, path: str, limit: int = 512, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Tokens of every text, as the tokenizer file at `path` splits it.

    Documents are read once, in blocks of about 32 MB: a block holds, for each document, the frequencies of its
    units, and for each distinct unit its pre-tokens, as numbers into the block's own vocabulary. The vocabularies
    are dealt out by pre-token (a word that is everywhere comes once a block, however often it is used), so each distinct
    pre-token is in one task, which counts its pieces once (anew only if it has met very many others in between). The counts
    return to their blocks in arrays, as they come, and each block sums frequency times count by document. No token
    ids are kept, and no task holds more than a block or so many counts.

    Returns key, n_bytes, n_tokens, over_limit. Null texts count as empty: no bytes, no tokens. Rows are kept as they
    are: repeated rows give repeated results, null ids stay null; other columns are ignored.
    """

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        number = (task.partitionId() if task else 0) << 12
        block = _Block(path)
        for batch, texts in pieces(batches, text):
            block.add(batch.column(0), texts)
            if block.size >= BLOCK_BYTES:
                yield block.row(number)
                number, block = number + 1, _Block(path)
        if block.keys:
            yield block.row(number)

    stored_blocks = stored(docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias(text)).mapInArrow(blocks, _BLOCK))
    slot = F.shiftleft("block", PLACE).bitwiseOR(F.col("place").cast("long"))
    used = stored_blocks.select("block", F.posexplode("vocabulary").alias("place", "token")).select("token", slot.alias("slot"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = pretokens.tokenizer(path)
        encode = getattr(tok, "encode_batch_fast", tok.encode_batch)
        known: dict[str, int] = {}
        slots, counts, held = [], [], 0
        for batch in batches:
            tokens = batch.column(0).dictionary_encode()
            names = tokens.dictionary.to_pylist()
            if len(known) > REMEMBERED:
                known.clear()
            new = [x for x in names if x not in known]
            known.update(zip(new, (len(x.ids) for x in encode(new, add_special_tokens=False))))
            of = np.fromiter(map(known.__getitem__, names), np.int32, len(names))
            slots.append(batch.column(1).to_numpy())
            counts.append(of[tokens.indices.to_numpy()])
            held += batch.num_rows
            if held >= HELD:
                yield _answer(slots, counts)
                slots, counts, held = [], [], 0
        if held:
            yield _answer(slots, counts)

    found = used.repartition("token").mapInArrow(counted, "of long, counts binary")

    def summed(_, left: pa.Table, right: pa.Table) -> pa.Table:
        lists = [unpacked(x) for x in right.column("counts").to_pylist()]
        places = np.concatenate([np.zeros(0, np.int64), *(np.cumsum(x, dtype=np.int64) for x, _ in lists)])
        counts = np.concatenate([np.zeros(0, np.int32), *(x for _, x in lists)])
        pieces_of = np.zeros(len(places), np.int64)
        pieces_of[places] = counts  # each place of the vocabulary occurs once
        return pa.concat_tables([_totals(row, pieces_of, limit) for row in left.to_pylist()])

    out = (
        stored_blocks.drop("vocabulary")
        .groupBy("block")
        .cogroup(found.groupBy("of"))
        .applyInArrow(summed, "key long, n_bytes long, n_tokens long, over_limit boolean")
    )
    return out.withColumnRenamed("key", key)


def _answer(slots: list[np.ndarray], counts: list[np.ndarray]) -> pa.RecordBatch:
    """To each block, the counts of places of its vocabulary."""
    slot, count = np.concatenate(slots), np.concatenate(counts)
    order = np.argsort(slot)
    slot, count = slot[order], count[order]
    block = slot >> PLACE
    edges = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1], [True]])).tolist()
    places = (slot & ((1 << PLACE) - 1)).astype(np.int32)
    lists = [packed(np.diff(places[a:b], prepend=np.int32(0)), count[a:b]) for a, b in zip(edges[:-1], edges[1:])]
    return pa.RecordBatch.from_arrays([pa.array(block[edges[:-1]]), pa.array(lists, pa.binary())], ["of", "counts"])


class _Block:
    def __init__(self, path: str):
        self.path, self.size = path, 0
        self.units: dict[str, int] = {}
        self.tokens: dict[str, int] = {}
        self.keys: list[int | None] = []
        self.n_bytes: list[int] = []
        self.doc_units: list[np.ndarray] = []
        self.doc_freqs: list[np.ndarray] = []
        self.unit_lengths: list[int] = []
        self.unit_tokens: list[int] = []

    def add(self, keys: pa.Array, texts: list[bytes]) -> None:
        units, tokens, path = self.units, self.tokens, self.path
        specials_of = frozenset(pretokens.special_strings(path))
        for raw in texts:
            whole = raw.decode()
            if pretokens.plain(whole, path):
                counter = Counter(pretokens.UNITS(whole))
            else:
                stretches, specials = pretokens.between_specials(whole, path)
                counter = Counter(x for s in stretches if s for x in pretokens.library_pretokens(s, path))
                counter.update(specials)
            split_unit = pretokens.unit_pretokens if pretokens.PLAIN(whole) else pretokens.library_pretokens
            for unit in [x for x in counter if x not in units]:
                units[unit] = len(units)
                split = [unit] if unit in specials_of else split_unit(unit, path)
                self.unit_tokens.extend([tokens.setdefault(x, len(tokens)) for x in split])
                self.unit_lengths.append(len(split))
            n = len(counter)
            at = np.fromiter(map(units.__getitem__, counter), np.int32, n)
            order = np.argsort(at)
            self.doc_units.append(at[order])
            self.doc_freqs.append(np.fromiter(counter.values(), np.int32, n)[order])
            self.size += len(raw)
        self.keys += keys.to_pylist()
        self.n_bytes += map(len, texts)

    def row(self, number: int) -> pa.RecordBatch:
        filled = [[0 if k is None else k for k in self.keys], [k is not None for k in self.keys], self.n_bytes]
        lengths = [len(x) for x in self.doc_units]
        steps = [np.diff(x, prepend=x[:1] * 0) for x in self.doc_units]
        lists = [
            packed(*(np.array(x, np.int64) for x in filled)),
            packed(np.array(lengths, np.int32), np.concatenate(steps), np.concatenate(self.doc_freqs)),
            packed(np.array(self.unit_lengths, np.int32), np.array(self.unit_tokens, np.int32)),
        ]
        columns = [pa.array([number], pa.int64()), *(pa.array([x], pa.binary()) for x in lists), pa.array([list(self.tokens)], pa.list_(pa.string()))]
        return pa.RecordBatch.from_arrays(columns, [x.split(" ")[0] for x in _BLOCK.split(", ")])


def _sums(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(lengths)
    return total[ends] - total[ends - lengths]


def _totals(row: dict, pieces_of: np.ndarray, limit: int) -> pa.Table:
    keys, valid, n_bytes = unpacked(row["keys"])
    lengths, steps, freqs = unpacked(row["docs"])
    unit_lengths, unit_tokens = unpacked(row["units"])
    per_unit = _sums(pieces_of[unit_tokens], unit_lengths)
    at = np.cumsum(steps, dtype=np.int64)
    ends = np.cumsum(lengths)
    before = np.concatenate([[0], at])[ends - lengths]
    per_doc = _sums(per_unit[at - np.repeat(before, lengths)] * freqs, lengths)
    return pa.table(
        {
            "key": pa.array(keys, pa.int64(), mask=valid == 0),
            "n_bytes": pa.array(n_bytes),
            "n_tokens": pa.array(per_doc, pa.int64()),
            "over_limit": pa.array(per_doc > limit),
        }
    )

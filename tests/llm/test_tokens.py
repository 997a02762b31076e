import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tessera.llm import bpe, packing, pretokens, token_counts
from tessera.llm.queries import tokenizer_path

BYTES, WORDS = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("word_bpe_49k.json")
TEXTS = [
    None,
    "",
    "  a  b\n\n c",
    "<|endoftext|>x <|endoftext|>",
    "<|startoftext|> Hello",
    "日本語 テキスト",
    "   x",
    "١٢ é́",
    "don't  \t  stop",
    "word " * 9000,
    "\x1c a\x85b",
]
ROWS = [(i, t, "clash", 1) for i, t in enumerate(TEXTS)] + [(None, "null id", "x", 2), (3, "twice", "x", 2), (3, "twice", "x", 2)]
SCHEMA = "doc_id long, text string, key string, n_tokens long"


def order(rows):
    return sorted(rows, key=repr)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def test_counts_agree_with_the_library(spark, docs):
    tok = Tokenizer.from_file(BYTES)
    got = [tuple(r) for r in token_counts.token_counts(docs, BYTES).collect()]
    ids = [(d, t or "", len(tok.encode(t or "", add_special_tokens=False).ids)) for d, t, *_ in ROWS]
    assert order(got) == order([(d, len(t.encode()), n, n > 512) for d, t, n in ids])
    assert token_counts.token_counts(docs.limit(0), BYTES).collect() == []


def test_ids_and_decoded_texts_agree_with_the_library(docs):
    tok = Tokenizer.from_file(BYTES)
    want = []
    for d, t, *_ in ROWS:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        back = tok.decode(ids, skip_special_tokens=False)
        want.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    assert order(map(tuple, bpe.encoding_digests(docs, BYTES).collect())) == order(want)
    assert bpe.encoding_digests(docs.limit(0), BYTES).collect() == []


def test_units_are_split_as_the_library_does():
    rng = random.Random(8)
    plain = [chr(c) for c in [*range(33, 127), *range(0xA1, 0xAD), *range(0xAE, 0x180)]]
    for _ in range(20_000):
        unit = rng.choice(["", " "]) + "".join(rng.choice("abcé" if rng.random() < 0.7 else plain) for _ in range(rng.randint(1, 6))) + "".join(rng.choice(".,!'\"-)") for _ in range(rng.randint(0, 3)))
        assert pretokens.unit_pretokens(unit, BYTES) == pretokens.library_pretokens(unit, BYTES), unit


def test_merges_of_random_texts():
    rng, tok, coder = random.Random(1), Tokenizer.from_file(BYTES), bpe.BytePairs(BYTES)
    for _ in range(1500):
        text = "".join(rng.choice("ab cdéß  \n\t'sªº1٣½,.<|>日😀ĦǅĦaaa") for _ in range(rng.randint(0, 40)))
        assert np.frombuffer(coder.encode(text), "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids, text


def test_packing_keeps_every_token_without_gaps(docs):
    tok = Tokenizer.from_file(WORDS)
    want = []
    for d, t, *_ in ROWS:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        for k, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            want.append((d, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    rows = packing.pack_documents(docs, WORDS).collect()
    assert order((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == order(want)
    check_sequences(rows, 2048)
    assert packing.pack_documents(docs.limit(0), WORDS).collect() == []


def check_sequences(rows, capacity):
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for found in places.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= capacity
    return len(places)


@pytest.mark.parametrize("leaf", [7, 100, 100_000])
def test_underfull_bins_meet_up_the_tree(spark, leaf):
    rng = random.Random(2)
    sizes = [rng.choice([1, 3, 40, 55, 60, 61, 99, 100]) for _ in range(900)]
    frame = spark.createDataFrame([(i, n, "x", None) for i, n in enumerate(sizes)], "id long, length long, _leaf string, _number long")
    rows = packing.pack_pieces(frame.repartition(40), capacity=100, slack=0, fan_in=3, leaf=leaf).collect()
    assert sorted((r.id, r.length, r._leaf, r._number) for r in rows) == [(i, n, "x", None) for i, n in enumerate(sizes)]
    n, least = check_sequences(rows, 100), sum(s > 50 for s in sizes)  # no two of these share a sequence
    assert n <= {7: 1.12, 100: 1.05, 100_000: 1.03}[leaf] * least
    assert packing.pack_pieces(frame.limit(0), capacity=100).collect() == []


def test_merged_bins_agree_with_best_fit_of_the_rounds():
    """The whole tree in this process, item by item."""
    rng = random.Random(5)
    for _ in range(40):
        leaves = [[rng.randint(1, 50) for _ in range(rng.randint(1, 30))] for _ in range(3)]
        rows = [(k, k, n, c) for k, sizes in enumerate(leaves) for n, c in sorted(Counter(sizes).items())]
        table = lambda rows: pa.table({k: pa.array(list(c), pa.int64()) for k, c in zip(("node", "child", "size", "n"), zip(*rows))})
        plans = {k: packing._planned(50, 46)(table([r for r in rows if r[0] == k])) for k in range(3)}
        items = [(0, k, n, c) for k, t in plans.items() for n, c in zip(t.column("fills")[0].as_py(), t.column("counts")[0].as_py())]
        root = packing._planned(50, 0)(table(items)) if items else None
        found, full, underfull = [], 0, []
        for k, sizes in enumerate(leaves):
            chain = [(0, k, plans[k].column("plan")[0].as_py())]
            if root is not None and k in (children := root.column("child").to_pylist()):
                chain.append((1, 0, root.column("plan")[children.index(k)].as_py()))
            for n, place in zip(sizes, zip(*(x.tolist() for x in packing.seats(np.array(sizes), chain)))):
                found.append((place[:3], place[3], n))
            fills = packing.best_fit(sizes, 50)[2]
            full += sum(f > 45 for f in fills)
            underfull += [f for f in fills if f <= 45]
        places = defaultdict(list)
        for name, offset, n in found:
            places[name].append((offset, n))
        for held in places.values():
            ends = [0, *(o + n for o, n in sorted(held))]
            assert [o for o, _ in sorted(held)] == ends[:-1] and ends[-1] <= 50
        assert len(places) == full + len(packing.best_fit(underfull, 50)[2])


def test_best_fit_takes_the_fullest_bin_that_has_room():
    bins, offsets, fills = packing.best_fit([5, 6, 3, 4, 2], 10)
    assert fills == [10, 10]
    assert [bins[i] for i in (1, 3)] == [0, 0] and offsets[3] == 6


def test_plans_of_counts_fill_bins_as_best_fit_does():
    rng = random.Random(7)
    for _ in range(300):
        capacity = rng.randint(1, 60)
        sizes = [rng.randint(1, rng.choice([capacity, max(1, capacity // 3)])) for _ in range(rng.randint(0, 200))]
        rows, bins = packing.plan(Counter(sizes), capacity)
        fills = packing.best_fit(sizes, capacity)[2]
        assert sorted(f for _, n, f in bins.tolist() for _ in range(n)) == sorted(fills)
        got = [0] * len(fills)
        rows = sorted(rows.tolist(), key=lambda r: (-r[0], r[1]))
        for k, (size, rank, first, each, at) in enumerate(rows):
            last = rows[k + 1][1] if k + 1 < len(rows) and rows[k + 1][0] == size else sizes.count(size)
            for r in range(last - rank):
                assert got[first + r // each] == at + r % each * size
                got[first + r // each] += size
        assert sorted(got) == sorted(fills)


def test_long_pieces_that_lie_together_meet_the_short_ones(spark):
    for sizes, leaf, least in (([55] * 600 + [45] * 600 + [10] * 30, 2000, 603), ([55] * 600 + [45] * 600 + [10] * 30, 400, 603), ([60] * 450 + [40] * 450, 300, 450)):
        parts = spark.createDataFrame(list(enumerate(sizes)), "id long, length long").repartitionByRange(12, "id")
        rows = packing.pack_pieces(parts, capacity=100, slack=0, fan_in=3, leaf=leaf).collect()
        assert sorted((r.id, r.length) for r in rows) == list(enumerate(sizes))
        assert len(packing.best_fit(sizes, 100)[2]) == least
        assert check_sequences(rows, 100) <= (1 if leaf == 2000 else 1.05) * least

import hashlib
import random

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from tessera.llm import paragraphs, passages
from tessera.llm.suffix_array import permuted_common_prefixes, suffix_array


def test_suffix_arrays_and_common_prefixes_of_random_texts():
    rng = np.random.default_rng(1)
    for k in range(300):
        text = rng.integers(1, int(rng.integers(2, 6)), int(rng.integers(0, 60)))
        text = np.concatenate([np.tile(text, 1 + k % 3), [0]]).astype(np.uint8)
        values = text.tolist()
        order = suffix_array(text)
        assert order.tolist() == sorted(range(len(values)), key=lambda i: values[i:])
        before, common = permuted_common_prefixes(text, order)
        for i, j in enumerate(before.tolist()):
            m = 0
            while j >= 0 and max(i, j) + m < len(values) and values[i + m] == values[j + m]:
                m += 1
            assert common[i] == m


def brute(docs):
    seen, out = set(), {}
    for key in sorted(docs):
        raw = docs[key].encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - 99):
            window = raw[i : i + 100]
            if window in seen:
                gone[i : i + 100] = b"\1" * 100
            seen.add(window)
        kept = bytes(c for c, g in zip(raw, gone) if not g)
        runs = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out[key] = (len(raw), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


def corpus(seed):
    rng = random.Random(seed)
    shared = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(90, 400))) for _ in range(8)]
    docs = {}
    for i in range(60):
        parts = [rng.choice(shared) if rng.random() < 0.5 else "".join(rng.choice("abcdefg ") for _ in range(rng.randint(0, 300))) for _ in range(rng.randint(0, 5))]
        docs[i] = "".join(parts)
    docs[60], docs[61], docs[62] = "ab" * 3000, "é" * 500, "x" * 99
    docs[63] = docs[5] + docs[5]
    docs[64], docs[65], docs[66] = docs[60], docs[3] + shared[0], docs[3] + shared[0]  # whole copies
    return docs


@pytest.mark.parametrize("contexts", [10_000, 2])
def test_removal_agrees_with_brute_force(spark, monkeypatch, contexts):
    monkeypatch.setattr(passages, "CONTEXTS", contexts)
    docs = corpus(contexts)
    rows = [(k, t, "x", 1) for k, t in docs.items()] + [(5, docs[5], "x", 1), (66, docs[66], "x", 1), (67, None, "x", 1), (68, "", "x", 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, kept string, n_bytes long").repartition(6)
    got = passages.passage_digests(frame).collect()
    want = brute(docs | {67: "", 68: ""})
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id], r.doc_id
    assert passages.passage_digests(frame.limit(0)).collect() == []


@pytest.mark.parametrize("variants", [2, 3, 4])
def test_variants_of_a_hot_passage_meet_across_pairs_of_blocks(monkeypatch, variants):
    """The passes in this process (Spark's workers see no patched limits), with all pairs of blocks in one shard."""
    monkeypatch.setattr(passages, "CONTEXTS", 1)
    monkeypatch.setattr(passages, "BLOCK_BYTES", 1)  # a block for each document
    for seed in range(6):
        rng = random.Random(seed)
        passage = "".join(rng.choice("abcdefgh ") for _ in range(130))
        docs = {i: passage + "".join(rng.choice("uvwxyz ") for _ in range(130)) for i in range(variants)}
        batches = [pa.record_batch([pa.array([k], pa.int64()), pa.array([t])], ["key", "text"]) for k, t in docs.items()]
        blocks = pa.Table.from_batches(passages._blocked("text")(iter(batches)))
        listed = pa.Table.from_batches(passages._listed(1)(iter(blocks.to_batches())))
        repeated = passages._repeated(None, listed)
        sent = []
        for block in blocks.column("block").to_pylist():
            mine = [t.filter(pc.equal(t.column(c), block)) for t, c in ((blocks, "block"), (repeated, "of"))]
            sent.append(passages._contexts(1)(None, *mine))
        pairs = [passages.unpacked(x)[1].max() for t in sent for x in t.column("contexts").to_pylist() if x]
        assert max(pairs) > 0
        spans = passages._matched(None, pa.concat_tables(sent))
        for block in blocks.column("block").to_pylist():
            mine = [t.filter(pc.equal(t.column(c), block)) for t, c in ((blocks, "block"), (spans, "of"))]
            for key, _, size, runs, kept in zip(*(c.to_pylist() for c in passages._cut(None, *mine).columns)):
                assert (size, size - len(kept), len(runs), hashlib.sha256(kept).hexdigest()) == brute(docs)[key], (seed, key)


def test_null_ids_come_last_and_texts_are_cut_by_whole_characters(spark):
    line = "".join(chr(0xE0 + i % 20) + str(i) for i in range(80))
    rows = [(None, "z" + line, "en", "s", 0), (4, line + " end", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = passages.without_passages(docs).collect()
    assert {(r.doc_id, r.text, r.n_chars) for r in got} == {(4, line + " end", len(line) + 4), (None, "z", 1)}
    assert passages.without_passages(docs).columns == docs.columns


def test_paragraphs_agree_with_brute_force(spark):
    rng = random.Random(8)
    lines = [" ".join(f"w{rng.randint(0, 400)}" for _ in range(rng.randint(14, 40))) for _ in range(60)]
    rows = []
    for i in range(80):
        text = []
        for _ in range(rng.randint(1, 5)):
            words = rng.choice(lines).split()
            if rng.random() < 0.6:
                words[rng.randrange(len(words))] = f"n{rng.randint(0, 9999)}"
            text.append(" ".join(words).upper() if rng.random() < 0.3 else " ".join(words))
        rows.append((i, "\n".join(text)))
    units = []
    for i, text in rows:
        at = 0
        for line in text.split("\n"):
            words = line.lower().split()
            if len(words) >= paragraphs.PARAGRAPH:
                units.append((i, at, {tuple(words[k : k + 5]) for k in range(len(words) - 4)}))
            at += len(line) + 1
    root = list(range(len(units)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(units):
        for j in range(i):
            b = units[j]
            if len(a[2] & b[2]) >= 0.8 * len(a[2] | b[2]):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    want = {}
    for i, u in enumerate(units):
        if find(i) != i:
            want[u[0]] = want.get(u[0], 0) + 1
    extra = [(None, rows[0][1]), (200, None), (201, "")]
    docs = spark.createDataFrame(rows + extra, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.n_paragraphs for r in paragraphs.repeated_paragraphs(docs).collect()}
    none = got.pop(None)
    assert none == sum(len(x.split()) >= paragraphs.PARAGRAPH for x in rows[0][1].split("\n"))
    missed = sum(max(0, n - got.get(k, 0)) for k, n in want.items())
    assert all(n <= want.get(k, 0) for k, n in got.items())
    assert missed <= 0.02 * sum(want.values())
    assert paragraphs.repeated_paragraphs(docs.limit(0)).collect() == []


def test_passages_inside_paragraphs_are_found(spark):
    rng = random.Random(4)
    words = lambda n: " ".join(f"v{rng.randint(0, 10**6)}" for _ in range(n))
    shared = words(51)
    rows = [(1, f"{words(70)} {shared} {words(33)}"), (2, words(200)), (3, f"{words(15)} {shared} {words(90)}"), (4, words(15))]
    got = {r.doc_id: r for r in paragraphs.repeated_paragraphs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got) == {3} and got[3].kept_in == [1] and got[3].n_windows >= 1


def test_sets_of_buckets_dealt_out_as_pairs(spark, monkeypatch):
    monkeypatch.setattr(paragraphs, "BUCKET", 3)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(20):
        line = list(base)
        line[i * 3] = f"x{i}"
        rows.append((i, " ".join(line)))
    got = paragraphs.repeated_paragraphs(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in got) == list(range(1, 20))

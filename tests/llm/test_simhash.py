import random

import numpy as np
import pytest
import xxhash

from tessera.llm import simhash
from tessera.llm.components import components


def linked_by_force(rows, group, radius):
    root = np.arange(len(rows))
    sets = simhash.Sets(len(rows))
    for g in np.unique(group):
        at = np.flatnonzero(group == g)
        distance = np.bitwise_count(rows[at][:, None] ^ rows[at][None]).sum(-1)
        a, b = np.nonzero(distance <= radius)
        sets.link(at[a], at[b])
    return sets.root if len(rows) else root


@pytest.mark.parametrize("words,radius", [(1, 4), (1, 0), (1, 7), (4, 48)])
def test_bit_sliced_links_agree_with_brute_force(words, radius):
    rng = np.random.default_rng(words * 100 + radius)
    rows, group = [], []
    for g in range(120):
        n = 300 if g % 40 == 39 else int(rng.integers(1, 14))
        base = rng.integers(0, 2**64, (n, words), dtype=np.uint64)
        for i in range(1, n):
            if rng.random() < 0.6:
                base[i] = base[rng.integers(0, i)]
                for _ in range(int(rng.integers(0, radius + 3))):
                    bit = int(rng.integers(0, 64 * words))
                    base[i, bit // 64] ^= np.uint64(1 << bit % 64)
        rows.append(base)
        group += [g] * n
    rows, group = np.concatenate(rows), np.array(group)
    assert (simhash.linked(rows, group, radius) == linked_by_force(rows, group, radius)).all()


def brute_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = lowered.encode().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_classes_agree_with_brute_force(spark):
    rng = random.Random(5)
    texts = [None, "", " \n", "One", "one two", "One two three FOUR", "É ÀB c d e f"]
    for _ in range(12):
        words = [f"w{rng.randint(0, 999)}" for _ in range(400)]
        for _ in range(rng.randint(1, 8)):
            texts.append(" ".join(words))
            words[rng.randrange(400)] = "changed"
    rows = [(i, t, 1, 2, 3) for i, t in enumerate(texts)] + [(7, texts[7], 1, 2, 3), (None, "one two", 1, 2, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id long, w0 long, component_id long").repartition(5)
    got = simhash.simhash_classes(docs).collect()
    assert len(got) == len(rows)
    prints = [brute_fingerprint(t) for t in texts]
    root = linked_by_force(np.array(prints, np.uint64)[:, None], np.zeros(len(texts), int), 4)
    for r in got:
        if r.doc_id is not None:
            assert r.fingerprint == f"{prints[r.doc_id]:016x}" and r.component_id == root[r.doc_id]
        else:
            assert r.component_id == root[4]
    assert simhash.simhash_classes(docs.limit(0)).collect() == []


def test_large_buckets_are_dealt_out_as_pairs_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 16)
    rng = np.random.default_rng(9)
    base = rng.integers(0, 2**64, 3, dtype=np.uint64)
    values = np.unique(np.concatenate([b ^ (np.uint64(1) << rng.integers(0, 64, 90).astype(np.uint64)) for b in base]))
    rows = [(i, 0, int(v) - (1 << 64 if int(v) >> 63 else 0)) for i, v in enumerate(values.tolist())]
    prints = spark.createDataFrame(rows, "id long, tie long, w0 long")
    got = {r.id: r.component_id for r in simhash.near_classes(prints, simhash.pigeonhole_keys(4), 4).collect()}
    want = linked_by_force(values[:, None], np.zeros(len(values), int), 4)
    assert got == dict(enumerate(want.tolist()))


def test_components_of_chains_stars_and_loops(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 40)] + [(200, 200), (300, 301), (301, 300), (302, 301)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {i: 0 for i in range(61)} | {100 + i: 100 for i in range(40)} | {300: 300, 301: 300, 302: 300}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_one_of_each_keeps_clean_documents(spark):
    rng = random.Random(6)
    rows, groups = [], []
    for g in range(30):
        words = [f"w{rng.randint(0, 5000)}" for _ in range(200)]
        groups.append([])
        for c in range(3 if g < 10 else 1):
            copy = list(words)
            for _ in range(2 * c):
                copy[rng.randrange(200)] = f"x{rng.random()}"
            groups[-1].append(len(rows))
            rows.append((len(rows), " ".join(copy), "en", "s", 0))
    rows.append((0, rows[0][1], "en", "s", 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [g[0] for g in groups]


def alike(rng, n, similarity):
    """Two texts of n shingles each whose sets have about the similarity, and the exact one."""
    words = [f"w{rng.random()}" for _ in range(n + 4)]
    other = list(words)
    other[: round(n * (1 - 2 * similarity / (1 + similarity)))] = [f"x{rng.random()}" for _ in range(round(n * (1 - 2 * similarity / (1 + similarity))))]
    a, b = ({tuple(x[i : i + 5]) for i in range(n)} for x in (words, other))
    return " ".join(words), " ".join(other), len(a & b) / len(a | b)


@pytest.mark.parametrize("set_bytes", [16 << 20, 3000])
def test_one_of_each_links_by_real_similarity(spark, monkeypatch, set_bytes):
    monkeypatch.setattr(simhash, "SET_BYTES", set_bytes)
    rng = random.Random(12)
    rows, want = [], []
    for similarity in [0.6, 0.7, 0.79, 0.81] * 30:
        a, b, real = alike(rng, 400, similarity)
        assert abs(real - similarity) < 0.008
        want += [len(rows)] + ([len(rows) + 1] if real < 0.8 else [])
        rows += [(len(rows), a), (len(rows) + 1, b)]
    template = [f"t{i}" for i in range(170)]
    for i in range(60):  # no two at 0.8, all at more than 0.6
        want.append(len(rows))
        rows.append((len(rows), " ".join(template + [f"u{i}.{k}" for k in range(45)])))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id for r in simhash.one_of_each(docs).collect()}
    lost = set(want) - got
    assert not lost
    assert len(got - set(want)) <= 2  # of 30 pairs at 0.81: candidates are found by bands


def test_one_of_each_tells_documents_of_one_id_or_none_apart(spark):
    texts = [" ".join(f"{k}.{i}" for i in range(60)) for k in range(4)]
    docs = spark.createDataFrame([(5, texts[0]), (5, texts[1]), (None, texts[2]), (None, texts[3]), (None, ""), (7, None)], "doc_id long, text string")
    got = [(r.doc_id, r.text) for r in simhash.one_of_each(docs).collect()]
    assert sorted(got, key=repr) == sorted([(5, texts[0]), (5, texts[1]), (None, texts[2]), (None, texts[3]), (7, None)], key=repr)


def test_similar_agrees_with_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(200):
        sets = [rng.choice(40, int(rng.integers(1, 40)), replace=False)]
        for _ in range(int(rng.integers(1, 25))):
            x = sets[int(rng.integers(0, len(sets)))]
            sets.append(np.union1d(x[rng.random(len(x)) < 0.9], rng.integers(0, 40, int(rng.integers(1, 4)))))
        sets = [np.unique(x).astype(np.uint64) for x in sets]
        links = simhash.Sets(len(sets))
        for i, a in enumerate(sets):
            for j in range(i):
                if 5 * len(np.intersect1d(a, sets[j])) >= 4 * len(np.union1d(a, sets[j])):
                    links.link(np.array([i]), np.array([j]))
        assert (simhash.similar(sets) == links.root).all()


def signed(x):
    return x.astype(np.uint64).view(np.int64).tolist()


def counted(monkeypatch):
    """The numbers of links that components() gets and of rows that outside_pairs() deals out."""
    seen, pairs, outside = [], [], simhash.outside_pairs

    def components_(links):
        links = links.localCheckpoint()
        seen.append(links.distinct().count())
        return components(links)

    def outside_(*args):
        dealt = outside(*args).localCheckpoint()
        pairs.append(dealt.count())
        return dealt

    monkeypatch.setattr(simhash, "components", components_)
    monkeypatch.setattr(simhash, "outside_pairs", outside_)
    return seen, pairs


@pytest.mark.parametrize("block", [16_384, 32])
def test_a_dense_group_does_not_emit_its_links_for_each_key_and_pair_of_blocks(spark, monkeypatch, block):
    """Near copies that share many of 96 bands, and never the same ones: 30 links a row before, and 90 with pairs of blocks."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    seen, pairs = counted(monkeypatch)
    rng = np.random.default_rng(2)
    n = 500
    bits = np.repeat(rng.integers(0, 2, (1, 256), dtype=np.uint8), n, axis=0)
    bits ^= rng.random((n, 256)) < 0.06
    words = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)
    rows = list(zip(range(n), [0] * n, *(signed(words[:, i].copy()) for i in range(4))))
    prints = spark.createDataFrame(rows, "id long, tie long, w0 long, w1 long, w2 long, w3 long")
    got = simhash.near_classes(prints, simhash.band_keys(4, 6), 60).collect()
    assert len(got) == n and {r.component_id for r in got} == {0}
    assert sum(seen) <= 12 * n
    assert sum(pairs) <= 2 * n


def test_blocks_and_contracted_links_lose_no_link(spark, monkeypatch):
    """Dense groups with chains that leave them, and rows that are linked to a few rows of a dense group only."""
    monkeypatch.setattr(simhash, "BLOCK", 8)
    rng = np.random.default_rng(13)
    values = []
    for base in rng.integers(0, 2**64, 5, dtype=np.uint64):
        values += [base ^ (np.uint64(1) << np.uint64(b)) for b in rng.integers(0, 64, 40)]
        end = values[-1]
        for _ in range(12):
            for b in rng.choice(64, int(rng.integers(3, 6)), replace=False):
                end ^= np.uint64(1) << np.uint64(b)
            values.append(end)
    values = np.unique(np.array(values, np.uint64))
    prints = spark.createDataFrame([(i, 0, v) for i, v in enumerate(signed(values))], "id long, tie long, w0 long")
    got = {r.id: r.component_id for r in simhash.near_classes(prints, simhash.pigeonhole_keys(4), 4).collect()}
    want = linked_by_force(values[:, None], np.zeros(len(values), int), 4)
    assert 8 < len(set(want.tolist())) < 70
    assert got == dict(enumerate(want.tolist()))


def test_rows_outside_the_largest_class_meet_all_others(spark):
    rows = [(k, 100 * k + i, 100 * k + (0 if i < 60 else 60 if i < 70 else i)) for k in range(3) for i in range(20 * k + 40)]
    frame = spark.createDataFrame(rows, "key long, node long, root long")
    dealt = simhash.outside_pairs(frame, simhash.F.lit(1), 8).collect()
    assert {r.key for r in dealt} == {2}  # the others are one class each
    groups = {}
    for r in dealt:
        groups.setdefault((r.key, r._pair), []).append(r)
        assert r._inside == (r.root == 200)
    met = {(a.node, b.node) for g in groups.values() for a in g for b in g}
    mine = [r for r in rows if r[0] == 2]
    assert all((a[1], b[1]) in met for a in mine for b in mine if a[2] != b[2])
    assert len(dealt) <= 60 * 3 + 20 * (8 + 3)


def test_texts_of_a_large_class_are_compared_across_its_blocks(spark, monkeypatch):
    """A template's pages, alike at 0.8 or more in a dense group and some small ones, in one coarse class of seven blocks of text."""
    monkeypatch.setattr(simhash, "SET_BYTES", 24_000)
    seen, pairs = counted(monkeypatch)
    rng = random.Random(21)
    template, rows, want = [f"t{i}" for i in range(150)], [], []
    for g in range(12):
        base = template + [f"g{g}.{k}" for k in range(60)]
        want.append(len(rows))
        for _ in range(160 if g == 0 else 3):
            copy = list(base)
            copy[rng.randrange(len(copy))] = f"x{rng.random()}"
            rows.append((len(rows), " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for _, t in rows)]
    links = simhash.Sets(len(rows))
    for i, a in enumerate(sets):
        for j in range(i):
            if 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                links.link(np.array([i]), np.array([j]))
    assert sorted(set(links.root.tolist())) == want
    assert sorted(r.doc_id for r in simhash.one_of_each(docs).collect()) == want
    assert sum(seen[-2:]) <= 3 * len(rows)
    assert len(rows) < pairs[-1] <= 4 * len(rows)  # 160 to two blocks of the 33 others, these to about 8; pairs of all blocks: 8 times the rows

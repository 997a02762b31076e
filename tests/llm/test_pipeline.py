import random

import pytest

import corpus_pipeline
from tessera.llm import packing, pretokens
from tessera.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _key long, _hash string, _id int, _tie int, _kept string, _host string, _failures int"
EXTRA = (7, "h", 8, 9, "k", "host", 1)


def words(rng, n):
    return " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    """Texts by id, and what the stages are to do with them."""
    rng = random.Random(11)
    texts = {i: words(rng, rng.randint(60, 200)) for i in range(40)}
    texts[100] = "too short"
    texts[101] = "a b c d e f g h " * 30
    texts[102], texts[103] = texts[3], texts[3]  # copies
    near = texts[5].split()
    near[len(near) // 2] = "changed"
    texts[104] = " ".join(near)
    passage = words(rng, 60)
    texts[200], texts[201] = f"{words(rng, 80)} {passage} {words(rng, 80)}", f"{words(rng, 90)} {passage} {words(rng, 70)}"
    texts[202] = words(rng, 9000)
    return texts, passage


def frame(spark, texts):
    rows = [(i, t, "en", f"s{i % 3}", len(t), *EXTRA) for i, t in texts.items()]
    rows += [(None, None, None, None, None, *EXTRA), (300, "", "en", "s", 0, *EXTRA), (7, texts[7], "en", "s1", len(texts[7]), *EXTRA)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def test_stages_do_what_they_say_and_keep_all_columns(spark, corpus):
    texts, passage = corpus
    docs = frame(spark, texts)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, "")
        assert kept.columns == docs.columns, name
        docs = spark.createDataFrame(kept.collect(), SCHEMA)
        rows = {r.doc_id: r for r in docs.collect()}
        assert all(tuple(r)[5:] == EXTRA for r in rows.values()), name
        if name == "quality_rules":
            assert set(rows) == set(texts) - {100, 101} and docs.count() == len(rows) + 1  # rows are kept as they are
        if name == "near_duplicates":
            assert set(rows) == set(texts) - {100, 101, 102, 103, 104} and docs.count() == len(rows)
            assert all(r.text == texts[i] for i, r in rows.items())
    assert passage in rows[200].text and rows[200].text == texts[200]
    left = texts[201].replace(passage, "").split()
    assert rows[201].n_chars == len(rows[201].text) and len(set(left) - set(rows[201].text.split())) <= 2
    assert len(rows[201].text) < len(texts[201]) - len(passage) + 3
    tok = pretokens.tokenizer(tokenizer_path("word_bpe_49k.json"))
    places, ends = {}, {}
    for r in corpus_pipeline.STAGES[-1][1](spark, docs, "").collect():
        assert r.start == ends.get(r.doc_id, 0) or r.piece > 0
        ends[r.doc_id] = ends.get(r.doc_id, 0) + r.length
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert ends == {i: len(tok.encode(r.text, add_special_tokens=False).ids) + 1 for i, r in rows.items()}
    assert all(sum(n for _, n in held) <= 2048 for held in places.values())
    assert len(places) == len(packing.best_fit([n for held in places.values() for _, n in held], 2048)[2])


def test_the_pipeline_takes_tables_as_they_are(spark, corpus, tmp_path):
    texts, _ = corpus
    frame(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in rows} == set(texts) - {100, 101, 102, 103, 104}
    frame(spark, texts).limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").collect() == []


def test_near_duplicates_are_linked_from_a_similarity_of_eight_tenths_on(spark):
    """Pairs on both sides of the bound, by their exact similarity, and a long chain below it that must not go."""
    from tessera.llm import simhash

    rng = random.Random(4)
    rows, similar = [], {}
    for k in range(300):
        base = words(rng, rng.randint(60, 300)).split()
        other = list(base)
        for i in rng.sample(range(len(base)), rng.randint(1, max(2, len(base) // 25))):
            other[i] = f"x{rng.randint(0, 10**6)}"
        a, b = ({tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in (base, other))
        similar[2 * k + 1] = len(a & b) / len(a | b)
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(other))]
    template = words(rng, 60)
    chain = [(10_000 + k, f"{template} {words(rng, 40)}") for k in range(60)]  # a page template: 60 of 100 words
    kept = {r.doc_id for r in simhash.one_of_each(spark.createDataFrame(rows + chain, "doc_id long, text string").repartition(6)).collect()}
    assert kept >= {i for i, _ in chain} and kept >= {2 * k for k in range(300)}
    assert all(i in kept for i, j in similar.items() if j < 0.8)
    near = [i for i, j in similar.items() if j >= 0.8]
    assert len(near) > 50 and sum(i in kept for i in near) <= 0.04 * len(near)

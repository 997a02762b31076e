import random
import re
from collections import Counter

from tessera.llm import quality

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    marked = [False] * len(words)
    for i in range(len(words) - 7):
        if windows[tuple(words[i : i + 8])] > 1:
            marked[i : i + 8] = [True] * 8
    seen, lines = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            lines += line in seen
            seen.add(line)
    failed = len(words) < 20 or 100 * sum(marked) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), lines, sum(marked), failed


def test_rules_agree_with_brute_force(spark):
    rng = random.Random(3)
    texts = [None, "", " \n\t ", "a b c\n" * 30, "é\x85\x1c日本 # | <>" * 9]
    texts += ["".join(rng.choice(["a ", "b ", "c\n", "dé ", "\n", "& "]) for _ in range(rng.randint(0, 120))) for _ in range(200)]
    rows = [(i, t, f"h{i % 3}", "x") for i, t in enumerate(texts)] + [(None, "null id", None, "x"), (4, texts[4], "h1", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_words string")
    got = quality.judged(docs).collect()
    assert len(got) == len(rows)
    by_id = {}
    for r in got:
        by_id.setdefault(r.doc_id, r)
    for i, t in enumerate(texts):
        r = by_id[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(t), t
    assert quality.judged(docs.limit(0)).collect() == []


def test_hosts_that_only_fail_are_rejected_and_small_ones_are_shrunk(spark):
    good = " ".join(f"w{i}" for i in range(40))
    rows = [(i, "bad", "spam") for i in range(300)] + [(1000, good, "spam")]
    rows += [(2000 + i, good, f"host{i % 20}") for i in range(400)] + [(3000, "bad", "one"), (3001, good, None), (3002, "bad", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = {r.doc_id: r.kept for r in quality.judged(docs).collect()}
    assert not kept[1000] and all(kept[2000 + i] for i in range(400)) and kept[3001] and not kept[3000]
    verdicts = {r.host: r for r in quality.host_verdicts(quality.text_rules(docs)).collect()}
    assert verdicts["spam"].rejected and not verdicts["one"].rejected and verdicts["one"].rate_words < 0.6
    left = {r.doc_id for r in quality.good_documents(docs).collect()}
    assert left == {i for i, k in kept.items() if k}


def test_a_rejected_null_host_takes_its_documents(spark):
    good = " ".join(f"w{i}" for i in range(40))
    rows = [(i, "bad", None) for i in range(300)] + [(999, good, None)] + [(1000 + i, good, "h") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert {r.doc_id for r in quality.good_documents(docs).collect()} == {1000 + i for i in range(20)}
    assert {r.doc_id for r in quality.judged(docs).where("kept").collect()} == {1000 + i for i in range(20)}


def test_documents_go_where_their_host_is_strict(spark):
    words = lambda n, k: " ".join(f"w{k}x{i}" for i in range(n))
    symbols = lambda k: words(30, k) + " $$$ ### |||"
    lines = lambda k: "\n".join([f"line {k} of words"] * 3 + [words(40, k)])
    rows = [(i, symbols(i) if i % 4 == 0 else words(40, i), "math") for i in range(200)]  # a quarter has many symbols
    rows += [(1000 + i, symbols(i) if i == 0 else lines(i) if i == 1 else words(40, i), "clean") for i in range(400)]  # one of each
    rows += [(2000 + i, symbols(i) if i % 10 else words(40, i), "junk") for i in range(300)]
    rows += [(3000 + i, words(40, i), f"h{i % 10}") for i in range(500)]
    docs = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "doc_id long, text string, source string, _host string, _failures int, STRICT int")
    got = {r.doc_id: r for r in quality.judged(docs).collect()}
    assert not any(r.base_failed for r in got.values())
    verdicts = {r.host: r for r in quality.host_verdicts(quality.text_rules(docs)).collect()}
    assert verdicts["junk"].rejected and not verdicts["math"].rejected and not verdicts["clean"].rejected
    assert all(got[i].kept == (i % 4 != 0) for i in range(200)) and all(got[1000 + i].kept for i in range(400))
    assert not any(got[2000 + i].kept for i in range(300)) and all(got[3000 + i].kept for i in range(500))
    left = quality.good_documents(docs)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {i for i, r in got.items() if r.kept}


def test_base_rules_and_verdicts_agree_with_the_sql(spark, tmp_path):
    import duckdb

    from tessera.llm.queries import QUERIES, SQL

    rng = random.Random(9)
    some = lambda k: ["x|", "y$$", "s\n"] if k % 7 == 0 else ["w", f"z{rng.randint(0, 99)}", f"v{rng.randint(0, 99)}\n"]
    texts = [" ".join(rng.choice(some(k)) for _ in range(rng.randint(5, 80))) for k in range(400)]
    rows = [(i, t, rng.choice(["a", "b", None, "c", "d"]) if len(t or "") % 3 else "e") for i, t in enumerate([None, "", *texts])]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in QUERIES["op5_quality_rules"](spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert got == sorted(con.sql(SQL["op5_quality_rules"]).fetchall()) and len({r[-1] for r in got}) == 2

import ast
import os
import shutil
import subprocess
import sys

import __spark_entry__ as entry

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_every_sql_has_a_query_and_the_flagship_runs(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_the_entry_works_without_the_corpus_operators(tmp_path):
    ignored = shutil.ignore_patterns(".git", "__pycache__", "llm", "corpus_pipeline.py")
    shutil.copytree(ROOT, tmp_path / "copy", ignore=ignored)
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(n.startswith('op') or n == 'pipeline' for n in e.queries() if n != 'order_by_multi'))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "copy", capture_output=True, text=True, check=True).stdout.split()
    assert int(out[0]) > 100 and out[0] == out[1] and out[2] == "False"


def test_nothing_else_imports_the_corpus_operators():
    for folder, _, names in os.walk(os.path.join(ROOT, "tessera")):
        if os.path.basename(folder) == "llm":
            continue
        for name in names:
            if name.endswith(".py"):
                tree = ast.parse(open(os.path.join(folder, name), encoding="utf-8").read())
                for node in ast.walk(tree):
                    names_in = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
                    assert not any("llm" in n for n in names_in), name


def test_a_sample_of_queries_gives_rows(spark):
    queries = entry.queries()
    for name in ("find_all_paged", "tx_update_versioned", "sync_latest", "pattern_extract", "many_to_many"):
        assert queries[name](spark, "/root/testdata/sf0.001").count() > 0

"""The entry module, with and without the training-data operators."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def names(folder):
    code = "import __spark_entry__ as e; print(*sorted(e.queries())); print(*sorted(e.oracle_sql()))"
    return [set(x.split()) for x in subprocess.run([sys.executable, "-c", code], cwd=folder, capture_output=True, text=True, check=True, timeout=120).stdout.splitlines()]


@pytest.mark.parametrize("gone", [["lumenlog/llm"], ["lumenlog/llm", "corpus_pipeline.py"]])
def test_the_rest_imports_without_the_training_data_operators(tmp_path, gone):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", *[os.path.basename(g) for g in gone]))
    queries, sql = names(copy)
    assert "rrf_default" in queries and sql <= queries
    assert not any(q.startswith("op") and q[2].isdigit() or q == "pipeline" for q in queries)


def test_every_sql_text_has_its_query():
    queries, sql = names(ROOT)
    assert sql <= queries

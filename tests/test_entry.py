"""The entry module works with and without the optional text operators."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
NAMES = "import __spark_entry__ as e; print(*sorted(e.queries())); print(*sorted(e.oracle_sql()))"


def names(root):
    ran = subprocess.run([sys.executable, "-c", NAMES], cwd=root, capture_output=True, text=True, check=True)
    return [set(line.split()) for line in ran.stdout.splitlines()]


@pytest.mark.parametrize("gone", [["skyledger/llm"], ["skyledger/llm", "corpus_pipeline.py"]])
def test_entry_without_text_operators(tmp_path, gone):
    left_out = [os.path.join(ROOT, path) for path in gone]
    skip = lambda folder, held: [n for n in held if n in (".git", "__pycache__") or os.path.join(folder, n) in left_out]
    copy = shutil.copytree(ROOT, tmp_path / "copy", ignore=skip)
    queries, sql = names(copy)
    assert {"search_full", "merge_catalog"} <= queries and sql <= queries
    assert not [n for n in queries if n.startswith("op") or n == "pipeline"]


def test_every_sql_has_its_query():
    queries, sql = names(ROOT)
    assert sql <= queries

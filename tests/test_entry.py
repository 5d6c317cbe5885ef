"""The entry without the corpus operators: the other queries stay."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
ASK = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), sum(q.startswith('op') or q == 'pipeline' for q in e.queries()))"


@pytest.mark.parametrize("gone", [("sheaf/llm", "tests/llm"), ("sheaf/llm", "tests/llm", "corpus_pipeline.py")])
def test_queries_without_corpus_operators(tmp_path, gone):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
    for name in gone:
        path = copy / name
        if path.is_dir():
            shutil.rmtree(path)
        elif path.exists():
            path.unlink()
    done = subprocess.run([sys.executable, "-c", ASK], cwd=copy, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(copy)}, check=False)
    assert done.returncode == 0, done.stderr
    listed, oracles, corpus = map(int, done.stdout.split())
    assert listed >= 54 and oracles >= 40 and corpus == 0

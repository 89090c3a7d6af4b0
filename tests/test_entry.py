"""The entry module without the training-data operators."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
CODE = "import __spark_entry__ as e; q = e.queries(); print(len(q), sum(n.startswith('op') or n == 'pipeline' for n in q), set(e.oracle_sql()) <= set(q))"


def entry(folder, **env):
    done = subprocess.run([sys.executable, "-c", CODE], cwd=folder, env=os.environ | {"PYTHONPATH": str(folder)} | env, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    return done.stdout.split()


@pytest.fixture
def copy(tmp_path):
    shutil.copytree(ROOT / "boardlake", tmp_path / "boardlake", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    return tmp_path


def test_entry_without_the_folders(copy):
    n, training, known = entry(copy)
    assert int(n) > 90 and training == "0" and known == "True"


def test_entry_with_the_pipeline_alone(copy):
    (copy / "corpus_pipeline.py").write_text("from boardlake.llm import packing\n")
    assert entry(copy)[1] == "0"


def test_nothing_else_imports_the_training_operators():
    for f in (ROOT / "boardlake").rglob("*.py"):
        if "llm" not in f.parts:
            assert "boardlake.llm" not in f.read_text(), f

"""The driver's contract holds without the training-data operators, and says when a part of them is missing."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
HAS_LLM = (ROOT / "tessera" / "llm").is_dir()


def copied(tmp_path: Path, *without: str) -> Path:
    shutil.copytree(ROOT / "tessera", tmp_path / "tessera", ignore=shutil.ignore_patterns("__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (ROOT / name).exists():
            shutil.copy(ROOT / name, tmp_path)
    for name in without:
        path = tmp_path / name
        shutil.rmtree(path) if path.is_dir() else path.unlink(missing_ok=True)
    return tmp_path


def imported(folder: Path) -> subprocess.CompletedProcess:
    code = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q); print(sorted(q))"
    return subprocess.run([sys.executable, "-c", code], cwd=folder, env=os.environ | {"PYTHONPATH": str(folder)}, capture_output=True, text=True)


def test_without_the_training_data_operators(tmp_path):
    folder = copied(tmp_path, "tessera/llm", "corpus_pipeline.py")
    (folder / "tessera" / "llm" / "__pycache__").mkdir(parents=True)  # what a deletion may leave
    got = imported(folder)
    assert got.returncode == 0, got.stderr
    assert "bm25_topk" in got.stdout and "op1_" not in got.stdout and "'pipeline'" not in got.stdout


@pytest.mark.skipif(not HAS_LLM, reason="the training-data operators are absent")
def test_a_missing_part_of_them_is_an_error(tmp_path):
    got = imported(copied(tmp_path, "tessera/llm/kernel.py"))
    assert got.returncode != 0 and "kernel" in got.stderr

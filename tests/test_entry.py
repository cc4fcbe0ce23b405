"""The driver's entry points with and without the optional operators."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
NAMES = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); print(len(q), sum(n.startswith('op') or n == 'pipeline' for n in q), sum(n.startswith('op') or n == 'pipeline' for n in o))"


def counted(code: str, folder: Path) -> list[int]:
    got = subprocess.run([sys.executable, "-c", code], cwd=folder, env={**os.environ, "PYTHONPATH": str(folder)}, capture_output=True, text=True, timeout=120, check=True)
    return [int(x) for x in got.stdout.split()]


def test_without_the_folders(tmp_path):
    shutil.copytree(ROOT, tmp_path / "copy", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    n, extra, sql = counted(NAMES, tmp_path / "copy")
    assert n > 90 and extra == sql == 0


@pytest.mark.skipif(not (ROOT / "skyecho" / "llm").is_dir(), reason="the operators are removed")
def test_without_a_library():
    n, extra, sql = counted(f"import sys; sys.modules['public_tokenizers'] = None; {NAMES}", ROOT)
    assert n > 90 and extra == sql == 0
    whole, extra, _ = counted(NAMES, ROOT)
    assert extra == 11 and whole == n + 11

"""The rest of the repository without the subpackage and what goes with it."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
CODE = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 50 and not [n for n in q if n.startswith('op') or n == 'pipeline' or n not in q]; assert set(e.oracle_sql()) <= set(q)"


@pytest.mark.parametrize("pipeline_too", [False, True])
def test_entry_on_a_copy(tmp_path, pipeline_too):
    skipped = shutil.ignore_patterns("llm", ".git", "__pycache__", ".pytest_cache")
    shutil.copytree(ROOT, tmp_path / "copy", ignore=skipped)
    if pipeline_too:
        (tmp_path / "copy" / "corpus_pipeline.py").unlink(missing_ok=True)
    done = subprocess.run([sys.executable, "-c", CODE.replace("n.startswith('op')", "(n[:2] == 'op' and n[2].isdigit())")], cwd=tmp_path / "copy", capture_output=True, text=True)
    assert done.returncode == 0, done.stderr

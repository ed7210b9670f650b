"""The entry stands on its own without the optional parts."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("gone", [("auralake/llm", "tests/llm"), ("auralake/llm", "tests/llm", "corpus_pipeline.py")])
def test_core_without_llm(tmp_path, gone):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "spark-warehouse"))
    for name in gone:
        if (copy / name).is_dir():
            shutil.rmtree(copy / name)
        elif (copy / name).exists():
            (copy / name).unlink()
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 50 and not [k for k in q if k.startswith('op1') or k == 'pipeline']; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, env={"PATH": "/usr/bin:/bin"}, timeout=120)


def test_a_missing_dependency_leaves_llm_out(tmp_path):
    """Without a library that the optional part needs, the core still imports."""
    code = "import sys; sys.modules['xxhash'] = None; import __spark_entry__ as e; assert 'pk_violations' in e.queries() and 'pipeline' not in e.queries()"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)

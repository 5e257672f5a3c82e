from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__

ROOT = Path(__file__).resolve().parent.parent


def test_every_core_query_has_sql():
    from millrace import registry

    assert set(registry.core_queries()) == set(registry.core_sql())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_imports_without_the_training_data_operators(tmp_path):
    shutil.copytree(ROOT / "millrace", tmp_path / "millrace", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    said = subprocess.run(
        [sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"],
        cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, check=False,
    )
    assert said.returncode == 0, said.stderr
    a, b = map(int, said.stdout.split())
    assert a == b >= 25


def test_hybrid_retrieve_over_the_smallest_tables(spark):
    data = Path(__spark_entry__.SMOKE_DIR)
    if data.is_dir():
        assert __spark_entry__.entry(spark).count() > 0

"""The driver's contract, with and without the optional parts."""

import shutil
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parents[1]


def test_queries_and_sql_belong_together():
    import __spark_entry__ as e

    found, sql = e.queries(), e.oracle_sql()
    assert set(sql) <= set(found) and len(found) >= 70


def test_entry_runs(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["l_suppkey", "signal"] and e.entry(spark).count() > 0


def test_everything_else_works_without_the_optional_parts(tmp_path):
    shutil.copytree(REPO, tmp_path / "repo", ignore=shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__"))
    import os

    part = [sys.executable, "-m", "pytest", "-x", "-q", "tests/test_run.py", "tests/test_operators.py", "-k", "not sql and not take_every"]
    subprocess.run(part, cwd=tmp_path / "repo", check=True, timeout=900, env={k: v for k, v in os.environ.items() if not k.startswith("PYSPARK_GATEWAY")})
    said = "import __spark_entry__ as e; q = e.queries(); assert len(q) >= 60 and 'pipeline' not in q and not any(n.startswith('op1_') for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", said], cwd=tmp_path / "repo", check=True, timeout=120)

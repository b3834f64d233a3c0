"""The driver contract, with and without the training-data part."""

import shutil
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parents[1]


def test_flagship(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).limit(5).count() == 5
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_imports_without_the_training_data_part(tmp_path):
    shutil.copytree(REPO, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", "spark-warehouse"))
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(k[:2] == 'op' and k[2].isdigit() for k in q) and 'pipeline' not in q; e.oracle_sql()"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path / "repo", check=True)
    subprocess.run([sys.executable, "-B", "-m", "pytest", "-q", "-x", "tests/test_dsp.py", "tests/test_knn.py", "-p", "no:cacheprovider"], cwd=tmp_path / "repo", check=True)


def test_nothing_else_imports_the_training_data_part():
    for path in (REPO / "pulsegrid").rglob("*.py"):
        if "llm" not in path.parts:
            assert "pulsegrid.llm" not in path.read_text()

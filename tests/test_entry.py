import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_entry_and_registry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["pos", "f_score"] and e.entry(spark).count() == 3
    assert set(e.oracle_sql()) <= set(e.queries())


def test_library_works_without_the_training_data_operators(tmp_path):
    """Copies everything but the two folders and the pipeline, imports the entry there, and runs tests of the copy."""
    script = (
        "import shutil, sys; shutil.copytree(sys.argv[1], sys.argv[2], ignore=shutil.ignore_patterns('llm', 'corpus_pipeline.py', '.git', '__pycache__'));"
        "sys.path.insert(0, sys.argv[2]); import __spark_entry__ as e; names = set(e.queries());"
        "assert 'g8_anova_f' in names and not any(n.startswith('op') or n == 'pipeline' for n in names)"
    )
    subprocess.run([sys.executable, "-c", script, str(ROOT), str(tmp_path / "copy")], check=True, cwd=tmp_path)
    pytest = [sys.executable, "-m", "pytest", "-q", "-p", "no:cacheprovider", "tests"]
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    listed = subprocess.run([*pytest, "--collect-only"], check=True, cwd=tmp_path / "copy", env=env, capture_output=True, text=True).stdout
    assert "test_queries.py" in listed and "llm" not in listed
    subprocess.run([*pytest, "-k", "bodies or geometry_of or f7_enum"], check=True, cwd=tmp_path / "copy", env=env, capture_output=True)


def test_nothing_imports_the_training_data_operators():
    for path in (ROOT / "millrace").rglob("*.py"):
        if "llm" not in path.parts:
            assert "millrace.llm" not in path.read_text(), path

"""The core must work where the optional subpackage, its pipeline and its tests are gone."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
SF = "/root/testdata/sf0.001"
SCRIPT = """
import sys
import __spark_entry__ as e
names = set(e.queries())
assert names and not [n for n in names if n.startswith("op") or n == "pipeline"] and set(e.oracle_sql()) <= names
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
assert e.entry(spark).count() == 10
assert e.queries()["kernel_alpha"](spark, sys.argv[1]).count() > 0
print("fine", len(names))
"""


def _copy(to: Path) -> Path:
    shutil.copytree(ROOT, to, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache", "llm", "corpus_pipeline.py"))
    return to


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the shared tables")
def test_core_without_the_subpackage(tmp_path):
    root = _copy(tmp_path / "copy")
    env = {**os.environ, "PYTHONPATH": str(root)}
    done = subprocess.run([sys.executable, "-c", SCRIPT, SF], cwd=root, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0 and "fine" in done.stdout, done.stderr[-2000:]


def test_nothing_else_imports_the_subpackage():
    for path in [*ROOT.glob("tangentia/**/*.py"), *ROOT.glob("tests/*.py")]:
        if "llm" not in path.relative_to(ROOT).parts and path != Path(__file__).resolve():
            assert "tangentia.llm" not in path.read_text(), path


def test_a_missing_library_of_the_subpackage_leaves_the_core(tmp_path):
    """Also where the subpackage is there but can't be imported."""
    root = tmp_path / "copy"
    shutil.copytree(ROOT, root, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache", "tests"))
    script = "import sys; sys.modules['xxhash'] = None\nimport __spark_entry__ as e\nnames = set(e.queries())\nassert 'scm_by_supplier' in names and 'op1_html' not in names\nprint('fine')"
    done = subprocess.run([sys.executable, "-c", script], cwd=root, env={**os.environ, "PYTHONPATH": str(root)}, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0 and "fine" in done.stdout, done.stderr[-2000:]

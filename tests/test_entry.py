"""The driver contract holds with the training-data subpackage and without it."""

import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as e

ROOT = Path(__file__).resolve().parents[1]


def test_entry(spark):
    assert e.entry(spark).count() == 25
    assert set(e.oracle_sql()) <= set(e.queries())


def test_imports_without_the_subpackage(tmp_path):
    for f in ("__spark_entry__.py", "terralith"):
        (shutil.copytree if (ROOT / f).is_dir() else shutil.copy)(ROOT / f, tmp_path / f)
    shutil.rmtree(tmp_path / "terralith" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), any(n.startswith('op') for n in q), 'pipeline' in q)"
    got = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, timeout=120)
    n, op, pipeline = got.stdout.split()
    assert int(n) > 200 and op == "False" and pipeline == "False", got.stderr


def test_nothing_else_imports_the_subpackage():
    own = {ROOT / "terralith" / "llm", ROOT / "tests" / "llm"}
    for f in [*ROOT.glob("terralith/**/*.py"), *ROOT.glob("tests/**/*.py"), ROOT / "bench.py"]:
        if f.exists() and not own & set(f.parents) and f != Path(__file__).resolve():
            assert "terralith.llm" not in f.read_text() and "from ..llm" not in f.read_text(), f

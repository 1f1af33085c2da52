"""What the driver calls, with and without the optional part."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).parents[1]


def test_entry(spark):
    import __spark_entry__ as e

    rows = e.entry(spark).orderBy("it").collect()
    assert len(rows) == 10 and rows[-1].objective < rows[0].objective
    assert set(e.oracle_sql()) <= set(e.queries())


def test_without_the_corpus_operators(tmp_path):
    for name in ("tessella", "__spark_entry__.py"):
        src = ROOT / name
        shutil.copytree(src, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__")) if src.is_dir() else shutil.copy(src, tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') or k == 'pipeline' for k in q); assert set(e.oracle_sql()) <= set(q)"
    run = lambda: subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
    run()
    (tmp_path / "tessella" / "llm" / "__pycache__").mkdir(parents=True)  # what a deleted package may leave
    run()
    (tmp_path / "tessella" / "llm" / "queries.py").write_text("import a_package_that_is_not_there")
    run()


def test_nothing_else_imports_them():
    for f in (ROOT / "tessella").rglob("*.py"):
        if "llm" not in f.parts:
            assert "llm" not in f.read_text()

"""The entry module works with and without the corpus operators."""

import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parents[1]


def test_flagship(spark):
    frame = entry.entry(spark)
    assert frame.columns == ["vx", "vy", "vz", "n", "x", "y", "z"] and frame.count() > 0


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert "voxel_downsample" in entry.queries()


def test_without_the_corpus_operators(tmp_path):
    """What is left when the corpus operators are deleted still imports, and offers the other queries."""
    for p in (ROOT / "cloudframe", ROOT / "__spark_entry__.py"):
        (tmp_path / p.name).symlink_to(p) if p.is_file() else None
    (tmp_path / "cloudframe").mkdir()
    for p in (ROOT / "cloudframe").iterdir():
        if p.name != "llm":
            (tmp_path / "cloudframe" / p.name).symlink_to(p)
    code = "import __spark_entry__ as e; print(sorted(n for n in e.queries() if n.startswith('op') and n[2].isdigit()), len(e.queries()) > 80, 'pipeline' in e.queries())"
    done = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=60, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
    assert done.stdout.strip() == "[] True False", done.stderr

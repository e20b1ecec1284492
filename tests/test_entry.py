"""The entry points, with and without the training-data subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

HOME = Path(__file__).resolve().parent.parent


@pytest.mark.parametrize("also", [[], ["corpus_pipeline.py"]])
def test_entry_without_training_data(tmp_path, also):
    for name in ("__spark_entry__.py", "corpus_pipeline.py", "bench.py"):
        shutil.copy(HOME / name, tmp_path / name)
    shutil.copytree(HOME / "quarry", tmp_path / "quarry", ignore=shutil.ignore_patterns("__pycache__", "llm"))
    for name in also:
        (tmp_path / name).unlink()
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert 'hybrid_search' in q and set(o) <= set(q); assert not [x for x in q if x.startswith('op') or x == 'pipeline']; assert e.entry; import bench"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, check=True, timeout=120)


def test_every_sql_has_a_query():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

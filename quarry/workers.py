"""Makes this package importable in Python workers."""

from __future__ import annotations

import ctypes
import os
import shutil
import tempfile
from pathlib import Path

import pyarrow as pa
from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors, once an application, unless PYTHONPATH already leads workers to it."""
    home = Path(__file__).resolve().parent.parent
    app = spark.sparkContext.applicationId
    if app in _shipped or any(p and Path(p).resolve() == home for p in os.environ.get("PYTHONPATH", "").split(os.pathsep)):
        return
    base = Path(tempfile.mkdtemp(prefix="quarry-ship-"))
    shutil.copytree(home / "quarry", base / "src/quarry", ignore=shutil.ignore_patterns("__pycache__"))
    spark.sparkContext.addPyFile(shutil.make_archive(str(base / "quarry"), "zip", base / "src"))
    _shipped.add(app)


def give_back() -> None:
    """At a task's end: what this worker has freed goes back to the system.  A worker that waits for its next task, beside the
    executor's heap, else keeps the largest arrays' room."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim:
        trim(0)

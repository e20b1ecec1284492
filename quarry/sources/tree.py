"""Source trees: a Python data source that walks them, for Spark's own file sources skip names that begin with '_' or '.'."""

from __future__ import annotations

import os
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quarry.functions.text import SUPPORTED
from quarry.operators.ignore import ignored_name, parse_patterns
from quarry.workers import ship

IGNORE_FILE = ".ragignore"


class _Part(InputPartition):
    def __init__(self, folder: str, deep: bool):
        self.folder, self.deep = folder, deep


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = str(Path(options["path"]).resolve())
        self.repos = options.get("mode", "files") == "repos"
        self.custom = [x for x in options.get("ignore", "").split("\n") if x]
        self.prune = options.get("prune", "true") == "true" and not self.repos

    def partitions(self) -> list[_Part]:
        """The root's own files, and one part for each folder in it; ignored ones aren't entered."""
        if not os.path.isdir(self.root):
            return []
        inner = sorted(e.path for e in os.scandir(self.root) if e.is_dir(follow_symlinks=False))
        return [_Part(self.root, False), *[_Part(p, True) for p in inner if not (self.prune and ignored_name(p, self.custom))]]

    def read(self, part: _Part) -> Iterator[tuple]:
        for here, dirs, files in os.walk(part.folder):
            if self.repos:
                if ".git" in dirs:
                    yield (here, os.path.basename(here), None)
                if not part.deep:
                    return
                dirs[:] = sorted(d for d in dirs if d != ".git")
                continue
            dirs[:] = [] if not part.deep else sorted(d for d in dirs if not (self.prune and ignored_name(f"{here}/{d}", self.custom)))
            for name in sorted(files):
                path = f"{here}/{name}"
                if os.path.splitext(name)[1].lower() in SUPPORTED and not (self.prune and ignored_name(path, self.custom)):
                    try:
                        raw = Path(path).read_bytes()
                    except OSError:
                        continue  # gone or unreadable meanwhile: not part of the scan
                    yield (path, os.path.relpath(path, self.root), raw.decode("utf-8", "ignore"))


class SourceTree(DataSource):
    """format("source_tree"), options path, ignore (patterns by line), mode files or repos: path, name, text."""

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return "path string, name string, text string"

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _Reader(dict(self.options))


def scan_files(spark: SparkSession, root: str, project: str = "default") -> DataFrame:
    """project, path, text of the supported files below root that neither the built-in patterns nor its ignore file exclude; invalid UTF-8 bytes are dropped."""
    ship(spark)
    spark.dataSource.register(SourceTree)
    base = Path(root).resolve()
    if not base.is_dir():
        raise FileNotFoundError(root)
    own = base / IGNORE_FILE
    try:
        custom = parse_patterns(own.read_text("utf-8")) if own.exists() else []
    except (OSError, UnicodeDecodeError) as e:
        print(f"{own} is not used: {e}")
        custom = []
    df = spark.read.format("source_tree").option("ignore", "\n".join(custom)).load(str(base))
    return df.select(F.lit(project).alias("project"), "path", "text")


def read_files(files: DataFrame) -> DataFrame:
    """files (project, path) with op and text, read by tasks: upsert and the text, without bytes that aren't UTF-8, or delete and null where there is no file."""
    ship(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for project, path in zip(*(c.to_pylist() for c in b.columns), strict=True):
                try:
                    text = Path(path).read_bytes().decode("utf-8", "ignore")
                except (FileNotFoundError, IsADirectoryError, NotADirectoryError):
                    text = None
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.string()) for x in (project, path, "delete" if text is None else "upsert", text)], ["project", "path", "op", "text"])

    return files.select("project", "path").mapInArrow(run, "project string, path string, op string, text string")


def discover_repos(spark: SparkSession, roots: list[str]) -> DataFrame:
    """path, name of every folder below roots that holds a .git folder; roots that don't exist are reported and left out."""
    ship(spark)
    spark.dataSource.register(SourceTree)
    out = spark.createDataFrame([], "path string, name string")
    for root in roots:
        if os.path.isdir(root):
            out = out.unionByName(spark.read.format("source_tree").option("mode", "repos").load(root).select("path", "name"))
        else:
            print(f"{root} doesn't exist")
    return out.distinct()


def changed_files(repo: str, commit: str = "HEAD") -> list[str]:
    """Paths that a commit touched, relative to the repository."""
    import subprocess

    out = subprocess.run(["git", "-C", repo, "diff-tree", "--no-commit-id", "--name-only", "-r", "--root", commit], capture_output=True, text=True, check=True)
    return out.stdout.splitlines()


def install_hook(repo: str, project: str, index: str) -> Path:
    """A post-commit hook that indexes what each commit touched, in the background; an existing hook is kept and continued."""
    import shlex
    import sys

    hook = Path(repo, ".git/hooks/post-commit")
    if not hook.parent.parent.is_dir():
        raise FileNotFoundError(f"{repo} is no repository")
    hook.parent.mkdir(exist_ok=True)
    line = f'git diff-tree --no-commit-id --name-only -r --root -z HEAD | (cd {shlex.quote(str(Path(repo).resolve()))} && xargs -0 {shlex.quote(sys.executable)} -m quarry.cli --index {shlex.quote(index)} changed {shlex.quote(project)}) &\n'
    old = hook.read_text() if hook.exists() else "#!/bin/sh\n"
    if line not in old:
        hook.write_text(old + line)
    hook.chmod(0o755)
    return hook

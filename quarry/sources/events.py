"""Changes of a source tree as a stream: a Python data source whose offsets are looks at the tree.

Each micro-batch is one look.  The driver lists the folders in the root only; a task walks each of them, compares what it finds
with what the last look found, and writes down what this one did.  Notes of looks are files in a folder that all executors share: a batch
that is repeated, after a restart too, reads its look's note instead of the tree, so that it gives the same events, and none is
lost or given twice.  Committed looks' notes are deleted but for the last.
"""

from __future__ import annotations

import hashlib
import json
import os
import time
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from quarry.functions.text import SUPPORTED
from quarry.operators.ignore import ignored_name, parse_patterns
from quarry.sources.tree import IGNORE_FILE
from quarry.workers import ship

EVENT = "path string, op string, event_time timestamp, event_id bigint"


class Folder(InputPartition):
    def __init__(self, path: str, deep: bool, start: int, end: int):
        self.path, self.deep, self.start, self.end = path, deep, start, end


def _put(path: Path, value: object) -> None:
    """Whole or not at all; the first of two writers wins."""
    new = path.with_name(f".{uuid.uuid4().hex}")
    new.write_text(json.dumps(value))
    try:
        os.link(new, path)
    except FileExistsError:
        pass
    finally:
        new.unlink()


class Looks(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.root = str(Path(options["path"]).resolve())
        self.notes = Path(options["notes"])
        self.custom = [x for x in options.get("ignore", "").split("\n") if x]

    def initialOffset(self) -> dict:  # noqa: N802
        return {"look": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"look": int(time.time() * 1000)}

    def _note(self, folder: str, look: int) -> Path:
        return self.notes / f"{hashlib.md5(folder.encode()).hexdigest()}.{look}.json"  # noqa: S324

    def partitions(self, start: dict, end: dict) -> list[Folder]:
        """The root's own files, and one part for each folder in it, or that was in it at the last look."""
        self.notes.mkdir(parents=True, exist_ok=True)
        look, last, plan = end["look"], start["look"], self.notes / f"look.{end['look']}.json"
        if not plan.exists():
            before = self.notes / f"look.{last}.json"
            known = json.loads(before.read_text()) if before.exists() else []
            here = sorted(e.path for e in os.scandir(self.root) if e.is_dir(follow_symlinks=False) and not ignored_name(e.path, self.custom)) if os.path.isdir(self.root) else []
            _put(plan, sorted({*known, *here}))
        return [Folder(self.root, False, last, look), *[Folder(p, True, last, look) for p in json.loads(plan.read_text())]]

    def _seen(self, part: Folder) -> dict[str, list[int]]:
        out = {}
        for here, dirs, files in os.walk(part.path):
            dirs[:] = [d for d in dirs if not ignored_name(f"{here}/{d}", self.custom)] if part.deep else []
            for name in files:
                path = f"{here}/{name}"
                if os.path.splitext(name)[1].lower() in SUPPORTED and not ignored_name(path, self.custom):
                    try:
                        s = os.stat(path)
                    except FileNotFoundError:
                        continue  # gone since it was listed
                    out[path] = [s.st_mtime_ns, s.st_size]
        return out

    def read(self, part: Folder) -> Iterator[tuple]:
        before, now = self._note(part.path, part.start), self._note(part.path, part.end)
        old = json.loads(before.read_text()) if before.exists() else {}
        if not now.exists():
            _put(now, self._seen(part))
        new = json.loads(now.read_text())
        at = datetime.fromtimestamp(part.end / 1000, UTC)
        for path in sorted(old.keys() | new.keys()):
            if old.get(path) != new.get(path):
                yield path, "upsert" if path in new else "delete", at, part.end

    def commit(self, end: dict) -> None:
        for note in self.notes.glob("*.json"):
            if int(note.name.split(".")[-2]) < end["look"]:
                note.unlink(missing_ok=True)


class FileEvents(DataSource):
    """format("file_events"), options path, notes (a folder that all executors share), ignore (patterns by line): EVENT."""

    @classmethod
    def name(cls) -> str:
        return "file_events"

    def schema(self) -> str:
        return EVENT

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: ANN001, N802
        return Looks(dict(self.options))


def file_events(spark: SparkSession, root: str, notes: str, project: str = "default") -> DataFrame:
    """project, path, op, event_time, event_id of what changes below root, from a first look that finds all there is; a stream."""
    ship(spark)
    spark.dataSource.register(FileEvents)
    own = Path(root).resolve() / IGNORE_FILE
    custom = parse_patterns(own.read_text("utf-8", "ignore")) if own.exists() else []
    df = spark.readStream.format("file_events").option("ignore", "\n".join(custom)).option("notes", notes.removeprefix("file://")).load(str(Path(root).resolve()))
    return df.select(F.lit(project).alias("project"), *[c.split()[0] for c in EVENT.split(", ")])

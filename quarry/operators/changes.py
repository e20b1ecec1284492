"""Changes of files: what they are, and how they reach the index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import content_hash, is_supported
from quarry.operators import bloom


def parse_changed(lists: DataFrame) -> DataFrame:
    """path for each entry of lists (list): by line where there is a line feed, else by white space; blanks go."""
    parts = F.when(F.col("list").contains("\n"), F.split("list", "\n")).otherwise(F.split("list", r"\s+"))
    return lists.select(F.explode(parts).alias("path")).select(F.trim("path").alias("path")).where("path <> ''")


def coalesce_changes(events: DataFrame) -> DataFrame:
    """Each path's last event (of equal times the larger id) with all its columns but the id. events: project, path, op, event_time, event_id, and others."""
    keys, order = ["project", "path"], ["event_time", "event_id", "op"]
    others = [c for c in events.columns if c not in keys + order]
    last = events.groupBy(*keys).agg(F.max(F.struct(*order, *others)).alias("e"))
    return last.select(*keys, "e.op", "e.event_time", *[F.col(f"e.{c}") for c in others])


def debounce_sessions(events: DataFrame, gap: str = "5 seconds") -> DataFrame:
    """project, session_start, session_end (last event), n_events: bursts of a project's events, with no pause above the gap within."""
    df = events.withColumn("ts", F.col("event_time").cast("timestamp"))
    out = df.groupBy("project", F.session_window("ts", gap).alias("w")).agg(F.min("ts").alias("session_start"), F.max("ts").alias("session_end"), F.count("*").alias("n_events"))
    return out.drop("w")


def detect_changes(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """project, path, change: added, changed, unchanged or removed, by content hash. files: project, path, text; code files only."""
    new = files.where(is_supported(F.col("path"))).select("project", "path", content_hash(F.col("text")).alias("new_hash"))
    old = chunks.groupBy("project", "path").agg(F.min_by("file_hash", "chunk_idx").alias("old_hash"), F.lit(True).alias("there"))
    both = new.withColumn("here", F.lit(True)).join(old, ["project", "path"], "full_outer")
    change = F.when(F.col("here").isNull(), "removed").when(F.col("there").isNull(), "added").when(F.col("new_hash").eqNullSafe(F.col("old_hash")), "unchanged").otherwise("changed")
    return both.select("project", "path", change.alias("change"))


def append_new(chunks: DataFrame, more: DataFrame, known: tuple[DataFrame, int] | None = None) -> DataFrame:
    """chunks and those of more whose (project, chunk_id) is new; the first of more's own repeats, by text, is taken.

    known: a Bloom filter of chunks' ids (bloom.build) and its number of bitmaps; only rows that it can't tell reach the anti-join."""
    keys = ["project", "chunk_id"]
    if known:
        told = bloom.tested(more, keys, *known)
        maybe = told.where("__maybe").drop("__maybe").join(chunks.select(*keys), keys, "left_anti")
        fresh = told.where("not __maybe").drop("__maybe").unionByName(maybe)
    else:
        fresh = more.join(chunks.select(*keys), keys, "left_anti")
    one = fresh.groupBy(*keys).agg(F.min(F.struct("text", F.struct(*more.columns).alias("r"))).alias("m"))
    return chunks.unionByName(one.select(*[F.col(f"m.r.{c}").alias(c) for c in more.columns]), allowMissingColumns=True)


def delete_paths(chunks: DataFrame, gone: DataFrame) -> DataFrame:
    """chunks without those of gone (project, path)."""
    return chunks.join(gone.select("project", "path").distinct(), ["project", "path"], "left_anti")


def force_clear(chunks: DataFrame, project: str) -> DataFrame:
    return chunks.where(F.col("project") != project)


def apply_changes(chunks: DataFrame, changes: DataFrame, rechunk) -> DataFrame:  # noqa: ANN001
    """The next snapshot. changes: project, path, op (upsert or delete), text.

    An upsert of unchanged content leaves the file's chunks alone, one without a text is a deletion; else the file's chunks
    are replaced by rechunk(files), a plan over all changed files at once."""
    code = changes.where(is_supported(F.col("path")))
    known = chunks.groupBy("project", "path").agg(F.min_by("file_hash", "chunk_idx").alias("old_hash"))
    ups = code.where("op = 'upsert' and text is not null").select("project", "path", "text")
    ups = ups.join(known, ["project", "path"], "left").where(F.col("old_hash").isNull() | (F.col("old_hash") != content_hash(F.col("text")))).select("project", "path", "text")
    gone = code.where("op = 'delete' or text is null").select("project", "path").unionByName(ups.select("project", "path"))
    return delete_paths(chunks, gone).unionByName(rechunk(ups), allowMissingColumns=True)

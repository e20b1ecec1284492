"""Projects, files and counts of an index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def list_files(chunks: DataFrame) -> DataFrame:
    return chunks.where("path is not null and path <> ''").select("path").distinct()


def list_projects(chunks: DataFrame) -> DataFrame:
    return chunks.select("project").distinct()


def project_stats(chunks: DataFrame, registry: DataFrame) -> DataFrame:
    """project, n_chunks, n_files, project_path ('N/A' where it isn't registered), last_indexed."""
    counts = chunks.groupBy("project", "path").agg(F.count("*").alias("k")).groupBy("project").agg(F.sum("k").alias("n_chunks"), F.count("path").alias("n_files"))
    return with_registry(counts, registry)


def with_registry(counts: DataFrame, registry: DataFrame) -> DataFrame:
    """counts (project, n_chunks, n_files) with project_path and last_indexed."""
    return counts.join(registry, "project", "left").select("project", "n_chunks", "n_files", F.coalesce("project_path", F.lit("N/A")).alias("project_path"), "last_indexed")


def projects_to_index(found: DataFrame, chunks: DataFrame, force: bool = False) -> DataFrame:
    """found (project, ...) without those that have chunks; all of them if forced."""
    return found if force else found.join(list_projects(chunks), "project", "left_anti")


def dry_run(files: DataFrame) -> DataFrame:
    """The files an index run would read, by path."""
    return files.select("path").orderBy("path")

"""python -m quarry.cli index|auto|changed|watch|hook|search|projects|health ..."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quarry.config import setting
from quarry.engine import PROJECT, Engine
from quarry.operators.catalog import dry_run, projects_to_index
from quarry.sources.tree import discover_repos, install_hook, scan_files


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quarry")
    p.add_argument("--index", default=setting("index"), help="folder of the index"), p.add_argument("--embedder", default=setting("embedder"))
    sub = p.add_subparsers(dest="what", required=True)
    x = sub.add_parser("index")
    x.add_argument("path"), x.add_argument("--name", default=PROJECT), x.add_argument("--force", action="store_true"), x.add_argument("--dry-run", action="store_true")
    x = sub.add_parser("auto")
    x.add_argument("--scan", nargs="+", required=True), x.add_argument("--force", action="store_true"), x.add_argument("--dry-run", action="store_true")
    x = sub.add_parser("changed")
    x.add_argument("name"), x.add_argument("paths", nargs="+")
    x = sub.add_parser("search")
    x.add_argument("query"), x.add_argument("--name", default=PROJECT), x.add_argument("--top-k", type=int, default=5)
    x = sub.add_parser("watch")
    x.add_argument("path"), x.add_argument("--name", default=PROJECT)
    x = sub.add_parser("hook")
    x.add_argument("path"), x.add_argument("--name", default=PROJECT)
    sub.add_parser("projects")
    sub.add_parser("health")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    if a.what == "hook":
        print(install_hook(a.path, a.name, a.index))
        return 0
    spark = spark or SparkSession.builder.getOrCreate()
    spark.sparkContext.setLogLevel(setting("log_level"))
    engine = Engine(spark, a.index, a.embedder)
    if a.what == "index":
        if a.dry_run:
            dry_run(scan_files(spark, a.path, a.name)).show(1000, False)
        else:
            print(engine.index(a.path, a.name, force=a.force))
    elif a.what == "auto":
        todo = projects_to_index(discover_repos(spark, a.scan).withColumnRenamed("name", "project"), engine.store.chunks(), a.force)
        for r in todo.orderBy("project").collect():
            print(r["project"] if a.dry_run else engine.index(r["path"], r["project"], force=a.force))
    elif a.what == "changed":
        engine.reindex_files(a.name, [str(Path(p).resolve()) for p in a.paths])
    elif a.what == "watch":
        engine.watch(a.path, a.name, f"{a.index}/watch-{a.name}").awaitTermination()
    elif a.what == "search":
        print(engine.search(a.query, a.top_k, a.name))
    elif a.what == "projects":
        engine.projects().show(1000, False)
    elif a.what == "health":
        df = engine.health()
        df.show(truncate=False)
        return int(not df.where(~F.col("ok")).isEmpty())
    return 0


if __name__ == "__main__":
    sys.exit(main())

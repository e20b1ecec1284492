"""The index: chunks, blocks of postings, term statistics and a Bloom filter of ids by project, and the registry of projects.

A change writes the projects it touches, and no others, under a new version; then a numbered pointer names each project's
version.  Pointers are made under another name and renamed, never written over and never deleted before a newer one is there:
whoever reads meets the last one that is whole, and of two that write the same number one fails.  No pointer means that nothing was
ever published.  Versions that the last KEEP pointers don't name are deleted.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import bloom, bm25

CHUNK = "path string, chunk_idx int, chunk_id string, text string, type string, name string, line_start int, line_end int, start int, end int, offset_unit string, file_hash string, embedding array<float>, id bigint, project string"
TERM = "term string, df bigint, project string"
REGISTRY = "project string, project_path string, first_indexed timestamp, last_indexed timestamp"
#: Pointers that are kept, and versions that a reader of all projects unites at most before a change writes all of them anew.
KEEP, MOST_VERSIONS = 3, 64


class ConcurrentUpdate(RuntimeError):
    """Another writer has published since this one began."""


class IndexStore:
    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base, self._raws = spark, base.rstrip("/"), {}

    def _fs(self, path: str):  # noqa: ANN202
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _names(self, folder: str) -> list[str]:
        fs, p = self._fs(folder)
        return [x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []

    def _numbers(self, name: str) -> list[int]:
        return sorted(int(m[1]) for x in self._names(self.base) if (m := re.fullmatch(rf"{name}\.(\d+)\.json", x)))

    def _pointer(self, name: str, number: int | None = None) -> dict:
        numbers = [number] if number is not None else self._numbers(name)
        if not numbers:
            return {"number": 0, "parts": {}, "batches": {}}
        fs, p = self._fs(f"{self.base}/{name}.{numbers[-1]}.json")
        stream = fs.open(p)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _point(self, name: str, value: dict) -> None:
        fs, p = self._fs(f"{self.base}/{name}.{uuid.uuid4().hex}.new")
        out = fs.create(p, True)
        out.write(bytearray(json.dumps(value).encode()))
        out.close()
        _, q = self._fs(f"{self.base}/{name}.{value['number']}.json")
        if fs.exists(q) or not fs.rename(p, q):
            fs.delete(p, False)
            raise ConcurrentUpdate(f"{q} is there already")

    def _swept(self, name: str, folders: list[str]) -> None:
        """Old pointers and the versions that none names any more are deleted."""
        numbers = self._numbers(name)
        named = {part["version"] for n in numbers[-KEEP:] for part in self._pointer(name, n)["parts"].values()}
        for n in numbers[:-KEEP]:
            old = {part["version"] for part in self._pointer(name, n)["parts"].values()}
            for version in old - named:
                for folder in folders:
                    fs, p = self._fs(f"{self.base}/{folder}/{version}")
                    fs.delete(p, True)
            fs, p = self._fs(f"{self.base}/{name}.{n}.json")
            fs.delete(p, False)

    def _table(self, folder: str, schema: str, projects: list[str] | None) -> DataFrame:
        parts = self._pointer("chunks")["parts"]
        by: dict[str, list[str]] = {}
        for project, part in parts.items():
            if projects is None or project in projects:
                by.setdefault(part["version"], []).append(project)
        out = None
        for version, own in sorted(by.items()):
            df = self.spark.read.schema(schema).parquet(f"{self.base}/{folder}/{version}").where(F.col("project").isin(own))
            out = df if out is None else out.unionByName(df)
        return self.spark.createDataFrame([], schema) if out is None else out

    def chunks(self, project: str | None = None) -> DataFrame:
        """All chunks, or a project's; none where there is no such project."""
        return self.chunks_of(None if project is None else [project])

    def chunks_of(self, projects: list[str] | None) -> DataFrame:
        return self._table("chunks", CHUNK, projects)

    def replace(self, df: DataFrame, projects: list[str], batch: list | None = None) -> None:
        """df is all that these projects have from now on; others stay as they are.  batch: (source, number), remembered as applied."""
        old = self._pointer("chunks")
        if len({p["version"] for p in old["parts"].values()}) >= MOST_VERSIONS:
            others = [p for p in old["parts"] if p not in projects]
            columns = [c.split()[0] for c in CHUNK.split(", ")]
            df, projects = df.select(*[c for c in columns if c in df.columns]).unionByName(self.chunks_of(others), allowMissingColumns=True), projects + others
        version, columns = uuid.uuid4().hex, [c.split()[0] for c in CHUNK.split(", ")]
        if "embedding" not in df.columns:
            df = df.withColumn("embedding", F.lit(None).cast("array<float>"))
        own = F.xxhash64("project", "chunk_id")
        df = df.withColumn("id", F.coalesce("id", own) if "id" in df.columns else own)
        df.where(F.col("project").isin(projects)).select(*columns).write.partitionBy("project").parquet(f"{self.base}/chunks/{version}")
        stats = self._write_postings(version)
        parts = {k: v for k, v in old["parts"].items() if k not in projects} | stats
        batches = old["batches"] | ({batch[0]: batch[1]} if batch else {})
        self._point("chunks", {"number": old["number"] + 1, "parts": parts, "batches": batches})
        self._swept("chunks", ["chunks", "postings", "terms", "bloom"])

    def _write_postings(self, version: str) -> dict:
        """Postings in blocks and document frequencies of a version, sorted by term, so that a search skips what hasn't its terms; statistics by project."""
        chunks = self.spark.read.schema(CHUNK).parquet(f"{self.base}/chunks/{version}")
        own = chunks.where("text <> ''").select("project", "id", bm25.tokenize(F.col("text")).alias("tokens"))
        lengths = {r["project"]: r["length"] for r in own.groupBy("project").agg(F.sum(F.size("tokens")).alias("length")).collect()}
        bm25.blocks(own, sum(lengths.values())).repartitionByRange("project", "term", "bucket").sortWithinPartitions("project", "term", "bucket").write.partitionBy("project").parquet(f"{self.base}/postings/{version}")
        posted = self.spark.read.schema(bm25.BLOCK).parquet(f"{self.base}/postings/{version}")
        posted.groupBy("project", "term").agg(F.sum("n").alias("df")).repartitionByRange("project", "term").sortWithinPartitions("project", "term").write.partitionBy("project").parquet(f"{self.base}/terms/{version}")
        counted = chunks.groupBy("project").agg(F.count("*").alias("chunks"), F.count_if((F.col("chunk_idx") == 0) & (F.col("path") != "")).alias("files"), F.count_if(F.col("text") != "").alias("n"))
        sizes = {r["project"]: r for r in counted.collect()}
        bitmaps = bloom.bitmaps(sum(r["chunks"] for r in sizes.values()))
        bloom.build(chunks, ["project", "chunk_id"], bitmaps).write.parquet(f"{self.base}/bloom/{version}")
        count = self.spark.createDataFrame([(p, r["n"]) for p, r in sizes.items()], "project string, n bigint")
        terms = self.spark.read.schema(TERM).parquet(f"{self.base}/terms/{version}").join(F.broadcast(count), "project")
        raws = {r["project"]: r["raw"] for r in terms.groupBy("project").agg(F.avg(bm25.raw_idf(F.col("n"), F.col("df"))).alias("raw")).collect()}
        return {p: {"version": version, "n": r["n"], "length": lengths.get(p, 0), "raw": raws.get(p), "chunks": r["chunks"], "files": r["files"], "bitmaps": bitmaps} for p, r in sizes.items()}

    def known(self, project: str) -> tuple[DataFrame, int] | None:
        """A Bloom filter of ids that has all of a project's, and its number of bitmaps; None without the project."""
        part = self._pointer("chunks")["parts"].get(project)
        return (self.spark.read.schema("bitmap int, bits binary").parquet(f"{self.base}/bloom/{part['version']}"), part["bitmaps"]) if part else None

    def stats(self, project: str | None = None) -> dict[str, int]:
        """chunks and files of a project or of all, as they were counted when they were written."""
        parts = self._pointer("chunks")["parts"]
        own = [v for k, v in parts.items() if project is None or k == project]
        return {c: sum(v[c] for v in own) for c in ("chunks", "files")}

    def counts(self) -> DataFrame:
        """project, n_chunks, n_files, from the same."""
        return self.spark.createDataFrame([(k, v["chunks"], v["files"]) for k, v in self._pointer("chunks")["parts"].items()], "project string, n_chunks bigint, n_files bigint")

    def sparse(self, texts: DataFrame, k: int, project: str | None = None, least: int = bm25.SKIPS) -> DataFrame:
        """query_id, id, score, sparse_rank of texts (query_id, text) by BM25, from the stored blocks; from `least` chunks on from those that can matter."""
        return self.stored(texts, project).top(k, least=least)

    def stored(self, texts: DataFrame, project: str | None = None) -> bm25.Stored:
        parts = self._pointer("chunks")["parts"]
        own = [p for p in parts if project is None or p == project]
        n, length = sum(parts[p]["n"] for p in own), sum(parts[p]["length"] for p in own)
        terms = self._table("terms", TERM, own)
        raw = parts[own[0]]["raw"] if len(own) == 1 else self._raw(sorted({parts[p]["version"] for p in own}), tuple(sorted(own)), n, terms)
        return bm25.Stored(self._table("postings", bm25.BLOCK, own), terms, n, length, raw, texts)

    def _raw(self, versions: list[str], projects: tuple[str, ...], n: int, terms: DataFrame) -> float:
        """The mean of all raw idf values of some projects; remembered, for as long as their versions are the same."""
        key = (*versions, *projects)
        if key not in self._raws:
            self._raws = {key: terms.groupBy("term").agg(F.sum("df").alias("df")).agg(F.avg(bm25.raw_idf(F.lit(n), F.col("df")))).first()[0] or 0.0}
        return self._raws[key]

    def applied(self, batch: list) -> bool:
        """Whether a source's batch, whose numbers ascend, has been applied."""
        return self._pointer("chunks")["batches"].get(batch[0], -1) >= batch[1]

    def registry(self) -> DataFrame:
        parts = self._pointer("registry")["parts"]
        return self.spark.read.schema(REGISTRY).parquet(f"{self.base}/registry/{parts['all']['version']}") if parts else self.spark.createDataFrame([], REGISTRY)

    def register(self, project: str, path: str, now: str) -> None:
        new = self.spark.createDataFrame([(project, path)], "project string, project_path string").withColumn("now", F.lit(now).cast("timestamp"))
        old, version = self._pointer("registry"), uuid.uuid4().hex
        registry_upsert(self.registry(), new).write.parquet(f"{self.base}/registry/{version}")
        self._point("registry", {"number": old["number"] + 1, "parts": {"all": {"version": version}}, "batches": {}})
        self._swept("registry", ["registry"])


def registry_upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """old (REGISTRY) with the projects of new (project, project_path, now): first_indexed is kept, path and last_indexed are new."""
    o = old.select("project", F.col("project_path").alias("p"), F.col("first_indexed").alias("f"), F.col("last_indexed").alias("l"))
    both = o.join(new, "project", "full_outer")
    return both.select("project", F.coalesce("project_path", "p").alias("project_path"), F.coalesce("f", "now").alias("first_indexed"), F.coalesce("now", "l").alias("last_indexed"))

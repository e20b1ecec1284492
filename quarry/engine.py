"""The engine: indexing, searching and looking at projects, composed of the operators."""

from __future__ import annotations

import time
import uuid
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quarry import embed as embedding
from quarry.functions.text import suffix
from quarry.operators import catalog, changes, fusion
from quarry.operators.chunking import chunks as chunked
from quarry.sources.store import IndexStore
from quarry.sources.tree import read_files, scan_files

TOP_K, PROJECT = 5, "default"


class Engine:
    def __init__(self, spark: SparkSession, base: str, embedder: str = "hashing"):
        self.spark, self.store, self.embedder = spark, IndexStore(spark, base), embedder

    def _chunked(self, files: DataFrame) -> DataFrame:
        return embedding.embed(chunked(files), self.embedder)

    def index(self, root: str, project: str = PROJECT, mode: str = "sync", force: bool = False) -> dict:
        """Indexes a source tree. sync: changed files are replaced and vanished ones removed; append: only new chunk ids are added."""
        began, mine = time.time(), self.store.chunks(project)
        files = scan_files(self.spark, root, project)
        if force:
            mine = mine.limit(0)
        n_before = 0 if force else self.store.stats(project)["files"]
        if mode == "append":
            after = changes.append_new(mine, self._chunked(files), None if force else self.store.known(project))
        else:
            seen = changes.detect_changes(files, mine)
            touched = seen.where("change <> 'unchanged'").select("project", "path")
            fresh = files.join(touched, ["project", "path"], "left_semi")
            after = changes.delete_paths(mine, touched).unionByName(self._chunked(fresh), allowMissingColumns=True)
        self.store.replace(after, [project])
        self.store.register(project, root, datetime.now(UTC).isoformat())
        now = self.store.stats(project)
        return {"project": project, "files_before": n_before, "files_after": now["files"], "chunks": now["chunks"], "seconds": round(time.time() - began, 1)}

    def search(self, query: str, top_k: int = TOP_K, project: str | None = PROJECT, file_types: list[str] | None = None) -> dict:
        """The best chunks for a query; file_types (suffixes, case kept) filter after the cut."""
        began = time.time()
        texts = self.spark.createDataFrame([(0, query)], "query_id bigint, text string")
        hits = self.search_batch(texts, top_k, project)
        if file_types:
            hits = hits.where(suffix(F.col("path")).isin(*file_types))
        rows = [r.asDict() for r in hits.orderBy("rank").drop("query_id", "id", "embedding").collect()]
        return {"results": rows, "total_indexed_chunks": self.store.stats(project)["chunks"], "query_time_ms": round(1000 * (time.time() - began), 2), "search_type": rows[0]["search_type"] if rows else "dense_only"}

    def search_batch(self, texts: DataFrame, top_k: int = TOP_K, project: str | None = PROJECT) -> DataFrame:
        """Hits of texts (query_id, text)."""
        chunks = self.store.chunks(project)
        queries = embedding.embed(texts, self.embedder).select("query_id", "embedding")
        sparse = self.store.sparse(texts, fusion.OVERFETCH * top_k, project)
        return fusion.hybrid_search(chunks.drop("embedding"), chunks.select("id", "embedding"), texts, queries, top_k, sparse=sparse)

    def projects(self) -> DataFrame:
        """project, n_chunks, n_files, project_path, last_indexed; the counts are those kept beside the index."""
        return catalog.with_registry(self.store.counts(), self.store.registry())

    def files(self, project: str) -> DataFrame:
        if not project:
            raise ValueError("a project is needed")
        return catalog.list_files(self.store.chunks(project))

    def file_content(self, path: str, project: str | None = None) -> str:
        """Text of a file that is indexed, as it is on disk."""
        if self.store.chunks(project).where(F.col("path") == path).isEmpty():
            raise FileNotFoundError(f"{path} isn't indexed")
        text = read_files(self.spark.createDataFrame([(project or "", path)], "project string, path string")).first()["text"]
        if text is None:
            raise FileNotFoundError(f"{path} is gone")
        return text

    def reindex_files(self, project: str, paths: list[str]) -> None:
        """Files that exist are replaced if they changed; those that don't are removed."""
        self.reindex(self.spark.createDataFrame([(project, p) for p in paths], "project string, path string"), [project])

    def reindex(self, files: DataFrame, projects: list[str], batch: list | None = None) -> None:
        """The same for files (project, path) of some projects; tasks read them.  batch: as replace() takes it."""
        now = read_files(files).persist()
        try:
            self.store.replace(changes.apply_changes(self.store.chunks_of(projects), now, self._chunked), projects, batch)
        finally:
            now.unpersist()

    def watch(self, root: str, project: str, checkpoint: str, gap_ms: int = 5000, every: str = "1 second") -> StreamingQuery:
        """Applies what changes below root, once it has been quiet for the gap.  checkpoint: of the stream, and of what its looks found; each burst is applied once."""
        from quarry.sources.events import file_events
        from quarry.streaming.debounce import debounced

        def apply(df: DataFrame, number: int) -> None:
            if self.store.applied([checkpoint, number]):
                return
            files = df.select("project", F.explode(F.concat("upserts", "deletes")).alias("path")).distinct()
            if not files.isEmpty():
                self.reindex(files, [project], [checkpoint, number])

        stream = debounced(file_events(self.spark, root, f"{checkpoint}/notes", project), gap_ms, None)
        return stream.writeStream.option("checkpointLocation", f"{checkpoint}/stream").foreachBatch(apply).trigger(processingTime=every).start()

    def health(self) -> DataFrame:
        """check, ok, detail."""
        rows = []

        def check(name: str, f) -> None:  # noqa: ANN001
            try:
                rows.append((name, True, str(f())))
            except Exception as e:  # a check reports what is wrong
                rows.append((name, False, f"{type(e).__name__}: {e}"))

        check("embedding", lambda: embedding.backend(self.embedder).encode(["x"]).shape)
        check("store", lambda: self.store.stats()["chunks"])
        check("search", lambda: len(self.search("health", 1, None)["results"]))
        check("writable", lambda: self.store._point(f"probe-{uuid.uuid4().hex}", {"number": 1}))
        return self.spark.createDataFrame(rows, "check string, ok boolean, detail string")

"""The engine's queries over the driver's tables, and SQL for each that SQL can express.

Documents stand for files: path /source/doc_id.lang, project source.  Embeddings are the vectors of documents of the same
number, benchmark items the query texts, events a log of file changes.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry import embed
from quarry.functions import text as tx
from quarry.functions import vectors as vec
from quarry.operators import bm25, catalog, changes, chunking, dense, fusion
from quarry.operators.ignore import ignored, parse_patterns

QUERY = "the of and the was pathetic"
NOW = "2024-01-02 03:04:05"
IGNORE_TEXT = "# own patterns\n\nsrc1\n*.fr\n/src2/*\n*src3/1*\n"
PATHS = ["src/main.py", "a/node_modules/x.js", "b.tar.PY", ".gitignore", "x.", "noext", "a.b/c", "__pycache__/m.pyc", "lib/a.pyc", "web/App.TSX", "venv/lib/a.py", "x.egg-info/a.py", "pkg/x.egg-info", "conf/app.yml", "k.hpp", "docs/README.md"]
SNIPPETS = ["def foo(a, b):\n  pass", "class Bar(Base):\n  pass", "  async def go():", "export function run(x) {", "x = 1", "", "class A: def b(self): pass"]
CHANGED = ["a.py\nb c.py\n\n  d.js ", "x.py  y.py\tz.go", "   "]


def tbl(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def files(spark: SparkSession, d: str) -> DataFrame:
    docs = tbl(spark, d, "documents")
    path = F.concat(F.lit("/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), "lang")
    return docs.select("doc_id", F.col("source").alias("project"), path.alias("path"), "text")


def corpus(spark: SparkSession, d: str) -> DataFrame:
    return tbl(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return tbl(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


def one_text(spark: SparkSession, query: str = QUERY) -> DataFrame:
    return spark.createDataFrame([(0, query)], "query_id bigint, text string")


def batch_texts(spark: SparkSession, d: str) -> DataFrame:
    return tbl(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def batch_vectors(spark: SparkSession, d: str) -> DataFrame:
    """The vector of each benchmark item."""
    items = tbl(spark, d, "benchmark").select(F.col("item_id").alias("query_id"))
    return vectors(spark, d).withColumnRenamed("id", "query_id").join(items, "query_id", "left_semi").select("query_id", "embedding")


def code_chunks(spark: SparkSession, d: str, size: int = 10, overlap: int = 2) -> DataFrame:
    return chunking.line_windows(files(spark, d), size, overlap)


def code_events(spark: SparkSession, d: str) -> DataFrame:
    e = tbl(spark, d, "events")
    return e.select((F.col("user_id") % 5).cast("string").alias("project"), F.col("user_id").cast("string").alias("path"), F.when(F.col("event_type") == "error", "delete").otherwise("upsert").alias("op"), F.col("ts").alias("event_time"), "event_id")


def next_files(spark: SparkSession, d: str) -> DataFrame:
    """The next version: of ids divisible by 10 the text grows, those of remainder 1 are gone."""
    return files(spark, d).where(F.col("doc_id") % 10 != 1).withColumn("text", F.when(F.col("doc_id") % 10 == 0, F.concat("text", F.lit(" more"))).otherwise(F.col("text"))).withColumn("path", F.concat(F.col("path"), F.lit(".py")))


def old_chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunking.line_windows(files(spark, d).withColumn("path", F.concat(F.col("path"), F.lit(".py"))), 10, 2)


def _hits(df: DataFrame, *more: str) -> DataFrame:
    return df.select(*more, F.round("score", 6).alias("score"))


# --- text, chunks, paths -------------------------------------------------------------------------------------------


def tokenize(s, d):
    return corpus(s, d).select("id", F.array_join(tx.tokenize(F.col("text")), " ").alias("tokens"))


def split_lines(s, d):
    return corpus(s, d).select("id", F.size(tx.split_lines(F.col("text"))).alias("n_lines"), F.sha2(F.array_join(tx.split_lines(F.col("text")), "|"), 256).alias("lines"))


def chunk_lines(s, d):
    return code_chunks(s, d, 10, 0).drop("text", "file_hash").withColumnsRenamed({"start": "start_line", "end": "end_line"})


def chunk_lines_overlap(s, d):
    return code_chunks(s, d).select("chunk_id", "text", "line_start", "line_end")


def chunk_lines_default(s, d):
    return chunking.line_windows(files(s, d)).select("chunk_id", "text", "line_start", "line_end")


def chunk_dispatch(s, d):
    return chunking.chunker(files(s, d).withColumn("path", F.concat("path", F.when(F.col("doc_id") % 3 == 0, ".py").when(F.col("doc_id") % 3 == 1, ".txt").otherwise(".hpp"))))


def lang_map(s, d):
    return s.createDataFrame([(p,) for p in PATHS], "path string").select("path", tx.suffix(F.col("path")).alias("suffix"), tx.language(F.col("path")).alias("language"))


def symbol_name(s, d):
    return s.createDataFrame(list(enumerate(SNIPPETS)), "id int, text string").select("id", tx.symbol_name(F.col("text")).alias("name"))


def filter_supported(s, d):
    own = s.createDataFrame([(p,) for p in PATHS], "path string").unionByName(tbl(s, d, "pages").select(F.col("url").alias("path"))).unionByName(files(s, d).select("path"))
    return own.where(tx.is_supported(F.col("path")))


def filter_ignored(s, d):
    return s.createDataFrame([(p,) for p in PATHS], "path string").unionByName(tbl(s, d, "pages").select(F.col("url").alias("path"))).where(~ignored(F.col("path")))


def scan_ragignore(s, d):
    return files(s, d).where(~ignored(F.col("path"), parse_patterns(IGNORE_TEXT))).select("path")


def content_hash(s, d):
    return corpus(s, d).select("id", tx.content_hash(F.col("text")).alias("file_hash"))


def chunk_symbols(s, d):
    src = "import os\n\n@deco\ndef f(x):\n    return x\n\n\nclass A:\n    async def g(self):\n        def h(): pass\n"
    rows = [("p", "a.py", src), ("p", "b.py", "def broken(:"), ("p", "c.js", "function a() {}"), ("p", "d.py", "x = 1")]
    return chunking.chunks(s.createDataFrame(rows, "project string, path string, text string"))


# --- BM25 ----------------------------------------------------------------------------------------------------------


def bm25_tf(s, d):
    return bm25.postings(bm25.tokens(corpus(s, d)))


def bm25_df(s, d):
    return bm25.document_frequencies(bm25.tokens(corpus(s, d)))


def bm25_corpus_stats(s, d):
    return bm25.corpus_stats(bm25.tokens(corpus(s, d))).select("n", F.round("avgdl", 6).alias("avgdl"))


def bm25_idf(s, d):
    toks = bm25.tokens(corpus(s, d))
    return bm25.idf(bm25.document_frequencies(toks), bm25.corpus_stats(toks)).select("term", "df", F.round("idf", 6).alias("idf"))


def bm25_score(s, d):
    return _hits(bm25.scores(bm25.tokens(corpus(s, d)), one_text(s)), "id")


def bm25_topk(s, d):
    return _hits(bm25.top(bm25.scores(bm25.tokens(corpus(s, d)), one_text(s)), 10), "id", "sparse_rank")


def bm25_empty(s, d):
    return _hits(bm25.top(bm25.scores(bm25.tokens(corpus(s, d)), one_text(s, "zzzzqq -- ?")), 10), "id", "sparse_rank")


# --- vectors, fusion, search ---------------------------------------------------------------------------------------


def dense_topk(s, d):
    query = vectors(s, d).where("id = 0").first()["embedding"]
    return _hits(dense.top_one(vectors(s, d), list(query), 10), "id", "dense_rank")


def dense_rank(s, d):
    return _hits(dense.top(vectors(s, d), batch_vectors(s, d), 20), "query_id", "id", "dense_rank")


def dense_topk_batch(s, d):
    return _hits(dense.top(vectors(s, d), batch_vectors(s, d), 10), "query_id", "id", "dense_rank")


def vec_normalize(s, d):
    return vectors(s, d).select("id", F.round(F.aggregate(vec.normalized(F.transform("embedding", lambda x: (x * 3).cast("float"))), F.lit(0.0), lambda a, x: a + x), 6).alias("total"), F.round(vec.norm(vec.normalized(F.col("embedding"))), 6).alias("norm"))


def vec_mean_pool(s, d):
    each = tbl(s, d, "embeddings").select("label", F.posexplode("embedding").alias("dim", "x"))
    return each.groupBy("label", "dim").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("mean"))


_built: dict[tuple[str, str], object] = {}


def search_index(s, d):
    """The index that searches read: documents as chunks of their projects, numbered by their ids, with postings.  Built once for each application and folder."""
    from quarry.sources.store import CHUNK, IndexStore

    key = (s.sparkContext.applicationId, d)
    if key not in _built:
        own = files(s, d).withColumns({"project": F.coalesce("project", F.lit("none")), "chunk_id": F.col("doc_id").cast("string"), "chunk_idx": F.lit(0), "id": F.col("doc_id")})
        none = [F.lit(None).cast(kind).alias(name) for name, kind in (x.split() for x in CHUNK.split(", ")) if name not in own.columns]
        store = IndexStore(s, _base(s, "search-index"))
        store.replace(own.select("project", "path", "text", "chunk_id", "chunk_idx", "id", *none), [r["project"] for r in own.select("project").distinct().collect()])
        _built[key] = store
    return _built[key]


def vector_index(s, d):
    """The inverted-file index of all vectors.  Built once for each application and folder."""
    from quarry.operators.ivf import VectorIndex

    key = (s.sparkContext.applicationId, d + "/vectors")
    if key not in _built:
        index = VectorIndex(s, _base(s, "vector-index"))
        index.build(vectors(s, d))
        _built[key] = index
    return _built[key]


def _lists(s, d):
    dn = dense.top(vectors(s, d), batch_vectors(s, d), 10)
    sp = search_index(s, d).sparse(batch_texts(s, d), 10)
    return dn, sp


def rrf_fuse(s, d):
    return fusion.fuse(*_lists(s, d)).select("query_id", "id", F.round("score", 9).alias("score"), "rank")


def rrf_k30(s, d):
    return fusion.fuse(*_lists(s, d), k=30).select("query_id", "id", F.round("score", 9).alias("score"), "rank")


def rrf_k90(s, d):
    return fusion.fuse(*_lists(s, d), k=90).select("query_id", "id", F.round("score", 9).alias("score"), "rank")


def rrf_missing(s, d):
    return fusion.looked_up(fusion.fuse(*_lists(s, d)), corpus(s, d).where("id % 2 = 0").select("id")).select("query_id", "id", "rank")


def _hybrid(s, d, texts, queries, top_k):
    """Hits of both sides: postings that are stored, and all vectors."""
    index = search_index(s, d)
    chunks = index.chunks().select("id", "path", "text")
    return fusion.hybrid_search(chunks, vectors(s, d), texts, queries, top_k, sparse=index.sparse(texts, fusion.OVERFETCH * top_k))


def sql_fuse(s, d):
    """The same by the table function."""
    from quarry.functions import sql

    sql.register(s)
    dn, sp = _lists(s, d)
    side = lambda df, word: df.select("query_id", "id", F.lit(word).alias("side"), F.col(f"{word}_rank").alias("rank"))
    side(dn, "dense").unionByName(side(sp, "sparse")).createOrReplaceTempView("quarry_hits")
    return s.sql("SELECT query_id, id, round(score, 9) AS score, rank FROM quarry_fuse(TABLE(quarry_hits) PARTITION BY query_id ORDER BY rank)")


def hybrid_search(s, d):
    q = vectors(s, d).where("id = 0").select(F.lit(0).cast("long").alias("query_id"), "embedding")
    return _hybrid(s, d, one_text(s), q, 5).select("id", "rank", F.round("score", 9).alias("score"), "search_type", F.sha2("text", 256).alias("text_hash"))


def hybrid_search_batch(s, d):
    return _hybrid(s, d, batch_texts(s, d), batch_vectors(s, d), 10).select("query_id", "id", "rank", F.round("score", 9).alias("score"), "search_type")


def dense_only_search(s, d):
    q = vectors(s, d).where("id = 0").select(F.lit(0).cast("long").alias("query_id"), "embedding")
    return _hybrid(s, d, one_text(s, "zzzzqq"), q, 5).select("id", "rank", F.round("score", 6).alias("score"), "search_type")


def search_file_types(s, d):
    q = vectors(s, d).where("id = 0").select(F.lit(0).cast("long").alias("query_id"), "embedding")
    return _hybrid(s, d, one_text(s), q, 10).where(tx.suffix(F.col("path")).isin(".en")).select("id", "path", "rank")


# --- catalog -------------------------------------------------------------------------------------------------------


def scan_chunks(s, d):
    return code_chunks(s, d).where("project = 'src1'").select("chunk_id", "file_hash")


def chunks_by_path(s, d):
    return code_chunks(s, d).where("path = '/src0/3.en' or path = '/src1/5.en' or path like '/src2/1%'").select("path", "chunk_id")


def list_files(s, d):
    return catalog.list_files(code_chunks(s, d))


def list_projects(s, d):
    return catalog.list_projects(code_chunks(s, d))


def _registry(s):
    rows = [("src0", "/old/src0", "2020-01-01 00:00:00"), ("src1", "/old/src1", "2021-01-01 00:00:00"), ("gone", "/gone", "2022-01-01 00:00:00")]
    return s.createDataFrame(rows, "project string, project_path string, t string").select("project", "project_path", F.col("t").cast("timestamp").alias("first_indexed"), F.col("t").cast("timestamp").alias("last_indexed"))


def project_stats(s, d):
    return catalog.project_stats(code_chunks(s, d), _registry(s)).select("project", "n_chunks", "n_files", "project_path")


def total_chunks(s, d):
    return code_chunks(s, d).agg(F.count("*").alias("total_chunks"))


def dry_run(s, d):
    return catalog.dry_run(files(s, d).where("project in ('src1', 'src2')"))


def registry_upsert(s, d):
    from quarry.sources.store import registry_upsert as upsert

    new = s.createDataFrame([("src1", "/new/src1"), ("src9", "/new/src9")], "project string, project_path string").withColumn("now", F.lit(NOW).cast("timestamp"))
    out = upsert(_registry(s), new)
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return out.select("project", "project_path", text("first_indexed"), text("last_indexed"))


def registry_lookup(s, d):
    return list_projects(s, d).join(_registry(s), "project", "left").select("project", "project_path")


def file_content(s, d):
    return files(s, d).where("path like '/src0/%'").select("path", "text")


# --- changes -------------------------------------------------------------------------------------------------------


def detect_changes(s, d):
    return changes.detect_changes(next_files(s, d), old_chunks(s, d))


def detect_by_digest(s, d):
    """Files that differ, by digests of folders, a level at a time."""
    from quarry.operators import digests

    own = lambda df: df.select("project", "path", tx.content_hash(F.col("text")).alias("digest"))
    old = own(files(s, d).withColumn("path", F.concat(F.col("path"), F.lit(".py"))))
    found, _ = digests.compared(digests.nodes(own(next_files(s, d)), 2), digests.nodes(old, 2), 2)
    return found.select("project", F.concat(F.lit("/"), "path").alias("path"), "change")


def append_new_chunks(s, d):
    old, new = old_chunks(s, d), chunking.line_windows(next_files(s, d), 8, 0)
    return changes.append_new(old, new).select("project", "chunk_id", "line_start", "line_end")


def append_bloom(s, d):
    """The same; a Bloom filter tells most rows."""
    from quarry.operators import bloom

    base = _base(s, "append")  # both are read several times, and cut once
    old, new = _written(old_chunks(s, d), f"{base}/old"), _written(chunking.line_windows(next_files(s, d), 8, 0), f"{base}/new")
    bitmaps = bloom.bitmaps(old.count())
    known = bloom.build(old, ["project", "chunk_id"], bitmaps), bitmaps
    return changes.append_new(old, new, known).select("project", "chunk_id", "line_start", "line_end")


def delete_paths(s, d):
    gone = files(s, d).where("doc_id % 7 = 0").select("project", "path")
    return changes.delete_paths(code_chunks(s, d), gone).select("chunk_id")


def force_clear(s, d):
    return changes.force_clear(code_chunks(s, d), "src0").select("chunk_id")


def projects_to_index(s, d):
    found = tbl(s, d, "documents").select(F.concat(F.lit("src"), (F.col("doc_id") % 30).cast("string")).alias("project")).distinct()
    return catalog.projects_to_index(found, code_chunks(s, d))


def parse_changed(s, d):
    return changes.parse_changed(s.createDataFrame([(x,) for x in CHANGED], "list string"))


def coalesce_changes(s, d):
    return changes.coalesce_changes(code_events(s, d)).select("project", "path", "op", F.date_format("event_time", "yyyy-MM-dd HH:mm:ss").alias("event_time"))


def debounce_sessions(s, d):
    out = changes.debounce_sessions(code_events(s, d))
    return out.select("project", F.date_format("session_start", "yyyy-MM-dd HH:mm:ss").alias("session_start"), F.date_format("session_end", "yyyy-MM-dd HH:mm:ss").alias("session_end"), "n_events")


def stream_debounce(s, d):
    """The log as a stream; bursts wait in state for the watermark."""
    from quarry.streaming.debounce import debounced

    base = _base(s, "bursts")
    log = code_events(s, d).withColumn("event_time", F.col("event_time").cast("timestamp"))
    log.write.parquet(f"{base}/log")
    last = log.agg(F.max("event_time").alias("t"))  # time goes on after the log
    last.select(F.lit("~").alias("project"), F.lit("~").alias("path"), F.lit("upsert").alias("op"), (F.col("t") + F.expr("interval 3000 days")).alias("event_time"), F.lit(0).cast("bigint").alias("event_id")).write.mode("append").parquet(f"{base}/log")
    stream = debounced(s.readStream.schema(log.schema).parquet(f"{base}/log"), 5000, "1000 days")
    stream.writeStream.format("parquet").option("checkpointLocation", f"{base}/checkpoint").option("path", f"{base}/out").trigger(availableNow=True).start().awaitTermination()
    out = s.read.schema(stream.schema).parquet(f"{base}/out")
    return out.select("project", F.date_format("session_start", "yyyy-MM-dd HH:mm:ss").alias("session_start"), F.date_format("session_end", "yyyy-MM-dd HH:mm:ss").alias("session_end"), "n_events")


def apply_changes(s, d):
    new = next_files(s, d).select("project", "path", F.lit("upsert").alias("op"), "text")
    gone = files(s, d).where("doc_id % 10 = 1").select("project", F.concat("path", F.lit(".py")).alias("path"), F.lit("delete").alias("op"), F.lit(None).cast("string").alias("text"))
    return changes.apply_changes(old_chunks(s, d), new.unionByName(gone), lambda df: chunking.line_windows(df, 10, 2)).select("project", "chunk_id", "file_hash", "line_start", "line_end")


# --- file system, Python and model: no SQL ---------------------------------------------------------------------------


def _sample_tree() -> str:
    root = tempfile.mkdtemp(prefix="quarry-tree-")
    atexit.register(shutil.rmtree, root, True)
    for name, text in {"pkg/__init__.py": "", "pkg/a.py": "def a():\n    return 1\n", "web/App.tsx": "function b() {}\n", "README.md": "x", "build/x.py": "y = 1\n", "own/skip.js": "z", ".ragignore": "# mine\nown\n", ".git/config": ""}.items():
        p = Path(root, name)
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    return root


def scan_files(s, d):
    from quarry.sources.tree import scan_files as scan

    return scan(s, _sample_tree()).select(tx.basename(F.col("path")).alias("name"), F.length("text").alias("n"))


def discover_repos(s, d):
    from quarry.sources.tree import discover_repos as discover

    return discover(s, [_sample_tree()]).select(F.col("path").endswith(F.col("name")).alias("named"), F.col("name").startswith("quarry-tree-").alias("sample"))


def embed_text(s, d):
    first = [F.round(F.get("embedding", F.lit(i)).cast("double"), 4).alias(f"x{i}") for i in range(4)]
    return embed.embed(corpus(s, d)).select("id", F.size("embedding").alias("dim"), F.round(vec.norm(F.col("embedding")), 4).alias("norm"), *first)


def _base(s, name: str) -> str:
    """A new folder where all executors see it: below spark.checkpoint.dir, or a temporary one where that is unset and Spark is local."""
    if shared := s.conf.get("spark.checkpoint.dir", None):
        return f"{shared}/{name}-{uuid.uuid4().hex}"
    if not s.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    base = tempfile.mkdtemp(prefix=f"quarry-{name}-")
    atexit.register(shutil.rmtree, base, True)
    return base


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _engine(s):
    from quarry.engine import Engine

    return Engine(s, _base(s, "index"))


def bm25_stored(s, d):
    """All scores of a query, from an index's stored postings."""
    return _hits(search_index(s, d).stored(one_text(s)).scores(), "id")


def bm25_skipping(s, d):
    """The best of each benchmark text, from those stored blocks only that can have any of them."""
    return _hits(search_index(s, d).sparse(batch_texts(s, d), 10, least=0), "query_id", "id", "sparse_rank")


def bm25_grid(s, d):
    """The best of each benchmark text, by a grid of queries and chunks."""
    return _hits(bm25.top_batch(bm25.tokens(corpus(s, d)), batch_texts(s, d), 10, few=0), "query_id", "id", "sparse_rank")


def dense_grid(s, d):
    """The nearest of all vectors to each one whose id is divisible by 10, by a grid of both."""
    return _hits(dense.top(vectors(s, d), _tenth(s, d), 10, few=0), "query_id", "id", "dense_rank")


def _tenth(s, d):
    return vectors(s, d).where("id % 10 = 0").withColumnRenamed("id", "query_id")


def ivf_exact(s, d):
    """The same from the inverted-file index, by the cells that may have any of them."""
    return _hits(vector_index(s, d).search_exact(_tenth(s, d), 10), "query_id", "id", "dense_rank")


def ivf_search(s, d):
    """Nearly the same, from the nearest cells, candidates by their codes."""
    return _hits(vector_index(s, d).search(_tenth(s, d), 10), "query_id", "id", "dense_rank")


def vec_masked_mean(s, d):
    """Means of the vectors of even label in each run of eight ids."""
    runs = tbl(s, d, "embeddings").groupBy(F.expr("vec_id div 8").alias("run")).agg(F.sort_array(F.collect_list(F.struct("vec_id", "embedding", (1 - F.col("label") % 2).alias("m")))).alias("r"))
    pooled = runs.select("run", vec.masked_mean(F.col("r.embedding"), F.col("r.m")).alias("v"))
    return pooled.select("run", F.posexplode("v").alias("dim", "x")).select("run", "dim", F.round("x", 6).alias("mean"))


def chunk_splits(s, d):
    """Windows of lines of files that are read in byte ranges: 200 documents are a file."""
    from quarry.sources.lines import file_lines

    base = _base(s, "splits")
    own = corpus(s, d).withColumn("file", F.expr("id div 200"))
    own.repartition("file").sortWithinPartitions("file", "id").select("file", "text").write.partitionBy("file").text(f"{base}/files")
    key, old = "spark.sql.files.maxPartitionBytes", s.conf.get("spark.sql.files.maxPartitionBytes")
    s.conf.set(key, "65536")
    try:
        lines = file_lines(s, f"{base}/files", base)
    finally:
        s.conf.set(key, old)
    lines = lines.withColumn("path", F.regexp_extract("path", "file=([0-9]+)", 1))
    return chunking.windows_of_lines(lines, 10, 2)


def index_project(s, d):
    engine = _engine(s)
    engine.index(_sample_tree(), "sample")
    return engine.store.chunks("sample").select("project", "type", "name", "line_start", "line_end", "text")


def health(s, d):
    return _engine(s).health().select("check", "ok")


def stream_changes(s, d):
    """The log as a stream of one file, coalesced and applied in micro-batches to an empty index of paths."""
    from quarry.sources.store import IndexStore
    from quarry.streaming import watch

    base = _base(s, "stream")
    log = code_events(s, d).select("project", F.concat("path", F.lit(".py")).alias("path"), "op", F.concat(F.lit("x = "), F.col("event_id").cast("string")).alias("text"), F.col("event_time").cast("timestamp").alias("event_time"), "event_id")
    log.write.parquet(f"{base}/log")
    store = IndexStore(s, f"{base}/index")
    watch.stream_changes(s.readStream.schema(watch.CHANGE).parquet(f"{base}/log"), store, f"{base}/checkpoint", once=True).awaitTermination()
    return store.chunks().select("project", "path", "text")


_ALL = [
    tokenize, split_lines, chunk_lines, chunk_lines_overlap, chunk_lines_default, chunk_dispatch, lang_map, symbol_name, filter_supported, filter_ignored, scan_ragignore,
    content_hash, chunk_symbols, bm25_tf, bm25_df, bm25_corpus_stats, bm25_idf, bm25_score, bm25_topk, bm25_empty, bm25_stored, bm25_skipping, bm25_grid, dense_topk, dense_rank, dense_topk_batch, dense_grid, ivf_exact, ivf_search, vec_normalize,
    vec_mean_pool, vec_masked_mean, chunk_splits, rrf_fuse, rrf_k30, rrf_k90, sql_fuse, rrf_missing, hybrid_search, hybrid_search_batch, dense_only_search, search_file_types, scan_chunks, chunks_by_path, list_files,
    list_projects, project_stats, total_chunks, dry_run, registry_upsert, registry_lookup, file_content, detect_changes, detect_by_digest, append_new_chunks, append_bloom, delete_paths, force_clear,
    projects_to_index, parse_changed, coalesce_changes, debounce_sessions, stream_debounce, apply_changes, scan_files, discover_repos, embed_text, index_project, health, stream_changes,
]
QUERIES = {f.__name__: f for f in _ALL}

from quarry.plans.oracles import ORACLES  # noqa: E402, F401

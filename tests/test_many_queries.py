"""Searches of many queries: grids, stored blocks, the inverted-file index; each against the plain way."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import bm25, dense
from quarry.operators.ivf import VectorIndex
from quarry.plans import catalog
from quarry.sources.store import CHUNK, IndexStore

SF = "/root/testdata/sf0.01"


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("cells", [7, 4096])
def test_grid_equals_one_scan(spark, monkeypatch, cells):
    monkeypatch.setattr("quarry.operators.grid.QUERIES", cells)
    rng = np.random.default_rng(1)
    v = spark.createDataFrame([(i, x) for i, x in enumerate(rng.normal(size=(300, 5)).round(1).tolist())] + [(900, None), (901, [1.0, 2.0]), (902, []), (903, [0.5] * 5), (903, [0.5] * 5)], "id long, embedding array<float>")
    q = v.where("id % 3 = 0 or id >= 900").select(F.col("id").alias("query_id"), "embedding").dropDuplicates(["query_id"])
    for k in (0, 1, 6, 400):
        near = dense.top(v, q, k, few=10_000)
        assert rows(dense.top(v, q, k, few=0)) == rows(near)
    got = {r["query_id"]: r["id"] for r in dense.top(v, q, 1).collect()}
    assert got[901] == 901 and 900 not in got and 902 not in got
    assert dense.top(v.limit(0), q, 3, few=0).count() == dense.top(v, q.limit(0), 3).count() == 0


def test_sparse_grid_equals_joins(spark, monkeypatch):
    monkeypatch.setattr("quarry.operators.grid.QUERIES", 5)
    rng = random.Random(2)
    texts = [" ".join(f"w{min(int(rng.expovariate(0.1)), 40)}x" for _ in range(rng.randrange(30))) for _ in range(120)]
    chunks = spark.createDataFrame([*enumerate(texts), (500, None), (501, "")], "id long, text string")
    queries = spark.createDataFrame([(i, f"w{i}x w{i * 2}x w{i}x none") for i in range(30)], "query_id long, text string")
    toks = bm25.tokens(chunks)
    want = {(q, i): (s, r) for q, i, s, r in map(tuple, bm25.top(bm25.scores(toks, queries), 7).collect())}
    for few in (0, 1000):
        got = {(q, i): (s, r) for q, i, s, r in map(tuple, bm25.top_batch(toks, queries, 7, few).collect())}
        assert got.keys() == want.keys() and all(got[x] == (pytest.approx(want[x][0], abs=1e-8), want[x][1]) for x in got)
        assert bm25.top_batch(toks, queries.where("query_id < 0"), 7, few).count() == bm25.top_batch(toks, spark.createDataFrame([(1, "none other")], queries.schema), 7, few).count() == 0


def stored(spark, base, texts, projects=2):
    df = spark.createDataFrame([(f"p{i % projects}", f"f{i}", str(i), 0, t, i) for i, t in enumerate(texts)], "project string, path string, chunk_id string, chunk_idx int, text string, id long")
    store = IndexStore(spark, str(base))
    none = [F.lit(None).cast(kind).alias(name) for name, kind in (x.split() for x in CHUNK.split(", ")) if name not in df.columns]
    store.replace(df.select("*", *none), [f"p{i}" for i in range(projects)])
    return store


@pytest.mark.parametrize("bucket", [4, 128])
def test_skipped_blocks_change_nothing(spark, tmp_path, monkeypatch, bucket):
    monkeypatch.setattr(bm25, "BUCKET", bucket)
    rng = random.Random(bucket)
    texts = [" ".join(f"w{min(int(rng.expovariate(0.08)), 60)}x" for _ in range(rng.choice([1, 3, 10, 80, 300]))) for _ in range(400)]
    store = stored(spark, tmp_path, texts)
    queries = spark.createDataFrame([(i, f"w{i}x w{i * 3 + 1}x w{i}x none") for i in range(12)], "query_id long, text string")
    toks = bm25.tokens(store.chunks())
    for k in (1, 10, 1000):
        want = bm25.top(bm25.scores(toks, queries), k).collect()
        got = {(r["query_id"], r["id"]): (r["score"], r["sparse_rank"]) for r in store.stored(queries).top(k, first=2, least=0).collect()}
        assert {(r["query_id"], r["id"]): (pytest.approx(r["score"], abs=1e-8), r["sparse_rank"]) for r in want} == got
    if bucket == 4:
        asked = store.stored(queries)
        count = lambda df: df.agg(F.coalesce(F.sum("n_blocks"), F.lit(0))).first()[0]
        head, rest = asked.looks(3, 2)
        assert 0 < count(head) + count(rest) < 0.7 * count(asked.bounds())


@pytest.mark.parametrize("cells", [64, 2_000_000])
def test_many_pairs_meet_by_bucket(spark, tmp_path, monkeypatch, cells):
    """Beyond PAIRS no row a query and a chunk is shuffled, and nothing changes; ties too."""
    monkeypatch.setattr(bm25, "PAIRS", 0)
    monkeypatch.setattr(bm25, "BUCKET", 8)
    monkeypatch.setattr(bm25, "AT_ONCE", 20)
    monkeypatch.setattr(bm25, "CELLS", cells)
    rng = random.Random(cells)
    texts = [" ".join(f"w{min(int(rng.expovariate(0.08)), 60)}x" for _ in range(rng.choice([1, 3, 10, 80, 300]))) for _ in range(300)]
    store = stored(spark, tmp_path, texts + texts[:50])
    queries = spark.createDataFrame([(i, f"w{i}x w{i * 3 + 1}x w{i}x none") for i in range(12)] + [(50, "none"), (51, None)], "query_id long, text string")
    toks = bm25.tokens(store.chunks())
    for k in (0, 1, 10, 1000):
        want = {(r["query_id"], r["id"]): (pytest.approx(r["score"], abs=1e-8), r["sparse_rank"]) for r in bm25.top(bm25.scores(toks, queries), k).collect()}
        found = store.stored(queries).top(k)
        assert want == {(r["query_id"], r["id"]): (r["score"], r["sparse_rank"]) for r in found.collect()}
    plan = found._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "query_id" not in "".join(x for x in plan.split("== Physical Plan ==")[1].split("\n") if "Exchange hashpartitioning" in x and "key#" in x)
    blocks = bm25.blocks(store.chunks().select("project", "id", bm25.tokenize(F.col("text")).alias("tokens")))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(project" in blocks and not [x for x in blocks.split("\n") if "Exchange hashpartitioning" in x and "term#" in x]


def held(work) -> float:
    """MB that work() holds at most."""
    import tracemalloc

    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_a_batch_of_vectors_is_met_in_parts():
    """What a task holds does not grow with queries times vectors, nor with queries times cells; ids of equal distance go in order."""
    import pyarrow as pa

    from quarry.operators import ivf

    rng = np.random.default_rng(5)
    q, v = rng.normal(size=(2000, 8)), rng.normal(size=(4000, 8))
    v[2000:] = v[:2000]
    lists = lambda x: pa.array(x.astype(np.float32).tolist(), pa.list_(pa.float32()))
    batches = [pa.RecordBatch.from_arrays([pa.array(range(lo, lo + 2000)), lists(v[lo : lo + 2000])], ["id", "embedding"]) for lo in (2000, 0)]
    near = dense.Nearest(np.arange(2000), lists(q), 4)
    assert held(lambda: [near.add(b) for b in batches]) < 60
    ids, items, d = near.hits()
    want = ((q[7].astype(np.float32).astype(float) - v.astype(np.float32)) ** 2).sum(1)
    assert len(ids) == 8000 and items[ids == 7].tolist() == np.lexsort((np.arange(4000), want))[:4].tolist() and d[ids == 7] == pytest.approx(np.sort(want)[:4])
    books = [rng.normal(size=(256, 4)) for _ in range(2)]
    codes = rng.integers(0, 256, (2000, 2), np.uint8)
    coded = ivf.Coded(np.arange(2000), q, books, 5)
    packed = pa.RecordBatch.from_arrays([pa.array(range(2000)), pa.nulls(2000), pa.array([c.tobytes() for c in codes], pa.binary())], ["id", "embedding", "code"])
    assert held(lambda: coded.add(packed)) < 60
    want = sum(((q[9, 4 * j : 4 * j + 4] - books[j][codes[:, j]]) ** 2).sum(1) for j in range(2))
    ids, items, d = coded.hits()
    assert d[ids == 9] == pytest.approx(np.sort(want)[:5])
    c, n, radius = rng.normal(size=(1500, 8)), np.ones(1500, np.int64), np.zeros(1500)
    n[3] = 0
    reach = np.full(2000, np.inf)
    met = {}

    def count():
        for own, cell in ivf.pairs(q, c, n, radius, 0, reach):
            assert len(own) == len(cell) <= ivf.PROBED and 3 not in cell
            met["n"] = met.get("n", 0) + len(own)

    assert held(count) < 80 and met["n"] == 2000 * 1499
    first = [x for own, cell in ivf.pairs(q[:30], c, n, radius, 4) for x in zip(own.tolist(), cell.tolist(), strict=True)]
    far = ivf.nearest_cells(q[:30], c)
    far[:, 3] = np.inf
    assert first == [(i, j) for i in range(30) for j in np.argsort(far[i], kind="stable")[:4].tolist()]
    assert ivf.nearest_cell(q, c).tolist() == ivf.nearest_cells(q, c).argmin(1).tolist()


def test_ivf_recall_and_pruning(spark, tmp_path):
    """On the test vectors, and where a third of all are one vector."""
    v = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    q = v.where("id % 10 = 0").withColumnRenamed("id", "query_id")
    index = VectorIndex(spark, str(tmp_path / "a"))
    index.build(v)
    want = {tuple(r) for r in dense.top(v, q, 10).select("query_id", "id").collect()}
    found = index.search(q, 10)
    got = {tuple(r) for r in found.select("query_id", "id").collect()}
    assert len(want & got) >= 0.95 * len(want)
    assert rows(index.search_exact(q, 10).select("query_id", "id", "dense_rank")) == rows(dense.top(v, q, 10).select("query_id", "id", "dense_rank"))
    one = q.where("query_id = 0")
    cells = [r["cell"] for r in index.probes(index._asked(one), 3).collect()]
    assert len(cells) == 3 and {f.split("cell=")[1].split("/")[0] for f in index.vectors(cells).select(F.input_file_name().alias("f")).distinct().toPandas()["f"]} == {str(c) for c in cells}
    assert "PartitionFilters: [isnotnull(cell" in index.vectors(cells)._jdf.queryExecution().toString() or "PartitionFilters: [cell" in index.vectors(cells)._jdf.queryExecution().toString()


def test_ivf_hot_and_odd(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("quarry.operators.ivf.BLOCK", 50)
    monkeypatch.setattr("quarry.operators.ivf.QUERIES", 5)
    rng = np.random.default_rng(3)
    data = [(i, x) for i, x in enumerate(rng.normal(size=(200, 6)).tolist())] + [(1000 + i, [1.0] * 6) for i in range(150)] + [(2000, None), (2001, [1.0])]
    v = spark.createDataFrame(data, "id long, embedding array<float>")
    q = v.where("id % 9 = 0").withColumnRenamed("id", "query_id")
    index = VectorIndex(spark, str(tmp_path))
    index.build(v, cells=12)
    whole = v.where("size(embedding) = 6")
    assert rows(index.search_exact(q, 5).select("query_id", "id", "dense_rank")) == rows(dense.top(whole, q, 5).select("query_id", "id", "dense_rank"))
    assert rows(index.search_exact(q, 500).select("query_id", "id", "dense_rank")) == rows(dense.top(whole, q, 500).select("query_id", "id", "dense_rank"))
    empty = VectorIndex(spark, str(tmp_path / "none"))
    empty.build(v.limit(0))
    assert empty.search(q, 3).count() == 0 and empty.search_exact(q, 3).count() == 0


def test_searches_read_the_index(spark):
    """No plan of a search tokenizes documents again."""
    catalog.search_index(spark, SF)
    for name in ("hybrid_search", "hybrid_search_batch", "rrf_fuse", "bm25_stored"):
        plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().toString()
        assert "documents.parquet" not in plan and "postings" in plan, name


@pytest.mark.parametrize("bitmaps", [1, 3])
def test_bloom_filter_tells_most_new_rows(spark, bitmaps):
    from quarry.operators import bloom, changes

    old = spark.range(2000).select(F.lit("p").alias("project"), F.col("id").cast("string").alias("chunk_id"), F.lit("t").alias("text"))
    more = spark.range(1000, 4000).select(F.lit("p").alias("project"), F.col("id").cast("string").alias("chunk_id"), F.lit("n").alias("text")).unionByName(spark.createDataFrame([("p", None, "n"), ("p", "9999", "b"), ("p", "9999", "a")], "project string, chunk_id string, text string"))
    keys = ["project", "chunk_id"]
    found = bloom.build(old, keys, bitmaps)
    told = bloom.tested(more, keys, found, bitmaps)
    assert told.where("cast(chunk_id as int) < 2000 and not __maybe").count() == 0 and told.where("__maybe").count() < 1000 + 0.1 * 2000
    assert rows(changes.append_new(old, more, (found, bitmaps)).fillna("")) == rows(changes.append_new(old, more).fillna(""))
    none = bloom.build(old.limit(0), keys, 1)
    assert bloom.tested(more, keys, none, 1).where("__maybe").count() == 0

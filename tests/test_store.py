"""The index: what a change writes, writers that meet, and postings that are stored."""

import pytest
from pyspark.sql import functions as F

from quarry.operators import bm25
from quarry.sources.store import CHUNK, KEEP, ConcurrentUpdate, IndexStore
from quarry.streaming.watch import CHANGE, apply_batch


def chunks(spark, rows):
    df = spark.createDataFrame(rows, "project string, path string, chunk_id string, text string")
    rest = [F.lit(None).cast(kind).alias(name) for name, kind in (x.split() for x in CHUNK.split(", ")) if name not in df.columns]
    return df.select("*", *rest)


def test_a_change_writes_its_projects_only(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path))
    store.replace(chunks(spark, [("a", "x", "1", "one two"), ("b", "y", "1", "two three")]), ["a", "b"])
    first = store._pointer("chunks")["parts"]
    for i in range(KEEP + 2):
        store.replace(chunks(spark, [("a", "x", "1", f"one word{i}")]), ["a"])
    parts = store._pointer("chunks")["parts"]
    assert parts["b"] == first["b"] and parts["a"] != first["a"] and len(store._numbers("chunks")) == KEEP
    assert sorted((r["project"], r["text"]) for r in store.chunks().collect()) == [("a", f"one word{KEEP + 1}"), ("b", "two three")]
    assert len(store._names(f"{tmp_path}/postings")) == KEEP + 1  # a's last ones, and b's
    store.replace(chunks(spark, []), ["a"])
    assert store.chunks("a").isEmpty() and store.chunks().count() == 1


def test_of_two_writers_one_fails(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path))
    store.replace(chunks(spark, [("a", "x", "1", "one")]), ["a"])
    with pytest.raises(ConcurrentUpdate):
        store._point("chunks", {"number": 1, "parts": {}, "batches": {}})
    assert store.chunks().count() == 1


@pytest.mark.parametrize("most", [2000, 1])
def test_stored_postings_score_as_texts(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(bm25, "MOST_LITERALS", most)
    store = IndexStore(spark, str(tmp_path))
    rows = [(p, f"f{i}", str(i), " ".join(f"t{i * k % 37}" for k in range(1, i + 2))) for i in range(20) for p in ("a", "b")] + [("a", "e", "e", ""), ("b", "n", "n", "? !")]
    store.replace(chunks(spark, rows), ["a", "b"])
    texts = spark.createDataFrame([(1, "t1 t2 t2"), (2, "t0"), (3, "none")], "query_id bigint, text string")
    for project in ("a", None):
        own = store.chunks(project).select(F.xxhash64("project", "chunk_id").alias("id"), "text")
        want = bm25.top(bm25.scores(bm25.tokens(own), texts), 50).collect()
        got = store.sparse(texts, 50, project).collect()
        assert want and sorted((r["query_id"], r["id"], pytest.approx(r["score"], abs=1e-8)) for r in got) == sorted((r["query_id"], r["id"], r["score"]) for r in want)


def test_of_equal_times_the_last_event_counts(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path))
    rows = [("p", "a.py", "upsert", f"x = {i}", i) for i in range(6)] + [("p", "b.py", "upsert", "y = 1", 7), ("p", "b.py", "delete", None, 8)]
    batch = spark.createDataFrame(rows, "project string, path string, op string, text string, event_id bigint").withColumn("event_time", F.lit("2024-01-01").cast("timestamp")).select(*[c.split()[0] for c in CHANGE.split(", ")])
    for number, text in ((0, "x = 5"), (0, "x = 5")):
        apply_batch(store, batch, number, "source")
        assert [r["text"] for r in store.chunks().collect()] == [text]
    assert store.applied(["source", 0]) and not store.applied(["source", 1]) and not store.applied(["other", 0])

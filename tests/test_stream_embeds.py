"""Files that come through the stream are found by dense search."""

from datetime import datetime

from quarry.engine import Engine
from quarry.streaming import watch


def test_stream_embeds(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "index"), "hashing-256")
    rows = [("p", f"/{i}.py", "upsert", f"def f{i}():\n    return {i}\n", datetime(2024, 1, 1, 0, 0, i), i) for i in range(3)]
    spark.createDataFrame(rows, watch.CHANGE).write.parquet(f"{tmp_path}/log")
    stream = spark.readStream.schema(watch.CHANGE).parquet(f"{tmp_path}/log")
    watch.stream_changes(stream, e.store, f"{tmp_path}/cp", once=True, embedder="hashing-256").awaitTermination()
    got = e.store.chunks("p").select("path", "embedding").collect()
    assert {r["path"] for r in got} == {"/0.py", "/1.py", "/2.py"}
    assert all(r["embedding"] is not None and len(r["embedding"]) == 256 for r in got)
    assert {r["path"] for r in e.search("nothing here f1", 3, "p")["results"]} == {"/0.py", "/1.py", "/2.py"}

"""Files that are read in ranges, files that are parsed once, changes of a tree as a stream, and bursts."""

import random
import time

import pytest
from pyspark.sql import functions as F

from quarry import config
from quarry.engine import Engine
from quarry.operators import changes, chunking
from quarry.sources.events import file_events
from quarry.sources.lines import file_lines
from quarry.plans import catalog
from quarry.streaming.debounce import debounced


@pytest.mark.parametrize("size", [200, 1000])
def test_ranges_give_the_windows_of_whole_files(spark, tmp_path, size):
    rng = random.Random(size)
    breaks = ["\n", "\n", "\n\n", "\r\n", "\r", "\x0b", "\x1c", " ", "\x85"]
    texts = {f"{i}.txt": "".join("".join(rng.choice("ab é€") for _ in range(rng.randrange(60))) + rng.choice(breaks) for _ in range(60)) for i in range(3)} | {"4.txt": "one\n", "5.txt": "\n\n", "6.txt": "no end", "7.txt": "", "8.txt": "x" * 3000 + "\nend\n"}
    (tmp_path / "in").mkdir()
    for name, text in texts.items():
        (tmp_path / "in" / name).write_bytes(text.encode())
    (tmp_path / "in/9.txt").write_bytes(b"caf\xc3\xa9 \xff x\n\xfe\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        lines = file_lines(spark, str(tmp_path / "in"), str(tmp_path))
        lines.count()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    lines = lines.withColumn("path", F.regexp_extract("path", "([^/]+)$", 1))
    whole = spark.createDataFrame([("p", k, v) for k, v in texts.items()] + [("p", "9.txt", "café  x\n\n")], "project string, path string, text string")
    for window, overlap in ((10, 2), (3, 0), (5, 4), (1, 0)):
        columns = ["path", "chunk_idx", "chunk_id", "text", "line_start", "line_end"]
        want = sorted(map(tuple, chunking.line_windows(whole, window, overlap).select(*columns).collect()))
        assert sorted(map(tuple, chunking.windows_of_lines(lines, window, overlap).select(*columns).collect())) == want


def test_each_file_is_parsed_once(spark):
    files = spark.createDataFrame([("p", "a.py", "def f():\n    pass\n"), ("p", "b.py", "x = 1\n" * 7), ("p", "c.txt", "t\n" * 3), ("p", "d.py", ""), ("p", "e.py", None), ("p", "f.py", "def broken(:\n")], "project string, path string, text string")
    out = chunking.chunks(files, 5, 1)
    assert str(out._jdf.queryExecution().executedPlan().toString()).count("MapInPandas") == 1
    got = sorted((r["path"], r["chunk_idx"], r["type"], r["line_start"], r["line_end"], r["offset_unit"]) for r in out.collect())
    assert got == [("a.py", 0, "function", 1, 2, "byte"), ("b.py", 0, "block", 1, 5, "line"), ("b.py", 1, "block", 5, 7, "line"), ("c.txt", 0, "block", 1, 3, "line"), ("f.py", 0, "block", 1, 1, "line")]


def drained(stream, name, checkpoint):
    stream.writeStream.format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def test_looks_at_a_tree(spark, tmp_path):
    """Each change comes once, whatever is restarted."""
    tree = tmp_path / "tree"
    (tree / "pkg/deep").mkdir(parents=True)
    (tree / "node_modules").mkdir()
    (tree / "a.py").write_text("1")
    (tree / "pkg/deep/b.py").write_text("1")
    (tree / "pkg/no.txt").write_text("1")
    (tree / "node_modules/x.js").write_text("1")
    seen = []

    def look():
        out = []
        q = file_events(spark, str(tree), str(tmp_path / "notes"), "p").writeStream.foreachBatch(lambda df, _: out.extend((r["path"].removeprefix(f"{tree}/"), r["op"]) for r in df.collect()))
        q.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
        seen.append(sorted(out))

    look()
    look()
    (tree / "a.py").write_text("22")
    (tree / "new").mkdir()
    (tree / "new/c.py").write_text("1")
    look()
    (tree / "new/c.py").unlink()
    (tree / "new").rmdir()
    (tree / "pkg/deep/b.py").unlink()
    look()
    assert seen == [[("a.py", "upsert"), ("pkg/deep/b.py", "upsert")], [], [("a.py", "upsert"), ("new/c.py", "upsert")], [("new/c.py", "delete"), ("pkg/deep/b.py", "delete")]]
    commits = sorted((tmp_path / "cp/commits").glob("[0-9]*"), key=lambda p: int(p.name))
    commits[-1].unlink()  # as if the last batch had not been committed: it comes again, the same
    (tmp_path / "cp/commits" / f".{commits[-1].name}.crc").unlink(missing_ok=True)
    (tree / "late.py").write_text("1")
    look()
    again, more = seen[-1], [("late.py", "upsert")]
    assert again in (sorted(seen[3] + more), seen[3])
    if again == seen[3]:
        look()
        assert seen[-1] == more
    look()
    assert seen[-1] == []


def test_bursts_equal_sessions(spark, tmp_path):
    rng = random.Random(5)
    at = sorted(rng.randrange(4000) for _ in range(400))
    rows = [(f"p{i % 3}", f"f{rng.randrange(9)}.py", rng.choice(["upsert", "delete"]), t, i) for i, t in enumerate(at)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "project string, path string, op string, t long, event_id long").select("project", "path", "op", F.timestamp_seconds(F.col("t") + 1_700_000_000).alias("event_time"), "event_id")
    df.repartition(5).write.parquet(f"{tmp_path}/log")
    end = spark.createDataFrame([("~", "x", "upsert", 1_900_000_000, 9)], "project string, path string, op string, t long, event_id long")
    end.select("project", "path", "op", F.timestamp_seconds("t").alias("event_time"), "event_id").write.mode("append").parquet(f"{tmp_path}/log")
    stream = debounced(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 2).parquet(f"{tmp_path}/log"), 5000, "1000 days")
    stream.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/cp").option("path", f"{tmp_path}/out").trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out")
    want = changes.debounce_sessions(df).select("project", "session_start", "session_end", "n_events")
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))
    last = changes.coalesce_changes(df).where("project = 'p0'").collect()
    newest = {}
    for r in got.where("project = 'p0'").orderBy("session_start").collect():
        newest |= dict.fromkeys(r["upserts"], "upsert") | dict.fromkeys(r["deletes"], "delete")
    assert newest == {r["path"]: r["op"] for r in last}


def test_bursts_in_event_time_are_the_engines_sessions(spark, tmp_path):
    """A burst is a state of its own; no event goes to Python, and no project's events are one list."""
    spark.createDataFrame([], "project string, path string, op string, event_time timestamp, event_id long").write.parquet(f"{tmp_path}/log")
    log = spark.readStream.schema("project string, path string, op string, event_time timestamp, event_id long").parquet(f"{tmp_path}/log")
    plan = debounced(log, 5000, "1 day")._jdf.queryExecution().analyzed().toString()
    assert "session_window" in plan and "TransformWithState" not in plan
    assert "TransformWithState" in debounced(log, 5000, None)._jdf.queryExecution().analyzed().toString()


def test_small_ranges_share_tasks(spark, tmp_path, monkeypatch):
    """Ranges of a few bytes are no task each, and lines keep their numbers."""
    from quarry.sources import lines

    monkeypatch.setattr(lines, "TASKS", 1)
    (tmp_path / "in").mkdir()
    want = {}
    for k in range(7):
        text = "".join(f"{k} {i}\r\n" if i % 5 else f"{k}\x0b{i}\n" for i in range(60))
        (tmp_path / f"in/{k}.txt").write_bytes(text.encode())
        want |= {(str(k), i): x for i, x in enumerate(text.splitlines())}
    key, old = "spark.sql.files.maxPartitionBytes", spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set(key, "40")
    try:
        found = lines.file_lines(spark, f"{tmp_path}/in", str(tmp_path))
    finally:
        spark.conf.set(key, old)
    got = found.select(F.regexp_extract("path", "([0-9]).txt", 1).alias("p"), "line", "text").collect()
    assert len(got) == len(want) and {(r["p"], r["line"]): r["text"] for r in got} == want
    assert len([x for x in next(tmp_path.glob("lines-*")).iterdir() if x.suffix == ".parquet"]) <= spark.sparkContext.defaultParallelism


def test_embedding_holds_few_texts(spark, monkeypatch):
    """Rows aren't sorted into batches of the longest texts; a text has its own vector, beside all columns."""
    from quarry import embed

    rows = [(i, None if i % 50 == 7 else " ".join(f"w{j * i % 97}" for j in range(i * 7 % 60)), [i]) for i in range(700)]
    df = spark.createDataFrame(rows, "id int, text string, more array<int>").coalesce(1)
    out = embed.embed(df)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and "MapInArrow" in plan
    model = embed.HashingEmbedder()
    got = out.collect()
    assert [(r["id"], r["text"], r["more"]) for r in got] == rows
    assert all(r["embedding"] == pytest.approx(model.encode([r["text"]])[0].tolist()) for r in got)
    assert embed.embed(df.limit(0)).count() == 0 and embed.ROWS <= 256


def test_chunks_of_an_append_are_cut_once(spark):
    plan = catalog.append_bloom(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "documents.parquet" not in plan


def test_watch_applies_what_changes(spark, tmp_path):
    tree = tmp_path / "tree"
    tree.mkdir()
    (tree / "a.py").write_text("def a(): pass\n")
    e = Engine(spark, str(tmp_path / "index"))
    q = e.watch(str(tree), "p", str(tmp_path / "watch"), gap_ms=500, every="200 milliseconds")
    try:
        def wait(want):
            end = time.time() + 60
            while time.time() < end and {r["name"] for r in e.store.chunks("p").collect()} != want:
                assert q.exception() is None
                time.sleep(1)
            return {r["name"] for r in e.store.chunks("p").collect()}

        assert wait({"a"}) == {"a"}
        (tree / "b.py").write_text("def b(): pass\n")
        (tree / "a.py").unlink()
        assert wait({"b"}) == {"b"}
    finally:
        q.stop()
    assert e.store.stats("p") == {"chunks": 1, "files": 1} and e.projects().first()["n_files"] == 1
    assert e.file_content(str(tree / "b.py"), "p") == "def b(): pass\n"


def test_settings(monkeypatch):
    for name in config.DEFAULTS:
        monkeypatch.delenv(name, raising=False)
    assert config.setting("index") == "data/index" and config.setting("index", "/x") == "/x"
    monkeypatch.setenv("QUARRY_INDEX", "/env")
    monkeypatch.setenv("QUARRY_EMBEDDER", "")
    assert config.setting("index") == "/env" and config.setting("embedder") == "hashing"


def test_digests_descend_to_what_differs(spark):
    """One file of many changes: one path of folders is looked at."""
    from quarry.operators import digests

    paths = [f"a{i}/b{j}/f{k}.py" for i in range(6) for j in range(5) for k in range(4)] + ["top.py"]
    old = [("p", x, "1") for x in paths] + [("q", "x/y/z.py", "1")]
    new = [("p", x, "2" if x == "a3/b2/f1.py" else "1") for x in paths] + [("q", "x/y/z.py", "1"), ("q", "x/new.py", None)]
    frame = lambda rows: digests.nodes(spark.createDataFrame(rows, "project string, path string, digest string"), 3)
    found, seen = digests.compared(frame(new), frame(old), 3)
    assert sorted(map(tuple, found.collect())) == [("p", "a3/b2/f1.py", "changed"), ("q", "x/new.py", "added")]
    looked = [sorted(r["path"] for r in x.where("project = 'p'").collect()) for x in seen]
    assert looked == [sorted([f"a{i}" for i in range(6)] + ["top.py"]), [f"a3/b{j}" for j in range(5)], [f"a3/b2/f{k}.py" for k in range(4)]]
    gone, _ = digests.compared(frame(old[:5]), frame(old), 3)
    assert sorted(r["path"] for r in gone.collect()) == sorted([x for _, x, _ in old[5:]]) and {r["change"] for r in gone.collect()} == {"removed"}
    same, _ = digests.compared(frame(old), frame(list(reversed(old))), 3)
    assert same.count() == 0


def test_fuse_in_sql(spark):
    from quarry.functions import sql
    from quarry.operators import fusion

    sql.register(spark)
    dense = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 12, 3), (2, 10, 1)], "query_id long, id long, dense_rank int")
    sparse = spark.createDataFrame([(1, 11, 1), (1, 10, 2), (1, 13, 3)], "query_id long, id long, sparse_rank int")
    side = lambda df, w: df.select("query_id", "id", F.lit(w).alias("side"), F.col(f"{w}_rank").alias("rank"))
    side(dense, "dense").unionByName(side(sparse, "sparse")).createOrReplaceTempView("hits")
    got = spark.sql("SELECT * FROM quarry_fuse(k => 60, top_k => 3, hits => TABLE(hits) PARTITION BY query_id ORDER BY rank)")
    want = fusion.fuse(dense, sparse, 60, 3).select("query_id", "id", "score", "rank")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    with pytest.raises(Exception, match="has no"):
        spark.sql("SELECT * FROM quarry_fuse(TABLE(SELECT 1 AS x) PARTITION BY x)").collect()

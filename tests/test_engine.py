"""The retrieval engine against golden values and small models."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry import embed
from quarry.functions import text as tx
from quarry.functions import vectors as vec
from quarry.operators import bm25, catalog, changes, chunking, dense, fusion
from quarry.operators.ignore import ignored, ignored_name, parse_patterns


def values(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def column(df, name):
    return [r[name] for r in df.collect()]


@pytest.mark.parametrize(("text", "tokens"), [("function_name variable_123 test", ["function_name", "variable_123", "test"]), ("FUNCTION_NAME Variable_123", ["function_name", "variable_123"]), ("a b c d e", []), ("", [])])
def test_tokenize(spark, text, tokens):
    assert column(values(spark, [(text,)], "t string").select(tx.tokenize(F.col("t")).alias("x")), "x") == [tokens]


def test_split_lines_is_splitlines(spark):
    own = ["a\n\nb", "a\r\nb\rc\n", "\n", "", "a\x0bb\x0cc\x1cd\x1de\x1ef\x85g\u2028h\u2029i", "x\n\n"]
    got = column(values(spark, [(i, t) for i, t in enumerate(own)], "i int, t string").orderBy("i").select(tx.split_lines(F.col("t")).alias("x")), "x")
    assert got == [t.splitlines() for t in own]


def test_suffix_and_language(spark):
    rows = {"b.tar.PY": ".PY", ".gitignore": "", "x.": "", "noext": "", "a.b/c": "", "d/e.hpp": ".hpp"}
    got = values(spark, [(k,) for k in rows], "p string").select("p", tx.suffix(F.col("p")).alias("s"), tx.language(F.col("p")).alias("l"), tx.is_supported(F.col("p")).alias("ok")).collect()
    assert {r["p"]: r["s"] for r in got} == rows
    assert {r["p"]: r["l"] for r in got if r["l"]} == {"b.tar.PY": "python", "d/e.hpp": "cpp"}
    assert [r["p"] for r in got if r["ok"]] == ["b.tar.PY"]


def test_ignored(spark):
    custom = parse_patterns("# c\n\n own \npre*\n*mid*\n")
    assert custom == ["own", "pre*", "*mid*"]
    yes = ["node_modules/package", ".git/config", "__pycache__/module.pyc", "venv/lib/python3.11", ".pytest_cache/cache", "a/own/b", "prefix/x", "a/xmidy", "z.pyc"]
    no = ["src/main.py", "tests/test_app.js", "components/Button.tsx", "README.md", "x/prefix", "x.egg-info/a.py"]
    got = {r["p"]: r["x"] for r in values(spark, [(p,) for p in yes + no], "p string").select("p", ignored(F.col("p"), custom).alias("x")).collect()}
    assert got == {p: p in yes for p in yes + no} == {p: ignored_name(p, custom) for p in yes + no}


def windows(text, size, overlap):
    ls, step = text.splitlines(), max(1, size - overlap)
    return [("\n".join(ls[i : i + size]), i + 1, min(i + size, len(ls))) for i in range(0, len(ls), step)]


@pytest.mark.parametrize(("n", "size", "overlap"), [(5, 2, 0), (5, 3, 1), (60, 50, 5), (50, 50, 5), (0, 50, 5), (7, 3, 5)])
def test_line_windows(spark, n, size, overlap):
    text = "\n".join(f"l{i}" for i in range(n))
    got = chunking.line_windows(values(spark, [("p", "a.txt", text)], "project string, path string, text string"), size, overlap).orderBy("chunk_idx").collect()
    assert [(r["text"], r["line_start"], r["line_end"]) for r in got] == windows(text, size, overlap)
    assert [r["chunk_id"] for r in got] == [f"a.txt:{i}" for i in range(len(got))]


def test_symbols_and_fallbacks(spark):
    src = "@deco\ndef fé(x):\n    return 'é'\n\nclass A:\n    async def g(self):\n        def h(): pass\n"
    big = "x = 1\n" * 100_000
    rows = [("p", "a.py", src), ("p", "b.py", "def broken(:"), ("p", "c.js", "function a() {}"), ("p", "d.py", big), ("p", "e.py", "")]
    got = chunking.chunks(values(spark, rows, "project string, path string, text string")).orderBy("path", "chunk_idx").collect()
    own = [(r["type"], r["name"], r["line_start"], r["line_end"]) for r in got if r["path"] == "a.py"]
    assert own == [("function", "fé", 1, 3), ("function", "fé", 2, 3), ("class", "A", 5, 7), ("function", "g", 6, 7), ("function", "h", 7, 7)]
    assert next(r["text"] for r in got if r["name"] == "fé").startswith("@deco") and {r["type"] for r in got if r["path"] != "a.py"} == {"block"}
    assert sum(r["path"] == "d.py" for r in got) == len(windows(big, 50, 5)) and not any(r["path"] == "e.py" for r in got)


def model_bm25(texts, query):
    toks = [[t for t in re.findall("[a-z0-9_]+", x.lower()) if len(t) > 1] for x in texts]
    n, avg, df = len(toks), sum(map(len, toks)) / len(toks), Counter(t for x in toks for t in set(x))
    raw = {t: math.log(n - d + 0.5) - math.log(d + 0.5) for t, d in df.items()}
    eps = 0.25 * sum(raw.values()) / len(raw)
    idf = {t: eps if v < 0 else v for t, v in raw.items()}
    q = [t for t in re.findall("[a-z0-9_]+", query.lower()) if len(t) > 1]
    return [sum(idf.get(t, 0) * x.count(t) * 2.5 / (x.count(t) + 1.5 * (0.25 + 0.75 * len(x) / avg)) for t in q) for x in toks]


def scored(spark, texts, query):
    df = values(spark, list(enumerate(texts)), "id long, text string")
    got = {r["id"]: r["score"] for r in bm25.scores(bm25.tokens(df), values(spark, [(0, query)], "query_id long, text string")).collect()}
    return [got.get(i, 0.0) for i in range(len(texts))]


def test_bm25_golden(spark):
    texts = ["def foo(): pass", "class Bar: pass", "import os"]
    assert scored(spark, texts, "foo") == pytest.approx([0.4836218923228314, 0, 0])
    assert scored(spark, texts, "pass") == pytest.approx([0.0863610522005056, 0.0863610522005056, 0])
    assert scored(spark, texts, "pass pass") == pytest.approx([2 * 0.0863610522005056] * 2 + [0])


def test_bm25_small_corpora_have_no_hit(spark):
    for texts in (["def foo(): pass"], ["foo", "bar"]):
        df = values(spark, list(enumerate(texts)), "id long, text string")
        assert bm25.top(bm25.scores(bm25.tokens(df), values(spark, [(0, "foo")], "query_id long, text string")), 5).isEmpty()


def test_bm25_is_the_model(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["aa", "bb", "cc", "dd", "ee", "ff", "the"]) for _ in range(rng.randint(1, 30))) for _ in range(40)]
    assert scored(spark, texts, "aa the the zz ff") == pytest.approx(model_bm25(texts, "aa the the zz ff"))


def test_bm25_batch_is_the_relational_form(spark, monkeypatch):
    monkeypatch.setattr(bm25, "CELLS", 20), monkeypatch.setattr(bm25, "QUERIES", 2)
    rng = random.Random(4)
    word = lambda: rng.choice([f"w{i}" for i in range(40)] + ["the"] * 9)
    texts = [" ".join(word() for _ in range(rng.randint(1, 30))) for _ in range(60)]
    df = bm25.tokens(values(spark, list(enumerate([*texts, *texts[:20], "", "  ", "zz"])), "id long, text string").repartition(3))
    queries = values(spark, [(i, " ".join(word() for _ in range(4))) for i in range(5)] + [(9, "unknown"), (10, "")], "query_id long, text string")
    key = lambda d: sorted((r["query_id"], r["sparse_rank"], r["id"], r["score"]) for r in d.collect())
    assert key(bm25.top_batch(df, queries, 7)) == key(bm25.top(bm25.scores(df, queries), 7)) != []
    assert bm25.top_batch(df, queries, 0).isEmpty() and bm25.top_batch(df.limit(0), queries, 3).isEmpty()


def test_dense_is_exact_with_ties(spark):
    rng = np.random.default_rng(1)
    v = np.round(rng.standard_normal((300, 4)), 1).astype(np.float32)
    v[100:200] = v[0]  # a hot vector
    df = values(spark, [(i, [float(y) for y in x]) for i, x in enumerate(v)], "id long, embedding array<float>")
    q = df.where("id < 7").select(F.col("id").alias("query_id"), "embedding")
    got = {(r["query_id"], r["dense_rank"]): (r["id"], r["distance"]) for r in dense.top(df.repartition(5), q, 12).collect()}
    for i in range(7):
        d = ((v.astype(float) - v[i].astype(float)) ** 2).sum(1)
        for k, j in enumerate(np.lexsort((np.arange(300), d))[:12], 1):
            assert got[i, k][0] == j and got[i, k][1] == pytest.approx(d[j])
    assert [r["id"] for r in dense.top_one(df, [float(x) for x in v[3]], 5).orderBy("dense_rank").collect()] == [got[3, k][0] for k in range(1, 6)]


def test_vectors(spark):
    df = values(spark, [(0, [3.0, 4.0, 0.0, 0.0]), (1, [0.0, 0.0])], "i int, v array<float>")
    assert column(df.orderBy("i").select(vec.normalized(F.col("v")).alias("x")), "x") == [[0.6, 0.8, 0.0, 0.0], [0.0, 0.0]]
    pooled = values(spark, [([[1.0, 2.0], [3.0, 4.0], [9.0, 9.0]], [1, 1, 0])], "v array<array<float>>, m array<int>")
    assert column(pooled.select(vec.masked_mean(F.col("v"), F.col("m")).alias("x")), "x") == [[2.0, 3.0]]
    assert embed.mean_pooled(np.ones((1, 2, 3)), np.zeros((1, 2))).tolist() == [[0, 0, 0]]


def fused(spark, d, s, **kw):
    dn = values(spark, [(0, x, i + 1) for i, x in enumerate(d)], "query_id long, id long, dense_rank int")
    sp = values(spark, [(0, x, i + 1) for i, x in enumerate(s)], "query_id long, id long, sparse_rank int")
    return [(r["id"], r["score"]) for r in fusion.fuse(dn, sp, **kw).orderBy("rank").collect()]


def test_fusion_golden(spark):
    assert fused(spark, [0, 1], [1, 0]) == [(0, pytest.approx(0.03252247488101534)), (1, pytest.approx(0.03252247488101534))]
    assert [x for x, _ in fused(spark, [0, 1, 2], [1, 0, 2])] == [0, 1, 2]
    assert fused(spark, [7], [7], k=30) == [(7, pytest.approx(2 / 31))] and fused(spark, [7], [7], k=90) == [(7, pytest.approx(2 / 91))]
    assert fused(spark, [1, 2], []) == [(1, pytest.approx(1 / 61)), (2, pytest.approx(1 / 62))] and fused(spark, [], [5])[0][0] == 5
    assert fused(spark, [1, 2, 1], [3, 3])[0] == (3, pytest.approx(1 / 61))  # the last dense rank, the first sparse rank


def test_missing_chunks_go_after_the_cut(spark):
    dn = values(spark, [(0, 0, 1), (0, 999, 2)], "query_id long, id long, dense_rank int")
    sp = values(spark, [(0, 0, 1)], "query_id long, id long, sparse_rank int")
    assert column(fusion.looked_up(fusion.fuse(dn, sp), values(spark, [(0, "x")], "id long, text string")), "id") == [0]


def test_dense_only_where_nothing_is_sparse(spark):
    chunks = values(spark, [(0, "foo one"), (1, "bar two"), (2, "baz three")], "id long, text string")
    vectors = values(spark, [(i, [float(i), 0.0]) for i in range(3)], "id long, embedding array<float>")
    texts = values(spark, [(0, "nothing here"), (1, "foo")], "query_id long, text string")
    got = fusion.hybrid_search(chunks, vectors, texts, values(spark, [(0, [0.0, 0.0]), (1, [2.0, 0.0])], "query_id long, embedding array<float>"), 2).collect()
    assert [(r["id"], r["score"]) for r in sorted((r for r in got if r["query_id"] == 0), key=lambda r: r["rank"])] == [(0, 1.0), (1, 0.0)]
    assert {r["search_type"] for r in got if r["query_id"] == 1} == {"hybrid_rrf"}


def test_changes(spark):
    assert column(changes.parse_changed(values(spark, [("a.py\nb c.py\n\n d.js ",), ("x.py  y.py",)], "list string")), "path") == ["a.py", "b c.py", "d.js", "x.py", "y.py"]
    files = "project string, path string, text string"
    old = chunking.line_windows(values(spark, [("p", "a.py", "1"), ("p", "b.py", "2"), ("p", "c.py", "3")], files), 1, 0)
    new = values(spark, [("p", "a.py", "1"), ("p", "b.py", "22"), ("p", "d.py", "4"), ("p", "e.txt", "5")], files)
    assert {r["path"]: r["change"] for r in changes.detect_changes(new, old).collect()} == {"a.py": "unchanged", "b.py": "changed", "c.py": "removed", "d.py": "added"}
    more = values(spark, [("p", "b.py", "upsert", "x\ny"), ("p", "c.py", "delete", None), ("p", "a.py", "upsert", "1")], "project string, path string, op string, text string")
    after = changes.apply_changes(old, more, lambda df: chunking.line_windows(df, 1, 0))
    assert sorted((r["path"], r["text"]) for r in after.collect()) == [("a.py", "1"), ("b.py", "x"), ("b.py", "y")]
    again = changes.append_new(old, chunking.line_windows(values(spark, [("p", "a.py", "other\nnew")], files), 1, 0))
    assert sorted((r["chunk_id"], r["text"]) for r in again.collect() if r["path"] == "a.py") == [("a.py:0", "1"), ("a.py:1", "new")]
    assert changes.append_new(old, old).count() == 3 and changes.force_clear(old, "p").isEmpty()


def test_catalog(spark):
    chunks = values(spark, [("p", "a"), ("p", "a"), ("p", "b"), ("q", None), ("q", "")], "project string, path string")
    reg = values(spark, [("p", "/p", None)], "project string, project_path string, last_indexed timestamp")
    assert sorted(column(catalog.list_files(chunks), "path")) == ["a", "b"]
    got = {r["project"]: (r["n_chunks"], r["project_path"]) for r in catalog.project_stats(chunks, reg).collect()}
    assert got == {"p": (3, "/p"), "q": (2, "N/A")}
    found = values(spark, [("p",), ("new",)], "project string")
    assert column(catalog.projects_to_index(found, chunks), "project") == ["new"] and catalog.projects_to_index(found, chunks, True).count() == 2


@pytest.fixture
def tree(tmp_path):
    for name, text in {"pkg/__init__.py": b"", "pkg/a.py": b"def alpha():\n    return 'needle'\n", "web/App.tsx": b"caf\xc3\xa9\xffx", "README.md": b"x", "build/x.py": b"y", "own/s.js": b"z", ".ragignore": b"# c\nown\n"}.items():
        p = tmp_path / "proj" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(text)
    (tmp_path / "proj/.git").mkdir()
    return tmp_path / "proj"


def test_scan(spark, tree):
    from quarry.sources.tree import discover_repos, scan_files

    got = {r["path"].removeprefix(f"{tree}/"): r["text"] for r in scan_files(spark, str(tree)).collect()}
    assert set(got) == {"pkg/__init__.py", "pkg/a.py", "web/App.tsx"} and got["web/App.tsx"] == "caféx"
    assert [(r["path"], r["name"]) for r in discover_repos(spark, [str(tree.parent), "/nowhere"]).collect()] == [(str(tree), "proj")]
    with pytest.raises(FileNotFoundError):
        scan_files(spark, "/nowhere")


def test_engine(spark, tree, tmp_path):
    from quarry.engine import Engine

    e = Engine(spark, f"{tmp_path}/index")
    assert e.index(str(tree), "p")["chunks"] == 2 and e.index(str(tree), "p")["chunks"] == 2
    (tree / "pkg/b.py").write_text("def beta():\n    return 'other'\n\ndef gamma():\n    pass\n")
    (tree / "web/App.tsx").unlink()
    assert e.index(str(tree), "p")["chunks"] == 3
    hit = e.search("needle alpha", 2, "p")
    assert hit["results"][0]["name"] == "alpha" and hit["total_indexed_chunks"] == 3 and e.search("needle", 2, "p", [".js"])["results"] == []
    reg = e.projects().collect()
    assert [(r["project"], r["n_chunks"], r["project_path"]) for r in reg] == [("p", 3, str(tree))] and reg[0]["last_indexed"]
    assert e.file_content(f"{tree}/pkg/a.py", "p").startswith("def alpha")
    with pytest.raises(FileNotFoundError):
        e.file_content(f"{tree}/README.md", "p")
    (tree / "pkg/b.py").unlink()
    e.reindex_files("p", [f"{tree}/pkg/b.py", f"{tree}/pkg/a.py"])
    assert e.store.chunks("p").count() == 1 and e.store.chunks("none").isEmpty()
    assert all(r["ok"] for r in e.health().collect())
    with pytest.raises(ValueError, match="project"):
        e.files("")
    from quarry.cli import main

    assert main(["--index", f"{tmp_path}/index", "projects"], spark) == 0


def test_registry_keeps_first(spark, tmp_path):
    from quarry.sources.store import IndexStore

    s = IndexStore(spark, f"{tmp_path}/i")
    s.register("p", "/one", "2020-01-01T00:00:00"), s.register("p", "/two", "2021-01-01T00:00:00")
    r = s.registry().collect()
    assert [(x["project_path"], x["first_indexed"].year, x["last_indexed"].year) for x in r] == [("/two", 2020, 2021)]


def test_stream_applies_each_batch_once(spark, tmp_path):
    import datetime

    from quarry.sources.store import IndexStore
    from quarry.streaming import watch

    t = lambda i: datetime.datetime(2024, 1, 1, 0, 0, i)
    rows = [("p", "a.py", "upsert", "x = 1", t(0), 0), ("p", "b.py", "upsert", "y", t(1), 1), ("p", "a.py", "upsert", "x = 2", t(2), 2), ("p", "b.py", "delete", None, t(3), 3), ("p", "c.txt", "upsert", "z", t(4), 4)]
    spark.createDataFrame(rows, watch.CHANGE).write.parquet(f"{tmp_path}/log")
    store = IndexStore(spark, f"{tmp_path}/index")
    for _ in range(2):
        watch.stream_changes(spark.readStream.schema(watch.CHANGE).parquet(f"{tmp_path}/log"), store, f"{tmp_path}/cp", once=True).awaitTermination()
    assert [(r["path"], r["text"]) for r in store.chunks().collect()] == [("a.py", "x = 2")]
    before = store._pointer("chunks")
    watch.apply_batch(store, spark.createDataFrame(rows, watch.CHANGE), 0, f"{tmp_path}/cp")
    assert store._pointer("chunks") == before


def test_hashing_embedder(spark):
    e = embed.HashingEmbedder()
    x = e.encode(["a b c", "", "a b c"])
    assert np.allclose(np.linalg.norm(x, axis=1), [1, 0, 1]) and (x[0] == x[2]).all() and e.encode("one").shape == (1, 64)
    with pytest.raises(KeyError):
        embed.backend("none")


def test_sql_functions(spark):
    from quarry.functions.sql import register

    register(spark)
    values(spark, [("a.py", "def f():\n  pass\nx = 1")], "path string, text string").createOrReplaceTempView("own_files")
    got = spark.sql("SELECT c.* FROM own_files, LATERAL quarry_chunk_lines(text, 2, 0) c ORDER BY 1").collect()
    assert [(r["text"], r["line_start"], r["line_end"]) for r in got] == windows("def f():\n  pass\nx = 1", 2, 0)
    assert [tuple(r) for r in spark.sql("SELECT c.type, c.name FROM own_files, LATERAL quarry_chunk_symbols(text) c").collect()] == [("function", "f")]
    assert spark.sql("SELECT quarry_tokenize('A bc D_e') t, quarry_squared_l2(array(1f, 2f), array(3f, 5f)) d").first()[:] == (["bc", "d_e"], 13.0)


def test_hook(tree):
    from quarry.sources.tree import install_hook

    hook = install_hook(str(tree), "p", "/index")
    assert hook.stat().st_mode & 0o111 and hook == install_hook(str(tree), "p", "/index") and hook.read_text().count("quarry.cli") == 1
    with pytest.raises(FileNotFoundError):
        install_hook("/nowhere", "p", "/index")

"""URL verdicts: rules, templates, labels, and the SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

from quarry.llm import url_filter as uf


def pages(spark, urls, more=""):
    return spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")


@pytest.mark.parametrize(("url", "host", "path", "rule", "verdict"), [
    ("HTTP://A.Example.ORG/en/1?x#y", "a.example.org", "/en/1", "example.org/en/1", "block"), ("http://example.org/es/", "example.org", "/es/", "example.org/es/", "block"), ("x://org/", "org", "/", "org/", "allow"), ("x://notexample.org/es/1", "notexample.org", "/es/1", "org/", "allow"),
    ("http://a.com/de/2", "a.com", "/de/2", "com/de/", "block"), ("http://a.com/fr/", "a.com", "/fr/", "com/fr/", "allow"), ("http://acom/de/2", "acom", "/de/2", None, "allow"), ("http://a.org", "a.org", "", None, "allow"),
    ("http://a.net?u=http://b.com/de/1", "a.net", "", None, "allow"), (None, "", "", None, "allow"), ("", "", "", None, "allow"), ("a.com/de/1", "", "", None, "allow"), ("http://ÄB.com#/de/", "Äb.com".replace("b", "b"), "", None, "allow"), ("x://a.com/de/\n1", "a.com", "/de/\n1", "com/de/", "block"),
])
def test_rules(spark, url, host, path, rule, verdict):
    r = uf.judged(pages(spark, [url])).first()
    assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule, verdict)


def test_templates_are_rejected_by_labels(spark):
    bad = [(f"http://s.net/tag/{i}.html", True if i < 30 else None) for i in range(60)]
    good = [(f"http://s.net/post/{i}.html", False if i < 30 else None) for i in range(60)]
    plain = [(f"http://s.net/word{i}/{i}.html", None) for i in range(60)]
    few = [("http://s.net/rare/1", True)] * 3
    slugs = [(f"http://v.net/a/{c}{d}x/{i}", i % 50 > 1 if i < 100 else None) for i in range(200) for c, d in [(chr(97 + i % 26), chr(97 + i // 26))]]
    rows = [(i, *r, "clash") for i, r in enumerate(bad + good + plain + few + slugs)]
    df = spark.createDataFrame(rows, "page_id long, url string, flag boolean, host string")
    got = {r["page_id"]: r for r in uf.judged(df, rules=[], label=F.col("flag")).collect()}
    assert len(got) == len(rows)
    assert {r["verdict"] for i, r in got.items() if i < 60} == {"block"} and {r["verdict"] for i, r in got.items() if 60 <= i < 183} == {"allow"}
    assert {r["template"] for i, r in got.items() if i < 60} == {"/tag/#.html"} and {r["template"] for i, r in got.items() if i >= 183} == {"/a/*/#"} and {r["verdict"] for i, r in got.items() if i >= 183} == {"block"}


def test_branches_merge_where_labels_do_not_differ(spark):
    label = lambda i, n: F.when(F.col("x") < n, True)  # noqa: E731, F841
    rows = [(h, f"/{b}/#", k < bad) for h, b, n, bad in [("h", "a", 20, 20), ("h", "b", 3, 3), ("h", "c", 40, 0), ("h", "d", 2, 0)] for k in range(n)]
    df = spark.createDataFrame([(h, t.strip("/").split("/"), b) for h, t, b in rows], "host string, template array<string>, blocked boolean")
    got = {"/".join(r["template"]): (r["labelled"], r["blocked"], round(r["purity"], 6)) for r in uf.purities(df).collect()}
    above = (23 + 0.2) / 67
    assert got == {"a/#": (23, 23, round((23 + 2 * above) / 25, 6)), "b/#": (23, 23, round((23 + 2 * above) / 25, 6)), "c/#": (42, 0, round(2 * above / 44, 6)), "d/#": (42, 0, round(2 * above / 44, 6))}


def test_empty_long_and_equal_rows(spark):
    assert uf.judged(pages(spark, [])).count() == 0
    long = "http://a.net/" + "x/" * 50_000
    got = uf.judged(pages(spark, [long, long, "http://a.net/y"]).unionByName(pages(spark, [long]))).collect()
    assert len(got) == 4 and {r["template"].count("**") for r in got} == {0, 1} and {r["verdict"] for r in got} == {"allow"}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT page_id, url FROM '/root/testdata/{sf}/pages.parquet' UNION ALL SELECT -i, u FROM (VALUES (1, NULL), (2, 'x'), (3, 'http://a.com/de/1/2/3/4/5/6/7/8/9/10'), (4, 'http://a.com')) v(i, u)")
    want = sorted(map(str, con.sql(uf.ORACLE).fetchall()))
    more = spark.createDataFrame([(-1, None), (-2, "x"), (-3, "http://a.com/de/1/2/3/4/5/6/7/8/9/10"), (-4, "http://a.com")], "page_id long, url string")
    df = spark.read.parquet(f"/root/testdata/{sf}/pages.parquet").select("page_id", "url").unionByName(more)
    got = sorted(str(tuple(r)) for r in uf.judged(df).select("page_id", "host", "path", "rule", "template", "verdict").collect())
    assert got == want

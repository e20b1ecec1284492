"""Layouts by day, held against one made in memory, and file by file against what stood before."""

import hashlib
import math
import random
import zlib
from collections import defaultdict
from datetime import UTC, datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quarry.llm import late_partitions as lp

SCHEMA = "sale_id long, client_id long, status string, total double, sold_at timestamp_ntz, arrived_at timestamp_ntz, priority int"
START = datetime(2024, 1, 1)  # noqa: DTZ001
CUT = datetime(2024, 3, 20)  # noqa: DTZ001
micros = lambda t: "" if t is None else str(int((t.replace(tzinfo=UTC) - datetime(1970, 1, 1, tzinfo=UTC)) / timedelta(microseconds=1)))
day_of = lambda t: -1 if t is None else (t - datetime(1970, 1, 1)).days  # noqa: E731, DTZ001


def sales(n: int) -> list[tuple]:
    rng, rows = random.Random(4), []
    for i in range(n):
        sold = None if i % 97 == 5 else START + timedelta(days=rng.randrange(20), seconds=rng.randrange(3) * 1000)
        slow = day_of(sold) % 4 == 0
        arrived = None if slow and i % 19 == 7 else (sold or START) + timedelta(days=rng.choice([0, 0, 70, 90]) if slow else 0, seconds=i)
        rows.append((7 if i % 3 == 0 else None if i == 50 else i, i % 5, "done", None if i % 31 == 0 else i * 1.37, sold, arrived, 1))
    return [*rows, rows[1], rows[1], rows[3]]


def copied(rows: list[tuple]) -> list[tuple]:
    out = list(rows)
    for r in rows:
        h = 1 if r[0] is None else zlib.crc32(str(r[0]).encode())
        if h % 3 == 0 and r[4] is not None and day_of(r[4]) % 4 == 0:
            out.append((*r[:3], None if r[3] is None else r[3] + 1, r[4] + timedelta(days=h % 2), None if r[5] is None else r[5] + timedelta(days=1 + h % 97), r[6]))
    return out


def brute(rows: list[tuple], size: int) -> dict[tuple, list[tuple]]:
    best = {}
    low = lambda x: (x is not None, x if x is not None else 0)
    rank = lambda r: (low(r[5]), low(r[4]), low(r[1]), low(r[2]), low(r[3]), low(r[6]))
    for r in rows:
        if r[0] not in best or rank(r) > rank(best[r[0]]):
            best[r[0]] = r
    days, out = defaultdict(list), {}
    for r in best.values():
        days[day_of(r[4])].append(r)
    for day, own in days.items():
        own.sort(key=lambda r: (low(r[4]), low(r[0])))
        for i in range(0, len(own), size):
            out[day, i // size] = own[i : i + size]
    return out


def digest(own: list[tuple]) -> tuple:
    text = [f"{'' if r[0] is None else r[0]}:{micros(r[4])}:{micros(r[5])}" for r in own]
    return len(own), sum(math.floor(100 * (r[3] or 0.0) + 0.5) for r in own), sum(zlib.crc32(x.encode()) for x in text), hashlib.sha256(",".join("" if r[0] is None else str(r[0]) for r in own).encode()).hexdigest()


def dirty_days(rows: list[tuple]) -> set[int]:
    early = [r for r in rows if r[5] is not None and r[5] < CUT]
    start, end = ({r[0]: r for own in brute(x, 10**9).values() for r in own} for x in (early, rows))
    late = {k for k, r in end.items() if r[5] is None or r[5] >= CUT}
    return {day_of(end[k][4]) for k in late} | {day_of(start[k][4]) for k in late if k in start}


def test_query_equals_brute_force(spark, tmp_path):
    rows = sales(2500)
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/sales.parquet")
    got = lp.op11_late_partitions(spark, str(tmp_path)).collect()
    every = copied(rows)
    want, dirty = brute(every, 1 + len(rows) // 1100), dirty_days(every)
    assert dirty and {d for d, _ in want} - dirty
    assert {(r["day"], r["file_no"]): (r["n_rows"], r["cents"], r["rows_crc"], r["ids_sha256"]) for r in got} == {k: digest(v) for k, v in want.items()}
    assert all(r["rewritten"] == (r["day"] in dirty) and r["columns"] == "sale_id,client_id,status,total,sold_at,arrived_at,priority" for r in got)
    paths = {r["path"].removeprefix("file://") for r in got}
    base = Path(next(iter(paths)).split("/data/")[0])
    assert len(paths) == len(got) and {str(p) for p in base.rglob("*") if p.is_file() and "/manifest/" not in str(p)} == paths


def layout(spark, base, rows_per_file=3):
    schema = spark.createDataFrame([], SCHEMA).schema
    return lp.LateTable(spark, f"file://{base}", schema, "sale_id", "arrived_at", lp.sold_day(), ["sold_at", "sale_id"], rows_per_file)


def test_clean_files_stay_and_broken_runs_leave_nothing(spark, tmp_path):
    rows = [(i, 1, "a", 1.0, START + timedelta(days=i % 4), START + timedelta(days=i % 4), 1) for i in range(40)]
    t = layout(spark, tmp_path / "t")
    t.create(spark.createDataFrame(rows, SCHEMA))
    files = lambda: {r["path"].removeprefix("file://"): (Path(r["path"].removeprefix("file://")).read_bytes(), r["day"]) for r in t.manifest().collect()}
    before = files()
    junk = tmp_path / "t/data/__generation=2/__day=19723"
    junk.mkdir(parents=True)
    (junk / "0.parquet").write_text("left by a run that broke off")
    moved = [(5, 1, "b", 2.0, START + timedelta(days=3), CUT, 1), (100, 1, "b", 2.0, START + timedelta(days=3), None, 1), (6, 1, "old", 2.0, START, START - timedelta(days=9), 1)]
    days = {r["day"] for r in t.overwrite(spark.createDataFrame(moved, SCHEMA)).collect()}
    assert days == {19724, 19726}
    after = files()
    assert {p: x for p, x in before.items() if x[1] not in days} == {p: x for p, x in after.items() if x[1] not in days}
    assert not set(before) & {p for p, x in after.items() if x[1] in days} and {str(p) for p in (tmp_path / "t/data").rglob("*.parquet")} == set(after)
    assert {(r["sale_id"], r["status"]) for r in t.rows().collect()} == {(i, "b" if i == 5 else "a") for i in range(40)} | {(100, "b")}
    t.overwrite(spark.createDataFrame([], SCHEMA))
    assert files() == after and t.generation() == 2


def test_empty_and_cleared_days(spark, tmp_path):
    t = layout(spark, tmp_path / "e")
    t.create(spark.createDataFrame([], SCHEMA))
    assert t.manifest().count() == 0 and t.rows().count() == 0 and lp.described(t.manifest()).count() == 0
    t.overwrite(spark.createDataFrame([(1, 1, "a", 1.0, START, START, 1)], SCHEMA))
    t.overwrite(spark.createDataFrame([(1, 1, "b", 1.0, START + timedelta(days=1), CUT, 1)], SCHEMA))
    assert [(r["day"], r["generation"]) for r in t.manifest().collect()] == [(19724, 3)]


def test_places_of_cloud_stores(monkeypatch):
    from quarry.llm import _shared

    seen = []
    monkeypatch.setattr(_shared, "pafs", type("P", (), {"FileSystem": type("F", (), {"from_uri": staticmethod(lambda uri: seen.append(uri))})}))
    for uri in ("s3a://b/x", "s3n://b/x", "file:///b/x", "/b/x"):
        _shared.place(uri)
    assert seen == ["s3://b/x", "s3://b/x", "file:///b/x", "/b/x"]


@pytest.mark.parametrize("n", [1, 4])
def test_partitions_do_not_matter(spark, tmp_path, n):
    rows = spark.createDataFrame(sales(300), SCHEMA)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", n)
    try:
        t = layout(spark, tmp_path / "p", 7)
        t.create(rows.withColumn("total", F.col("total")))
        assert {(r["day"], r["file_no"]): r["ids_sha256"] for r in lp.described(t.manifest()).collect()} == {k: digest(v)[3] for k, v in brute(sales(300), 7).items()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)

"""The trie against one made of dictionaries, and its merge against sorting."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest

from quarry.llm import conversation_trie as ct

SCHEMA = "conv_id long, turn long, role string, text string, digests string"


def rows_of(rng: random.Random, n: int) -> list[tuple]:
    out = []
    for c in range(n):
        size = rng.choice([1, 2, 3, 5, 9])
        talk = [(t, rng.choice(["user", None]), rng.choice(["a", "bb", None, "ü€𝄞", f"x{rng.randrange(4)}"])) for t in range(size)]
        if c % 3 == 0:
            talk = [(t, "user", "same") for t in range(4)]
        if c % 7 == 0:
            talk[0] = (None, "user", "hot")
        out += [(c * 3 if c % 50 else c, t, r, x, "clash") for t, r, x in talk]
    rng.shuffle(out)
    return [*out, (None, 1, "user", "of none", "")]


def brute(rows: list[tuple]) -> list[tuple]:
    own = defaultdict(list)
    for c, t, r, x, _ in rows:
        if c is not None:
            own[c].append(((t is not None, t or 0), r or "", x or ""))
    own = {c: [(r, x) for _, r, x in sorted(v, key=lambda v: v[0])] for c, v in own.items()}
    seqs = {c: own.get(c - c % 100, [])[: (h := zlib.crc32(str(c).encode()) % 6)] + v[h:] for c, v in own.items()}
    members = defaultdict(list)
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    out = []
    for p, m in members.items():
        below, todo = [], [p]
        while todo:
            q = todo.pop()
            below.append(q)
            todo += kids[q]
        ends = ",".join(str(c) for c in sorted(m) if len(seqs[c]) == len(p))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), sum(not kids[q] for q in below), sum((len(members[q]) - 1) * len(q[-1][1]) for q in below if q), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize(("n", "partitions"), [(1, 4), (40, 1), (300, 4), (300, 23)])
def test_equals_dictionaries(spark, tmp_path, n, partitions):
    rows = rows_of(random.Random(n), n)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
        got = sorted((tuple(r) for r in ct.op13_conversation_trie(spark, str(tmp_path)).select(*ct.NODE).collect()), key=str)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert got == brute(rows)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS FROM '{tmp_path}/conversations.parquet/*.parquet'")
    assert sorted(con.sql(f"SELECT {', '.join(ct.NODE)} FROM ({ct.ORACLE})").fetchall(), key=str) == got


def test_no_conversations(spark):
    assert ct.trie(ct.rebuilt(ct.sequences(spark.createDataFrame([], SCHEMA)))).count() == 0


def test_repeated_rows_are_turns(spark):
    got = ct.trie(ct.sequences(spark.createDataFrame([(1, 0, "u", "a", ""), (1, 0, "u", "a", "")], SCHEMA)))
    assert sorted(r["depth"] for r in got.collect()) == [0, 1, 2]


@pytest.mark.parametrize("k", [1, 2, 3, 5, 8, 13])
def test_merge_gives_order_and_shared_turns(k):
    rng = random.Random(k)
    key = lambda: b"".join(bytes([rng.randrange(2)]) * ct.WIDTH for _ in range(rng.randrange(6)))
    rows = [(key(), i, []) for i in range(200)]
    runs = ct.Runs()
    for i in range(k):
        runs.add(rows[i::k])
    got = list(runs.rows())
    assert [r[:2] for r in got] == sorted(r[:2] for r in rows)
    assert [r[3] for r in got[1:]] == [ct.shared(a[0], b[0]) for a, b in zip(got, got[1:])]  # noqa: B905


def test_spilled_runs(monkeypatch):
    monkeypatch.setattr(ct, "MOST_HELD", 20)
    monkeypatch.setattr(ct, "FAN", 3)
    monkeypatch.setattr(ct, "BLOCK", 7)
    rng, runs = random.Random(3), ct.Runs()
    rows = [(bytes([rng.randrange(3)]) * ct.WIDTH, i, [1]) for i in range(500)]
    for i in range(0, 500, 11):
        runs.add(rows[i : i + 11])
    assert [r[:2] for r in runs.rows()] == sorted(r[:2] for r in rows)

"""A prefix trie of conversations, by an external mergesort that knows common prefixes.

A conversation is the sequence of its turns' digests (128 bits of SHA-256 of role and text), which tell turns apart.  Sequences are
dealt by range, those of one sequence by id, so that a hot first turn and a large group of copies fall on many tasks.  A task sorts
runs, each row with the number of turns it shares with the row before (LCP), spills them, and merges them by a loser tree: of
two rows the one that shares more with the last row out is first, and only equal ones are compared, from there on.  A
merged row closes the nodes of the open path below its LCP and opens its own.  A closed node is whole, except for those on a task's
first and last path: these may go on in a neighbouring task.  They come out as parts, are added up by key, and a second pass
of the same kind, over these few rows in order, closes them: at most twice the longest conversation for each task.

Parents' ids: nodes below a whole parent wait for it within the task; those below a part find it by a join on the parts' keys.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm._shared import arrow_rows, salted_join, sized, staged, table
from quarry.workers import ship

#: Bytes of a turn's digest; turns at the start that may come from another conversation.
WIDTH, MOST_HEAD = 16, 6
#: Rows that a task holds before runs are spilled, runs that are merged at once, rows of a spilled block, ids of a piece of ends.
MOST_HELD, FAN, BLOCK, PIECE = 200_000, 128, 1000, 4096
#: Parts that are broadcast at most.
MOST_PARTS = 200_000
#: kind n: whole; c: whole, its parent is a part; p: part; e: ids that end at a part.
ROW = "kind string, key binary, parent binary, depth bigint, conv_id bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved bigint, length bigint, sha string, task int, ord bigint, ends binary"
NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
NO_ENDS = hashlib.sha256(b"").hexdigest()

Row = tuple[bytes, int, list[int], int]  # digests, conversation, lengths, LCP with the row before


def sequences(conversations: DataFrame) -> DataFrame:
    """conv_id, turns (array of digest, length in code points) in the order of turn, null first; equal ones by digest."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.substring(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, 2 * WIDTH))
    each = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct("turn", digest.alias("digest"), F.char_length(text).alias("length")).alias("t"))
    return each.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t")).select("conv_id", F.transform("t", lambda t: F.struct(t["digest"].alias("digest"), t["length"].alias("length"))).alias("turns"))


def rebuilt(own: DataFrame, every: int = 100) -> DataFrame:
    """own (conv_id, turns) with the first turns, crc32 of the id modulo MOST_HEAD of them, as the conversation at the next lower multiple of `every` has them."""
    n = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(MOST_HEAD)).cast("int")
    heads = own.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("__base"), F.slice("turns", 1, MOST_HEAD - 1).alias("__head"))
    both = own.withColumn("__n", n).join(heads, F.col("conv_id") - F.col("conv_id") % every == F.col("__base"), "left")
    head = F.when(F.col("__head").isNotNull(), F.slice("__head", F.lit(1), F.col("__n")))
    rest = F.slice("turns", F.col("__n") + 1, F.greatest(F.size("turns") - F.col("__n"), F.lit(0)))
    return both.select("conv_id", F.when(head.isNull(), rest).otherwise(F.concat(head, rest)).alias("turns"))


def shared(a: bytes, b: bytes, turns: int = 0) -> int:
    """Number of turns that both start with, of which `turns` are known."""
    i, most = WIDTH * turns, min(len(a), len(b))
    while i < most and a[i : i + WIDTH] == b[i : i + WIDTH]:
        i += WIDTH
    return i // WIDTH


def merged(runs: list[Iterator[Row]]) -> Iterator[Row]:
    """The rows of sorted runs in order, by a loser tree; each with the LCP with the row before."""
    k = len(runs)
    heads, common = [next(r, None) for r in runs], [0] * k  # common: turns that a head shares with the last row out
    tree = [0] * k

    def play(a: int, b: int) -> tuple[int, int]:
        x, y = heads[a], heads[b]
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        if common[a] != common[b]:
            return (a, b) if common[a] > common[b] else (b, a)
        n = shared(x[0], y[0], common[a])
        at = slice(WIDTH * n, WIDTH * n + WIDTH)
        first, last = (a, b) if (x[0][at], x[1]) <= (y[0][at], y[1]) else (b, a)
        common[last] = n
        return first, last

    def build(node: int) -> int:
        if node >= k:
            return node - k
        first, tree[node] = play(build(2 * node), build(2 * node + 1))
        return first

    win = build(1) if k else 0
    while k and heads[win] is not None:
        digests, conv, lengths, _ = heads[win]
        yield digests, conv, lengths, common[win]
        heads[win] = next(runs[win], None)
        common[win] = heads[win][3] if heads[win] else 0
        node = (win + k) // 2
        while node:
            win, tree[node] = play(win, tree[node])
            node //= 2


class Runs:
    """Sorted runs of one task; beyond MOST_HELD rows they go to temporary files, which are gone with the task."""

    def __init__(self) -> None:
        self.held, self.n, self.files = [], 0, []

    def add(self, rows: list[tuple[bytes, int, list[int]]]) -> None:
        rows.sort(key=lambda r: r[:2])
        self.held.append([(*r, shared(rows[i - 1][0], r[0]) if i else 0) for i, r in enumerate(rows)])
        self.n += len(rows)
        if self.n >= MOST_HELD:
            self._spill(merged([iter(r) for r in self.held]))
            self.held, self.n = [], 0
            if len(self.files) >= FAN:
                old, self.files = self.files, []
                self._spill(merged([self._read(f) for f in old]))

    def _spill(self, rows: Iterator[Row]) -> None:
        f, block = tempfile.TemporaryFile(), []
        for r in rows:
            block.append(r)
            if len(block) >= BLOCK:
                pickle.dump(block, f)
                block = []
        pickle.dump(block, f)
        self.files.append(f)

    @staticmethod
    def _read(f) -> Iterator[Row]:  # noqa: ANN001
        f.seek(0)
        while True:
            try:
                yield from pickle.load(f)  # noqa: S301
            except EOFError:
                f.close()
                return

    def rows(self) -> Iterator[Row]:
        return merged([*(self._read(f) for f in self.files), *map(iter, self.held)])


class Open:
    """A node of the open path."""

    __slots__ = ("key", "length", "low", "n", "kids", "leaves", "saved", "ends", "part", "ord", "waiting")

    def __init__(self, key: bytes, length: int, ord_: int, part: bool):
        self.key, self.length, self.ord, self.part = key, length, ord_, part
        self.low, self.n, self.kids, self.leaves, self.saved, self.ends, self.waiting = None, 0, 0, 0, 0, [], []

    def joined_by(self, low: int, n: int) -> None:
        self.low, self.n = low if self.low is None else min(low, self.low), self.n + n


def nodes(rows: Iterator[Row], task: int) -> Iterator[tuple]:
    """ROW tuples of a task's sorted rows."""
    path: list[Open] = []
    opened = 0

    def close() -> Iterator[tuple]:
        node = path.pop()
        depth, parent = len(path), path[-1] if path else None
        if parent:
            parent.joined_by(node.low, node.n)
        if node.part:
            for kid in node.waiting:
                yield ("c", kid[0], node.key, kid[1], kid[2], None, *kid[3:], None, None, None)
            yield "p", node.key, parent.key if parent else None, depth, node.low, None, node.n, node.kids, node.leaves, node.saved, node.length, None, task, node.ord, None
            for i in range(0, len(node.ends), PIECE):
                yield "e", node.key, None, None, None, None, None, None, None, None, None, None, task, i, ",".join(map(str, node.ends[i : i + PIECE])).encode()
            return
        for kid in node.waiting:
            yield ("n", kid[0], None, kid[1], kid[2], node.low, *kid[3:], None, None, None)
        leaves, saved = node.leaves if node.kids else 1, node.saved + (node.n - 1) * node.length
        mine = (node.key, depth, node.low, node.n, node.kids, leaves, saved, None, hashlib.sha256(",".join(map(str, node.ends)).encode()).hexdigest())
        parent.kids, parent.leaves, parent.saved = parent.kids + 1, parent.leaves + leaves, parent.saved + saved
        if parent.part:
            yield ("c", mine[0], parent.key, mine[1], mine[2], None, *mine[3:], None, None, None)
        else:
            parent.waiting.append(mine)

    for digests, conv, lengths, lcp in rows:
        first = not path
        if first:
            path.append(Open(b"", 0, 0, True))
        while len(path) > lcp + 1:
            yield from close()
        for d in range(lcp, len(digests) // WIDTH):
            opened += 1
            path.append(Open(hashlib.blake2b(path[-1].key + digests[WIDTH * d : WIDTH * d + WIDTH], digest_size=WIDTH).digest(), lengths[d], opened, first))
        path[-1].joined_by(conv, 1)
        path[-1].ends.append(conv)
    for node in path:
        node.part = True
    while path:
        yield from close()


def _batches(rows: Iterator[tuple], names: list[str], kinds: list[pa.DataType], most: int = 4096) -> Iterator[pa.RecordBatch]:
    held = []
    for r in rows:
        held.append(r)
        if len(held) >= most:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names)


_KINDS = {"string": pa.string(), "binary": pa.binary(), "bigint": pa.int64(), "int": pa.int32()}


def _columns(schema: str) -> tuple[list[str], list[pa.DataType]]:
    pairs = [x.split() for x in schema.split(", ")]
    return [n for n, _ in pairs], [_KINDS[k] for _, k in pairs]


def _sorted_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    runs = Runs()
    for b in batches:
        ids, digests, lengths = (c.to_pylist() for c in b.columns)
        if ids:
            runs.add([(b"".join(d), i, n) for i, d, n in zip(ids, digests, lengths, strict=True)])
    yield from _batches(nodes(runs.rows(), TaskContext.get().partitionId()), *_columns(ROW))


def _digests_of_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, sha of pieces (key, ends) that come in order."""
    def found() -> Iterator[tuple]:
        now, sha = None, None
        for b in batches:
            for key, ends in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if key == now:
                    sha.update(b"," + ends)
                else:
                    if sha:
                        yield now, sha.hexdigest()
                    now, sha = key, hashlib.sha256(ends)
        if sha:
            yield now, sha.hexdigest()

    yield from _batches(found(), ["k", "sha"], [pa.binary(), pa.string()])


def _closed_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of parts that come parents first, each before what is below its next sibling."""
    def found() -> Iterator[tuple]:
        path: list[list] = []  # depth, conv, n, kids, leaves, saved, sha, key

        def close() -> tuple:
            depth, conv, n, kids, leaves, saved, sha, key = path.pop()
            leaves = leaves if kids else 1
            if path:
                for i, x in ((3, 1), (4, leaves), (5, saved)):
                    path[-1][i] += x
            return key, conv, depth, path[-1][1] if path else None, n, kids, leaves, saved, sha

        for b in batches:
            for key, depth, conv, n, kids, leaves, saved, length, sha in zip(*[c.to_pylist() for c in b.columns], strict=True):
                while len(path) > depth:
                    yield close()
                path.append([depth, conv, n, kids, leaves, saved + (n - 1) * length, sha, key])
        while path:
            yield close()

    yield from _batches(found(), ["key", *NODE], [pa.binary(), *[pa.int64()] * 7, pa.string()])


def trie(seqs: DataFrame) -> DataFrame:
    """NODE of the distinct prefixes of seqs (conv_id, turns: array of digest, length), the empty one included; ids must differ.

    No conversations, no nodes.  A conversation's digests and lengths, some 20 bytes a turn, are one row, and a path in a task's memory: the texts
    themselves never are."""
    spark = seqs.sparkSession
    ship(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    flat = seqs.select("conv_id", F.col("turns.digest").alias("digests"), F.col("turns.length").alias("lengths"))
    with arrow_rows(spark):
        out = staged(flat.repartitionByRange(n, "digests", "conv_id").mapInArrow(_sorted_out, ROW), "trie-nodes")
    parts = out.where("kind = 'p'").groupBy("key").agg(F.min(F.struct("task", "ord")).alias("at"), F.min("depth").alias("depth"), F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")], F.min("length").alias("length"))
    pieces = out.where("kind = 'e'").select("key", "ends", "task", "ord").repartition(n, "key").sortWithinPartitions("key", "task", "ord").select("key", "ends")
    with arrow_rows(spark, 256):
        ends = staged(pieces.mapInArrow(_digests_of_ends, "k binary, sha string"), "trie-ends")
    parts = parts.join(ends, F.col("key") == F.col("k"), "left").withColumn("sha", F.coalesce("sha", F.lit(NO_ENDS)))
    ordered = parts.repartition(1).sortWithinPartitions("at").select("key", "depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved", "length", "sha")
    parts = staged(ordered.mapInArrow(_closed_parts, "key binary, " + ", ".join(f"{c} {'string' if c == 'ends_sha256' else 'bigint'}" for c in NODE)), "trie-parts")
    whole = lambda parent: [F.col("conv_id"), F.col("depth"), parent.alias("parent_conv_id"), F.col("n_convs"), F.col("n_children"), F.col("n_leaves"), F.col("saved").alias("saved_tokens"), F.col("sha").alias("ends_sha256")]
    above, few = sized(parts.select(F.col("key").alias("parent"), F.col("conv_id").alias("__above")), MOST_PARTS)
    below = out.where("kind = 'c'")
    below = below.join(above, "parent") if few else salted_join(below, above, ["parent"])
    return out.where("kind = 'n'").select(*whole(F.col("parent_conv_id"))).unionByName(below.select(*whole(F.col("__above")))).unionByName(parts.select(*NODE))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null conv_id: the row belongs to no conversation.  Null role or text: empty; null turn: before all others."""
    return trie(rebuilt(sequences(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))))


#: crc32 of an id's digits, bit by bit.
_CRC = "xor(list_reduce(list_prepend(4294967295, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, x: list_reduce([xor(c, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295)"
ORACLE = f"""
WITH s AS (SELECT conv_id, list(struct_pack(d := sha256(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')), n := length(coalesce(text, ''))::BIGINT) ORDER BY turn NULLS FIRST) AS own FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
     h AS (SELECT *, {_CRC} % {MOST_HEAD} AS h FROM s),
     r AS (SELECT h.conv_id, list_concat(coalesce(b.own[1:h.h], []), h.own[h.h + 1:]) AS seq FROM h LEFT JOIN s b ON b.conv_id = h.conv_id - h.conv_id % 100),
     m AS (SELECT conv_id, len(seq) AS size, d, sha256(array_to_string(list_transform(seq[1:d], lambda t: t.d), ',')) AS key, CASE WHEN d > 0 THEN sha256(array_to_string(list_transform(seq[1:d - 1], lambda t: t.d), ',')) END AS above, CASE WHEN d = 0 THEN 0 ELSE seq[d].n END AS n FROM (SELECT *, unnest(range(len(seq) + 1)) AS d FROM r)),
     o AS (SELECT d, key, min(above) AS above, min(conv_id) AS conv_id, count(*) AS n_convs, min(n) AS n, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (size = d), '') AS ends FROM m GROUP BY d, key),
     k AS (SELECT o.*, (SELECT count(*) FROM o c WHERE c.d = o.d + 1 AND c.above = o.key) AS n_children FROM o),
     t AS (SELECT m.d, m.key, sum((k.n_children = 0)::INT) AS n_leaves, sum((k.n_convs - 1) * k.n) AS saved_tokens FROM k JOIN m ON m.conv_id = k.conv_id AND m.d <= k.d GROUP BY m.d, m.key)
SELECT k.conv_id, k.d::BIGINT AS depth, p.conv_id AS parent_conv_id, k.n_convs::BIGINT AS n_convs, k.n_children::BIGINT AS n_children, t.n_leaves::BIGINT AS n_leaves, t.saved_tokens::BIGINT AS saved_tokens, sha256(k.ends) AS ends_sha256
FROM k JOIN t USING (d, key) LEFT JOIN o p ON p.d = k.d - 1 AND p.key = k.above
"""

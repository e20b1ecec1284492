"""Near-duplicate documents by SetSketch registers.

A sketch has M registers; register i is floor(1 - log_B(x)), cut to 16 bits, of the smallest x that the set's elements have
in the i-th exponential hash: exponentially spaced truncated minima, which merge by the larger register.  Texts of equal
sequences of words (by a 128-bit cryptographic digest) are one class; its smallest (id, text hash) says where its text is.
Registers in bands of ROWS put classes into buckets; two sets of similarity 0.85 share none of BANDS buckets with probability
below 4e-7.  Hashes of words and shingles only find candidates: every link is confirmed on the words themselves.

Pairs aren't enumerated within a bucket.  Each bucket compares its members with one hub, the member that shares the most
buckets with others.  Pairs are estimated jointly by maximum likelihood from both sketches and sizes, and those not far
below the threshold are verified on the full sets of shingles.  Links give components.  Buckets that still hold several
components try a second hub; of what is left then, full sets of members of different components are compared block by block
in memory, and one link for each two components comes out.  So no link between components is lost, and copies cost one
comparison each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm._bytes import FOLD, distinct, exact_sets, shingles, spelled_words
from quarry.llm._shared import arrow_rows, sized, staged, table
from quarry.workers import give_back, ship

BANDS, ROWS = 20, 4
M = BANDS * ROWS
BASE, RATE, LAST = 1.001, 20.0, 65535
#: Estimates so far below the threshold, six standard errors, aren't verified.
MARGIN = 0.25
#: Rows (id and group, 40 bytes) that are broadcast at most.
MOST_NEEDS = 300_000
#: Members of a hub that one task verifies at once.
SPLIT = 256
#: Rounds of hubs; what is left is compared sketch by sketch, in blocks of PART members.
HUB_ROUNDS, PART = 2, 2048
_MUL = np.random.default_rng(97).integers(1 << 40, 1 << 63, M, dtype=np.uint64) | np.uint64(1)


def sketch(sets: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Registers (uint16) of each row's set; of empty sets zeros."""
    out = np.zeros((len(offs) - 1, M), np.uint16)
    full = np.flatnonzero(np.diff(offs))
    if len(full):
        starts = offs[:-1][full]
        for i in range(M):
            low = np.minimum.reduceat((mix_light(sets, i)), starts)
            x = -np.log1p(-(low + 0.5) / 4294967296.0) / RATE
            out[full, i] = np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, LAST)
    return out


def mix_light(sets: np.ndarray, i: int) -> np.ndarray:
    """The i-th hash, 32 bits, of numbers that are well mixed already."""
    return ((sets * _MUL[i]) >> np.uint64(32)).astype(np.uint32)


def sketches(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, digest (of the folded words in their order), registers (binary) for each row of docs."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, words, at, first, lens, data in spelled_words(b.column(1)):
                sets, offs = shingles(words, at, size)
                regs = sketch(sets, offs)
                ends, raw = (first + lens).tolist(), data.tobytes().translate(FOLD)
                digests = [hashlib.blake2b(b" ".join(raw[first[lo] : ends[hi - 1]].split()) if hi > lo else b"", digest_size=16).digest() for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(2).slice(i, j - i), pa.array(np.diff(offs)), pa.array(digests, pa.binary()), pa.array([r.tobytes() for r in regs], pa.binary())], ["doc_id", "text_hash", "n_shingles", "digest", "registers"])
        give_back()

    kind = docs.schema["doc_id"].dataType.simpleString()
    own = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))
    return own.mapInArrow(run, f"doc_id {kind}, text_hash bigint, n_shingles bigint, digest binary, registers binary")


def estimate(more: np.ndarray, less: np.ndarray, same: np.ndarray, n: np.ndarray, m: np.ndarray, steps: int = 200) -> np.ndarray:
    """Similarity that makes the observed numbers of registers where the first sketch is larger, smaller and equal likeliest."""
    u = n / (n + m)
    v = 1 - u
    j = np.linspace(0, 1, steps)[None, :] * (np.minimum(u, v) / np.maximum(u, v))[:, None]

    def p(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    up, down = p(u[:, None] - v[:, None] * j), p(v[:, None] - u[:, None] * j)
    like = lambda count, q: count[:, None] * np.log(np.clip(q, 1e-12, 1))
    best = np.argmax(like(more, up) + like(less, down) + like(same, 1 - up - down), axis=1)
    return j[np.arange(len(j)), best]


def likely(pairs: DataFrame, reps: DataFrame, least: float) -> DataFrame:
    """Pairs (x, c) whose sizes allow the threshold and whose estimate isn't far below."""
    a = reps.select(F.col("rep").alias("x"), F.col("n").alias("nx"), F.col("registers").alias("rx"))
    b = reps.select(F.col("rep").alias("c"), F.col("n").alias("nc"), F.col("registers").alias("rc"))
    both = pairs.join(a, "x").join(b, "c").where((F.least("nx", "nc") >= least * F.greatest("nx", "nc"))).select("x", "c", "nx", "nc", "rx", "rc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for k in range(0, len(big), 2000):
                b = big.slice(k, 2000)
                rx, rc = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint16).reshape(-1, M) for i in (4, 5))
                nx, nc = (b.column(i).to_numpy() for i in (2, 3))
                got = estimate((rx > rc).sum(1), (rx < rc).sum(1), (rx == rc).sum(1), nx, nc)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["x", "c"]).filter(pa.array(got >= least - MARGIN))

    return both.mapInArrow(run, "x bigint, c bigint")


def _texts(docs: DataFrame, needs: DataFrame) -> DataFrame:
    """needs (with place_id and place_hash of a class) and the class's text; once for each row that repeats it."""
    own = docs.where("doc_id is not null").select(F.col("doc_id").alias("place_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("place_hash"), F.col("text").cast("binary").alias("text"))
    return own.join(needs, ["place_id", "place_hash"])


def verified(pairs: DataFrame, docs: DataFrame, places: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (x, c) whose full sets have 100 * intersection >= percent * union.

    Texts travel to their hub; a hub's members are dealt into salted groups of some SPLIT, each with a copy of the hub's text.
    A task holds one hub's set at a time."""
    deg = pairs.groupBy("c").agg(F.ceil(F.count("*") / SPLIT).alias("salts"))
    dealt = pairs.join(deg, "c").select("x", "c", F.pmod(F.xxhash64("x"), F.col("salts")).alias("salt"))
    needs = dealt.select("c", "salt", F.col("x").alias("id"), F.lit(1).alias("kind")).unionByName(dealt.select("c", "salt").distinct().select("c", "salt", F.col("c").alias("id"), F.lit(0).alias("kind")))
    needs, _ = sized(staged(needs.join(places.withColumnRenamed("rep", "id"), "id"), "op6-needs"), MOST_NEEDS)
    texts = _texts(docs, needs).select("c", "salt", "kind", "id", "text")
    texts = texts.repartition("c", "salt").sortWithinPartitions("c", "salt", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, held, names = None, np.zeros((0, size), np.int32), {}
        for b in batches:
            out = []
            for c, kind, rep, text in zip(*(b.column(i).to_pylist() for i in (0, 2, 3, 4)), strict=True):
                if kind == 0:
                    names = {}
                    hub, held = c, exact_sets([text], size, names)[0]
                elif hub == c:
                    own = exact_sets([text], size, names)[0]
                    both = len(own) + len(held) - len(distinct(np.concatenate([own, held]))[1])
                    if 100 * both >= percent * (len(own) + len(held) - both) > 0:
                        out.append((rep, c))
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64())], ["x", "c"])
        hub, held, names = None, None, {}
        give_back()

    return texts.mapInArrow(run, "x bigint, c bigint")


def components(edges: DataFrame) -> DataFrame:
    """node, label (smallest node reachable) of all nodes with an edge (x, c): smallest label of the neighbours, then the label's label, until nothing changes."""
    both = staged(edges.select(F.col("x").alias("a"), F.col("c").alias("b")).union(edges.select("c", "x")).distinct(), "op6-edges")
    labels = staged(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "op6-labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("m"))
        new = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        new = staged(new, "op6-labels")
        jumped = new.join(new.select(F.col("node").alias("label"), F.col("label").alias("far")), "label").select("node", "old", "far")
        jumped = staged(jumped, "op6-labels")
        labels = jumped.select("node", F.col("far").alias("label"))
        if jumped.where("old <> far").isEmpty():
            return labels


def _once(pairs: DataFrame) -> DataFrame:
    """A pair met in several buckets, or both ways round, once."""
    return pairs.select(F.least("x", "c").alias("p"), F.greatest("x", "c").alias("q"), "c").groupBy("p", "q").agg(F.max("c").alias("c")).select(F.when(F.col("c") == F.col("p"), F.col("q")).otherwise(F.col("p")).alias("x"), "c")


def _several(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """bucket, rep, k, weight, label of the buckets that hold several components."""
    known = rows.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("bucket", "rep", "k", "weight", F.coalesce("label", "rep").alias("label"))
    several = known.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("bucket")
    return staged(known.join(several, "bucket"), "op6-open")


def _rest(known: DataFrame, docs: DataFrame, places: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (x, c) between different components of a bucket, verified on full sets: one for each two components of a block.

    Buckets are dealt in blocks of some PART members against each other.  A task holds two blocks' sets and counts all their
    intersections in matrix products over the shingles that occur more than once; only links leave it."""
    blocks = known.groupBy("bucket").agg(F.ceil(F.count("*") / PART).cast("int").alias("blocks"))
    dealt = known.join(blocks, "bucket").withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("bucket", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "rep", "label")
    dealt, _ = sized(staged(dealt.join(places, "rep"), "op6-dealt"), MOST_NEEDS)
    texts = _texts(docs, dealt).select("bucket", "lo", "hi", "own", "rep", "label", "text")
    texts = texts.repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi")

    def compare(group: list) -> pa.RecordBatch:
        own, rep, label = (np.array([g[i] for g in group]) for i in (3, 4, 5))
        rows, ends = exact_sets([g[6] for g in group], size, {})
        n = np.diff(ends)
        both = intersections(distinct(rows)[0], n)
        linked = (100 * both >= percent * (n[:, None] + n[None, :] - both)) & (both > 0) & (label[:, None] < label[None, :])
        if group[0][1] != group[0][2]:
            linked &= own[:, None] != own[None, :]
        x, c = np.nonzero(linked)
        _, one = np.unique(np.stack([label[x], label[c]]), axis=1, return_index=True) if len(x) else (None, np.zeros(0, np.int64))
        return pa.RecordBatch.from_arrays([pa.array(rep[x[one]], pa.int64()), pa.array(rep[c[one]], pa.int64())], ["x", "c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list = []
        for b in batches:
            for row in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if group and group[0][:3] != row[:3]:
                    yield compare(group)
                    group = []
                group.append(row)
        if group:
            yield compare(group)
        group = []
        give_back()

    return texts.mapInArrow(run, "x bigint, c bigint")


def intersections(sets: np.ndarray, n: np.ndarray, columns: int = 4096) -> np.ndarray:
    """Sizes of the intersections of all sets with each other; sets: their elements, one set after the other, of n elements each."""
    row = np.repeat(np.arange(len(n)), n)
    _, col, count = np.unique(sets, return_inverse=True, return_counts=True)
    shared = count[col] > 1
    row, col = row[shared], (np.cumsum(count > 1) - 1)[col[shared]]
    order = np.argsort(col, kind="stable")
    row, col, out = row[order], col[order], np.zeros((len(n), len(n)), np.float32)
    for first in range(0, int(col[-1]) + 1 if len(col) else 0, columns):
        lo, hi = np.searchsorted(col, (first, first + columns))
        part = np.zeros((len(n), columns), np.float32)
        part[row[lo:hi], col[lo:hi] - first] = 1
        out += part @ part.T
    return out.astype(np.int64)


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One row for each row of docs: doc_id, text_hash (xxhash64), n_shingles, component_id, kept.

    Null, empty and blank texts have no shingles and are linked with nothing.  Rows of the same words in the same order are one node;
    rows that share an id and no text are different ones.  A component's id is the smallest of its rows' ids, and of rows of
    that id those of one text (the smallest hash) are kept.  Rows without an id belong to the component of their class, if another row of it
    has an id, else they have none (null) and are kept.  Other columns are not read.  docs.doc_id must be a number."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    with arrow_rows(docs.sparkSession):
        drawn = staged(sketches(docs, size), "op6-sketches")
    full = drawn.where("n_shingles > 0")
    least_row = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "text_hash"))).alias("place")
    # a class's number is written with it, so that it stays; no two classes have the same
    classes = staged(full.groupBy("digest").agg(least_row, F.first("n_shingles").alias("n"), F.first("registers").alias("registers")).withColumn("rep", F.monotonically_increasing_id()), "op6-classes")
    reps = classes.where("place is not null").select("rep", "n", "registers")
    places = classes.where("place is not null").select("rep", F.col("place.doc_id").alias("place_id"), F.col("place.text_hash").alias("place_hash"))
    bands = F.array(*[F.xxhash64(F.lit(j), F.substring("registers", 1 + 2 * ROWS * j, 2 * ROWS)) for j in range(BANDS)])
    rows = reps.select("rep", F.explode(bands).alias("bucket")).distinct()
    shared = rows.groupBy("bucket").agg(F.count("*").alias("k")).where("k > 1")
    rows = staged(rows.join(shared, "bucket"), "op6-buckets")
    weight = rows.groupBy("rep").agg(F.sum("k").alias("weight"))
    rows = staged(rows.join(weight, "rep"), "op6-weights")
    least = percent / 100

    def links(pairs: DataFrame) -> DataFrame:
        with arrow_rows(docs.sparkSession):
            return staged(verified(likely(staged(pairs, "op6-pairs"), reps, least), docs, places, size, percent), "op6-found")

    # first every bucket's heaviest member, then, in buckets that still hold several components, the heaviest outside the first hub's
    hubs = rows.groupBy("bucket").agg(F.max(F.struct("weight", (-F.col("rep")).alias("rep"))).alias("h")).select("bucket", (-F.col("h.rep")).alias("hub"))
    edges = links(_once(rows.join(hubs, "bucket").where("rep <> hub").select(F.col("rep").alias("x"), F.col("hub").alias("c"))))
    labels = components(edges)
    for _ in range(HUB_ROUNDS - 1):
        known = _several(rows, labels)
        first = known.groupBy("bucket").agg(F.max_by("label", F.struct("weight", (-F.col("rep")).alias("rep"))).alias("first"))
        hubs = known.join(first, "bucket").where("label <> first").groupBy("bucket").agg(F.max(F.struct("weight", (-F.col("rep")).alias("rep"), "label")).alias("h")).select("bucket", (-F.col("h.rep")).alias("hub"), F.col("h.label").alias("hub_label"))
        edges = edges.unionByName(links(_once(known.join(hubs, "bucket").where("label <> hub_label").select(F.col("rep").alias("x"), F.col("hub").alias("c")))))
        labels = components(edges)
    # hub against member, all pairs of a bucket of two or three have been compared
    with arrow_rows(docs.sparkSession):
        edges = edges.unionByName(staged(_rest(_several(rows, labels).where("k > 3"), docs, places, size, percent), "op6-found"))
    labels = components(edges)
    first = labels.join(classes.select(F.col("rep").alias("node"), "place"), "node").groupBy("label").agg(F.min("place").alias("best"))
    out = classes.select("digest", "rep", "place").join(labels.join(first, "label").select(F.col("node").alias("rep"), "best"), "rep", "left")
    out = out.select("digest", F.coalesce("best", "place").alias("best"))
    joined = full.select("doc_id", "text_hash", "n_shingles", "digest").join(out, "digest")
    kept = F.col("best").isNull() | (F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("text_hash") == F.col("best.text_hash")))
    joined = joined.select("doc_id", "text_hash", "n_shingles", F.col("best.doc_id").alias("component_id"), kept.alias("kept"))
    return joined.unionByName(drawn.where("n_shingles = 0").select("doc_id", "text_hash", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("kept")))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), 3, 85).drop("text_hash")


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
     s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 2))) AS i FROM w WHERE len(w) > 0)),
     n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
     met AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b USING (g) GROUP BY ALL),
     links AS MATERIALIZED (SELECT x, y FROM met JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE x <> y AND 100 * c >= 85 * (a.n + b.n - c)),
     reach AS (SELECT doc_id, doc_id AS r FROM w UNION SELECT doc_id, y FROM reach JOIN links ON r = x)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, min(r) AS component_id, min(r) = doc_id AS kept FROM reach LEFT JOIN n USING (doc_id) GROUP BY doc_id, n
"""

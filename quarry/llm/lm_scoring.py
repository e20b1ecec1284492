"""Stupid-backoff scores of all documents, by hash-partitioned n-gram counts.

Words are white-space separated, A-Z folded, and named by 40 bits or more of a hash.  A document's word w2 after w0 w1 scores

    S(w2 | w0 w1) = c'(w0 w1 w2) / c(w0 w1)   if c' > 0, else   ALPHA * S(w2 | w1)
    S(w2 | w1) = c'(w1 w2) / c(w1)   if c' > 0, else   ALPHA * c(w2) / N

c counts all documents, c' all documents but the one that is scored (else nothing would ever back off), N is the number of
words.  A document's second word has one word before it and starts at S(w2 | w1), as all words do where the order is 2.  A
document's score is the mean of log10 S over its words after the first; it is null without any.

Trigrams are exploded into buckets by the hash of their middle word w1; a bucket's count table, trigrams, bigrams and contexts,
is made and joined to the exploded trigrams in the same task, for w1 stands in all of them.  Bigrams that no other document has
become look-ups of w2, by the hash of w2, in the unigram tables that the buckets leave.  What buckets add to a document is
summed per task and then per document.

A bucket holds some BUCKET words; their number follows the corpus.  Words that make up 1 / HOT of the corpus, HOT at most, are
counted first and broadcast; where w1 is one of them, trigrams are dealt by w1 and w2, so that no context fills a bucket.  Such
a bucket lacks c(w0 w1): a trigram that another document has becomes a look-up of w0 w1 in tables of pairs, which the buckets
of w0 leave.  N-grams travel as packed arrays, hot words in two bytes, for rows of their own would take more disk than the input.

lm_scores_by_rows is the same as plain joins of count tables, with the words themselves for names: exact whatever hashes do, and
split by Spark where an n-gram is hot; it moves several times as much.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm._bytes import hashed_words, mix
from quarry.llm._shared import ascii_lower, space_words, staged, table
from quarry.workers import ship

ALPHA, HOT, BUCKET = 0.4, 2048, 1_000_000
#: Words whose n-grams a task takes on average: the number of partitions follows the corpus.
TASK = 4_000_000
#: Words of the longest n-gram in op9.
ORDER = 3
#: Words of a batch, and numbers a task sums before it passes them on.
BATCH, HELD = 1_000_000, 4_000_000
_ROW = "bucket bigint, uid bigint, kind int, blob binary"
HEAD, NGRAMS, UNIGRAMS, SUMS = 0, 2, 1, 3


class Space(NamedTuple):
    """bits: of the bucket; hot: hashes of hot words, ascending; counts: theirs; n: words of the corpus."""

    bits: int
    hot: np.ndarray
    counts: np.ndarray
    n: int

    @property
    def width(self) -> int:
        return 4 + -(-self.bits // 8)

    def name(self, words: np.ndarray) -> np.ndarray:
        """The first 32 + bits bits; all ones stand for the end of a document."""
        return np.minimum(words >> np.uint64(32 - self.bits), np.uint64(self.end - 1))

    @property
    def end(self) -> int:
        return (1 << 32 + self.bits) - 1


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[], [], [], []]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)], ["bucket", "uid", "kind", "blob"])


def _short(r: np.ndarray) -> tuple[str, bytes]:
    """Numbers below 2^32 in two bytes where all fit: places of hot words do, hashes don't."""
    kind = "<u2" if not len(r) or r.max() < 1 << 16 else "<u4"
    return kind[-1], r.astype(kind).tobytes()


def _steps(d: np.ndarray) -> tuple[str, bytes]:
    """Ascending numbers as differences, in as few bytes as the largest takes."""
    diff = np.diff(d, prepend=0)
    kind = next(k for k in ("u1", "<u2", "<u4") if not len(diff) or diff.max() < 1 << 8 * int(k[-1]))
    return kind[-1], diff.astype(kind).tobytes()


def pack_words(space: Space, w: np.ndarray) -> bytes:
    """A bit for each word, hot words' places in two bytes, and the others' names."""
    at, hot = _hot_place(space, w)
    names = np.ascontiguousarray(w[~hot].astype("<u8").view(np.uint8).reshape(-1, 8)[:, : space.width])
    return np.packbits(hot).tobytes() + at[hot].astype("<u2").tobytes() + names.tobytes()


def unpack_words(space: Space, blob: bytes, at: int, n: int) -> tuple[np.ndarray, int]:
    """n words and the place after them."""
    hot = np.unpackbits(np.frombuffer(blob, np.uint8, -(-n // 8), at), count=n).astype(bool)
    at, k = at + -(-n // 8), int(hot.sum())
    names = np.zeros((n - k, 8), np.uint8)
    names[:, : space.width] = np.frombuffer(blob, np.uint8, (n - k) * space.width, at + 2 * k).reshape(n - k, space.width)
    w = np.empty(n, np.uint64)
    if k:
        w[hot] = space.hot[np.frombuffer(blob, "<u2", k, at)]
    w[~hot] = names.view("<u8").ravel()
    return w, at + 2 * k + (n - k) * space.width


def pack_ngrams(space: Space, order: int, d: np.ndarray, r1: np.ndarray, w2: np.ndarray, w0: np.ndarray) -> bytes:
    (size, steps), (width, names) = _steps(d), _short(r1)
    return struct.pack("<Icc", len(d), size.encode(), width.encode()) + steps + names + pack_words(space, w2) + (pack_words(space, w0) if order == 3 else b"")


def unpack_ngrams(space: Space, order: int, blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """d, r1, w2, w0; bigrams have ends for w0."""
    n, size, width = struct.unpack_from("<Icc", blob)
    size, width, at = int(size), int(width), 6
    d = np.cumsum(np.frombuffer(blob, f"<u{size}", n, at), dtype=np.int64)
    r1 = np.frombuffer(blob, f"<u{width}", n, at + size * n)
    w2, at = unpack_words(space, blob, at + (size + width) * n, n)
    w0 = unpack_words(space, blob, at, n)[0] if order == 3 else np.full(n, space.end, np.uint64)
    return d, r1, w2, w0


def find_hot(docs: DataFrame) -> Space:
    """Two passes over the texts.  Words that make 1 / (2 HOT) of a block are reported; of those the words whose reports make 1 / HOT of all words are counted exactly."""

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, words, _ in hashed_words(b.column(0)):
                w, n = np.unique(words, return_counts=True)
                often = n * 2 * HOT >= len(words)
                yield pa.RecordBatch.from_arrays([pa.array([*w[often].view(np.int64), None], pa.int64()), pa.array([*n[often], len(words)], pa.int64())], ["w", "n"])

    found = docs.select("text").mapInArrow(report, "w bigint, n bigint").groupBy("w").agg(F.sum("n").alias("n"))
    total = found.where("w is null").collect()
    n = total[0]["n"] if total else 0
    hot = np.sort(np.array([r["w"] for r in found.where(F.col("w").isNotNull() & (F.col("n") * HOT >= n)).select("w").collect()], np.int64).view(np.uint64))  # HOT rows at most
    counts = np.zeros(len(hot), np.int64)
    if len(hot):

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            got = np.zeros(len(hot), np.int64)
            for b in batches:
                for _, _, words, _ in hashed_words(b.column(0)):
                    at = np.minimum(np.searchsorted(hot, words), len(hot) - 1)
                    got += np.bincount(at[hot[at] == words], minlength=len(hot))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(hot))), pa.array(got)], ["i", "n"])

        for r in docs.select("text").mapInArrow(count, "i bigint, n bigint").groupBy("i").agg(F.sum("n").alias("n")).collect():
            counts[r["i"]] = r["n"]
    bits = max(8, int(np.ceil(np.log2(max(1, n) / BUCKET))))
    return _space(bits, hot, counts, n)


def _space(bits: int, hot: np.ndarray, counts: np.ndarray, n: int) -> Space:
    named = Space(bits, hot, counts, n).name(hot)
    order = np.argsort(named)
    return Space(bits, named[order], counts[order], n)


def _hot_place(space: Space, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(space.hot):
        return np.zeros(len(w), np.int64), np.zeros(len(w), bool)
    at = np.minimum(np.searchsorted(space.hot, w), len(space.hot) - 1)
    return at, space.hot[at] == w


def _pair(w: np.ndarray, w2: np.ndarray) -> np.ndarray:
    return mix(w * np.uint64(0x9E3779B97F4A7C15) + w2)


def explode(space: Space, order: int):  # noqa: ANN201
    """Batches of (doc_id, text) to rows of NGRAMS for each bucket, and a HEAD with the batch's ids and numbers of words."""

    def one(uid: int, ids: list, words: list, sizes: list) -> pa.RecordBatch:
        w, n = space.name(np.concatenate(words)), np.concatenate(sizes)
        d = np.repeat(np.arange(len(n)), n)
        w2 = np.empty_like(w)
        w2[:-1] = w[1:]
        if len(w):
            w2[np.cumsum(n)[n > 0] - 1] = space.end
        w0 = np.empty_like(w)
        w0[1:] = w[:-1]
        if len(w):
            w0[(np.cumsum(n) - n)[n > 0]] = space.end
        at, hot = _hot_place(space, w)
        bucket = (w >> np.uint64(32)).astype(np.int64)
        both = _pair(w, w2) >> np.uint64(64 - space.bits)
        bucket[hot] = (1 << space.bits) + both[hot].astype(np.int64)
        r1 = np.where(hot, at, (w & np.uint64(0xFFFFFFFF)).astype(np.int64))
        by = np.argsort(bucket, kind="stable")
        bucket, d, r1, w2, w0 = bucket[by], d[by], r1[by], w2[by], w0[by]
        cuts = np.flatnonzero(np.diff(bucket, prepend=-1, append=-2))
        head = struct.pack("<I", len(ids)) + np.array([0 if x is None else x for x in ids], "<i8").tobytes() + np.array([x is None for x in ids], np.uint8).tobytes() + n.astype("<u4").tobytes()
        rows = [(-1 - uid % 4096, uid, HEAD, head)]
        rows += [(int(bucket[a]), uid, NGRAMS, pack_ngrams(space, order, d[a:b], r1[a:b], w2[a:b], w0[a:b])) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return _rows(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = TaskContext.get().partitionId() << 32
        ids, words, sizes, held = [], [], [], 0
        for b in batches:
            for i, j, w, at in hashed_words(b.column(1)):
                ids += b.column(0).slice(i, j - i).to_pylist()
                words.append(w), sizes.append(np.diff(at))
                held += len(w)
                if held >= BATCH:
                    yield one(uid, ids, words, sizes)
                    ids, words, sizes, held, uid = [], [], [], 0, uid + 1
        if ids:
            yield one(uid, ids, words, sizes)

    return run


def pack_sums(v: np.ndarray) -> bytes:
    """Numbers of 56 bits, first all their highest bytes, then all the next: like bytes stand together, which Spark compresses.
    Where most are 0 only the others travel, with their places: however many tasks there are, no more numbers than n-grams."""
    at, where = np.flatnonzero(v), b"0"
    if len(at) < len(v) // 2:
        size, steps = _steps(at)
        v, where = v[at], struct.pack("<cI", size.encode(), len(at)) + steps
    return where + np.ascontiguousarray(v.astype("<f8").view(np.uint8).reshape(-1, 8)[:, :0:-1].T).tobytes()


def unpack_sums(blob: bytes) -> np.ndarray:
    size, at, first = int(blob[:1]), None, 1
    if size:
        (n,) = struct.unpack_from("<I", blob, 1)
        at, first = np.cumsum(np.frombuffer(blob, f"<u{size}", n, 5), dtype=np.int64), 5 + size * n
    planes = np.frombuffer(blob, np.uint8, offset=first) if len(blob) > first else np.empty(0, np.uint8)
    out = np.zeros((len(planes) // 7, 8), np.uint8)
    out[:, :0:-1] = planes.reshape(7, -1).T
    v = out.view("<f8").ravel()
    if at is None:
        return v
    spread = np.zeros(at[-1] + 1 if len(at) else 0)
    spread[at] = v
    return spread


class Sums:
    """Of what is added to documents, by batch."""

    def __init__(self):
        self.by, self.size = {}, 0

    def add(self, uid: int, d: np.ndarray, values: np.ndarray) -> None:
        new = np.bincount(d, values)
        old = self.by.get(uid, np.zeros(0))
        if len(new) > len(old):
            self.size += len(new) - len(old)
            new[: len(old)] += old
            self.by[uid] = new
        else:
            old[: len(new)] += new

    def rows(self) -> list[tuple]:
        out = [(-1 - uid % 4096, uid, SUMS, pack_sums(v)) for uid, v in self.by.items()]
        self.by, self.size = {}, 0
        return out


def score_seen(space: Space, order: int):  # noqa: ANN201
    """Rows sorted by bucket: NGRAMS become SUMS, UNIGRAMS of each bucket and of pairs, and look-ups (NGRAMS again).

    Looked up are the words of bigrams that no other document has, and contexts of two words whose second is hot.  A pair's
    name is like a word's, in buckets of pairs, 2 << bits and more."""

    def pair_name(w: np.ndarray, w2: np.ndarray) -> np.ndarray:
        return (_pair(w, w2) >> np.uint64(32 - space.bits)) + np.uint64(2 << 32 + space.bits)

    def pair_counts(found: list) -> list[tuple]:
        name, c = (np.concatenate(x) for x in zip(*found, strict=True))
        by = np.argsort(name)
        name, c = name[by], c[by]
        bucket = (name >> np.uint64(32)).astype(np.int64)
        cuts = np.flatnonzero(np.diff(bucket, prepend=-1, append=-2))
        return [(int(bucket[a]), 0, UNIGRAMS, struct.pack("<I", b - a) + (name[a:b] & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes() + c[a:b].astype("<u8").tobytes()) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def look_ups(asked: list) -> list[tuple]:
        uid, d, w2 = (np.concatenate(x) for x in zip(*asked, strict=True))
        bucket = (w2 >> np.uint64(32)).astype(np.int64)
        by = np.lexsort((d, uid, bucket))
        bucket, uid, d, r = bucket[by], uid[by], d[by], w2[by] & np.uint64(0xFFFFFFFF)
        rows, cuts = [], np.flatnonzero(np.diff(bucket, prepend=-1, append=-2))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            inner = np.flatnonzero(np.diff(uid[a:b], prepend=-1, append=-2))
            n = np.diff(inner)
            steps = np.diff(d[a:b], prepend=0)
            steps[inner[:-1]] = d[a:b][inner[:-1]]
            kind = next(k for k in ("<u1", "<u2", "<u4") if steps.max() < 1 << 8 * int(k[-1]))
            rows.append((int(bucket[a]), 0, NGRAMS, struct.pack("<IIc", len(n), b - a, kind[-1].encode()) + uid[a:b][inner[:-1]].astype("<i8").tobytes() + n.astype("<u4").tobytes() + steps.astype(kind).tobytes() + r[a:b].astype("<u4").tobytes()))
        return rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, asked, waiting, pairs, paired = Sums(), [], 0, [], 0

        def counts(key: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Of each n-gram: how many there are, how many in other documents, and whether it is the first of its kind."""
            by = np.argsort(key, kind="stable")  # batches and documents stay in order
            ks, gs = key[by], g[by]
            new = np.concatenate([[True], ks[1:] != ks[:-1]])
            fresh = new | np.concatenate([[True], gs[1:] != gs[:-1]])
            count = lambda first: np.repeat(k := np.diff(np.append(np.flatnonzero(first), len(first))), k)
            every, other, one = np.empty(len(ks), np.int64), np.empty(len(ks), np.int64), np.empty(len(ks), bool)
            every[by] = count(new)
            other[by] = count(new) - count(fresh)
            one[by] = new
            return every, other, one

        def bucket_done(bucket: int, blobs: list) -> list[tuple]:
            nonlocal waiting, paired
            parts = [unpack_ngrams(space, order, x) for _, x in blobs]
            n = np.array([len(p[0]) for p in parts])
            d, r1, w2, w0 = (np.concatenate(x) for x in zip(*parts, strict=True))
            del parts
            g = np.repeat(np.arange(len(n)), n) << 32 | d
            rows, cold = [], bucket < 1 << space.bits
            if cold:
                r, inv, c = np.unique(r1, return_inverse=True, return_counts=True)
                c1 = c[inv]
                rows.append((bucket, 0, UNIGRAMS, struct.pack("<I", len(r)) + r.astype("<u4").tobytes() + c.astype("<u8").tobytes()))
                w1 = np.uint64(bucket << 32) | r1.astype(np.uint64)
            else:
                c1 = space.counts[r1]
                w1 = space.hot[r1]
            every, other, one = counts(mix(mix(r1.astype(np.uint64)) + w2), g)
            real = w2 != np.uint64(space.end)
            at, hot = _hot_place(space, w2)
            value = np.zeros(len(d))
            rest, context = real, None
            if order == 3:
                left = one & hot & (other > 0)  # a trigram that another document has begins with a bigram that another document has
                pairs.append((pair_name(w1[left], w2[left]), every[left]))
                paired += int(left.sum())
                inner = real & (w0 != np.uint64(space.end))
                before = mix(mix(mix(r1.astype(np.uint64)) + np.uint64(1)) + w0)
                again = inner & (counts3 := counts(mix(before + mix(w2)), g)[1]).astype(bool)
                value[again] = np.log10(counts3[again])
                if cold:
                    value[again] -= np.log10(counts(before, g)[0][again])
                else:
                    context = again
                value[inner & ~again] = np.log10(ALPHA)
                rest = real & ~again
            seen = rest & (other > 0)
            value[seen] += np.log10(other[seen] / c1[seen])
            near = rest & (other == 0) & hot
            value[near] += np.log10(ALPHA * space.counts[at[near]] / space.n)
            far = rest & (other == 0) & ~hot
            first = 0
            for (uid, _), size in zip(blobs, n, strict=True):
                own = slice(first, first + size)
                sums.add(uid, d[own], value[own])
                ask = far[own]
                if ask.any():
                    asked.append((np.full(int(ask.sum()), uid), d[own][ask], w2[own][ask]))
                    waiting += int(ask.sum())
                if context is not None and (ask := context[own]).any():
                    asked.append((np.full(int(ask.sum()), uid), d[own][ask], pair_name(w0[own][ask], w1[own][ask])))
                    waiting += int(ask.sum())
                first += size
            if waiting > HELD:
                rows += look_ups(asked)
                asked.clear()
                waiting = 0
            if paired > HELD:
                rows += pair_counts(pairs)
                pairs.clear()
                paired = 0
            return rows + (sums.rows() if sums.size > HELD else [])

        current, blobs = None, []
        for b in batches:
            for bucket, uid, kind, blob in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if kind == HEAD:
                    yield _rows([(bucket, uid, kind, blob)])
                    continue
                if bucket != current and blobs:
                    yield _rows(bucket_done(current, blobs))
                    blobs = []
                current = bucket
                blobs.append((uid, blob))
        if blobs:
            yield _rows(bucket_done(current, blobs))
        rows = sums.rows()
        if asked:
            rows += look_ups(asked)
        if pairs:
            rows += pair_counts(pairs)
        yield _rows(rows)

    return run


def score_unseen(space: Space):  # noqa: ANN201
    """Rows sorted by bucket and kind: look-ups meet their bucket's UNIGRAMS, of pairs in several rows, and become SUMS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, current, tables, names, counts = Sums(), None, [], None, None
        for b in batches:
            rows = []
            for bucket, uid, kind, blob in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if kind in (HEAD, SUMS):
                    rows.append((bucket, uid, kind, blob))
                elif kind == UNIGRAMS:
                    (n,) = struct.unpack_from("<I", blob)
                    if bucket != current:
                        current, tables = bucket, []
                    tables.append((np.frombuffer(blob, "<u4", n, 4), np.frombuffer(blob, "<u8", n, 4 + 4 * n)))
                else:
                    if bucket != current:
                        raise ValueError(f"bucket {bucket} has look-ups but no counts")
                    if tables:
                        names, counts = (np.concatenate(x) for x in zip(*tables, strict=True))
                        by, tables = np.argsort(names, kind="stable"), []
                        names, counts = names[by], counts[by]
                    groups, n, size = struct.unpack_from("<IIc", blob)
                    size, at = int(size), 9
                    uids, each = np.frombuffer(blob, "<i8", groups, at), np.frombuffer(blob, "<u4", groups, at + 8 * groups).astype(np.int64)
                    steps = np.frombuffer(blob, f"<u{size}", n, at + 12 * groups).astype(np.int64)
                    c = counts[np.searchsorted(names, np.frombuffer(blob, "<u4", n, at + 12 * groups + size * n))]
                    value = -np.log10(c) if bucket >= 2 << space.bits else np.log10(ALPHA * c / space.n)
                    first = 0
                    for one, k in zip(uids.tolist(), each.tolist(), strict=True):
                        sums.add(one, np.cumsum(steps[first : first + k]), value[first : first + k])
                        first += k
                    if sums.size > HELD:
                        rows += sums.rows()
            if rows:
                yield _rows(rows)
        yield _rows(sums.rows())

    return run


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by batch and kind: a HEAD, then SUMS."""

    def out(head: tuple, total: np.ndarray) -> pa.RecordBatch:
        ids, null, n = head
        after = np.maximum(n.astype(np.int64) - 1, 0)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64(), mask=null), pa.array(n.astype(np.int64)), pa.array(total / np.maximum(after, 1), pa.float64(), mask=after == 0)], ["doc_id", "n_words", "score"])

    uid, head, total = None, None, None
    for b in batches:
        for own, kind, blob in zip(*[b.column(i).to_pylist() for i in (1, 2, 3)], strict=True):
            if kind == HEAD:
                if head is not None:
                    yield out(head, total)
                (n,) = struct.unpack_from("<I", blob)
                head = np.frombuffer(blob, "<i8", n, 4), np.frombuffer(blob, np.uint8, n, 4 + 8 * n).astype(bool), np.frombuffer(blob, "<u4", n, 4 + 9 * n)
                uid, total = own, np.zeros(n)
            elif own != uid:
                raise ValueError(f"sums of batch {own}, which has no documents")
            else:
                part = unpack_sums(blob)
                total[: len(part)] += part
    if head is not None:
        yield out(head, total)


def lm_scores(docs: DataFrame, order: int = 2) -> DataFrame:
    """doc_id, n_words, score for each row of docs; counts are of docs themselves.  order: 2 (bigrams) or 3 (trigrams).

    Null and empty texts have no words; texts of one word have no score.  Repeated rows are documents of their own, and each
    other's evidence.  Null ids stay null; doc_id must be a number; other columns are not read."""
    if order not in (2, 3):
        raise ValueError(f"order {order}; there are 2 and 3")
    ship(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    space = find_hot(docs)
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-space.n // TASK))
    exploded = docs.mapInArrow(explode(space, order), _ROW).repartition(parts, "bucket").sortWithinPartitions("bucket", "kind", "uid")
    seen = exploded.mapInArrow(score_seen(space, order), _ROW).repartition(parts, "bucket").sortWithinPartitions("bucket", "kind")
    sums = seen.mapInArrow(score_unseen(space), _ROW).repartition(parts, "uid").sortWithinPartitions("uid", "kind")
    return sums.mapInArrow(_documents, "doc_id bigint, n_words bigint, score double")


def lm_scores_by_rows(docs: DataFrame) -> DataFrame:
    """lm_scores of order 3, in DataFrame functions only: exploded n-grams joined to their count tables, summed by document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), space_words(ascii_lower(F.coalesce("text", F.lit("")))).alias("words"))
    rows = staged(rows.withColumn("row", F.monotonically_increasing_id()), "op9-rows")
    each = rows.select("row", "words", F.posexplode("words").alias("i", "w2"))
    each = each.select("row", "w2", F.when(F.col("i") > 0, F.get("words", F.col("i") - 1)).alias("w1"), F.when(F.col("i") > 1, F.get("words", F.col("i") - 2)).alias("w0"))
    # an n-gram once a document, with its number: counts are summed before they are shuffled
    own = staged(each.groupBy("row", "w0", "w1", "w2").agg(F.count("*").alias("n")), "op9-ngrams")
    total = lambda *by: own.groupBy(*by).agg(F.sum("n").alias("c")).where(" and ".join(f"{x} is not null" for x in by))
    c1 = staged(total("w2").withColumnRenamed("w2", "w"), "op9-words")
    n = c1.agg(F.sum("c")).first()[0] or 1
    c2, c3 = staged(total("w1", "w2"), "op9-pairs"), total("w0", "w1", "w2")
    grams = own.where("w1 is not null").join(c3.withColumnRenamed("c", "c3"), ["w0", "w1", "w2"], "left")
    context = F.col("w0").isNotNull()
    seen = context & (F.col("c3") > F.col("n"))
    grams = grams.select("row", "w0", "w1", "w2", "n", seen.alias("seen"), F.when(seen, F.log10(F.col("c3") - F.col("n"))).when(context, F.log10(F.lit(ALPHA))).otherwise(0.0).alias("s"))
    met = grams.where("seen").join(c2.select(F.col("w1").alias("w0"), F.col("w2").alias("w1"), F.col("c").alias("d")), ["w0", "w1"]).select("row", (F.col("n") * (F.col("s") - F.log10("d"))).alias("s"))
    rest = grams.where("not seen").groupBy("row", "w1", "w2").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("s")).alias("s"))
    # a pair's own count is that of the whole document, in whatever contexts
    pairs = own.where("w1 is not null").groupBy("row", "w1", "w2").agg(F.sum("n").alias("own"))
    rest = rest.join(pairs, ["row", "w1", "w2"]).join(c2, ["w1", "w2"])
    again = F.col("c") > F.col("own")
    two = rest.where(again).join(c1.select(F.col("w").alias("w1"), F.col("c").alias("d")), "w1").select("row", (F.col("s") + F.col("n") * F.log10((F.col("c") - F.col("own")) / F.col("d"))).alias("s"))
    one = rest.where(~again).join(c1.select(F.col("w").alias("w2"), F.col("c").alias("d")), "w2").select("row", (F.col("s") + F.col("n") * F.log10(ALPHA * F.col("d") / n)).alias("s"))
    sums = met.unionByName(two).unionByName(one).groupBy("row").agg(F.sum("s").alias("s"))
    size = F.size("words").cast("long")
    return rows.join(sums, "row", "left").select("doc_id", size.alias("n_words"), F.when(size > 1, F.col("s") / (size - 1)).alias("score"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores are rounded to six digits, so that they don't depend on the order of sums."""
    return lm_scores(table(spark, sf_dir, "documents"), ORDER).withColumn("score", F.round("score", 6))


ORACLE = rf"""
WITH t AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+') AS w FROM documents),
     e AS (SELECT r, w[i] AS w2, CASE WHEN i > 1 THEN w[i - 1] END AS w1, CASE WHEN i > 2 THEN w[i - 2] END AS w0 FROM (SELECT r, w, unnest(generate_series(1, len(w))) AS i FROM t)),
     c1 AS (SELECT w2 AS w, count(*) AS c FROM e GROUP BY ALL),
     c2 AS (SELECT w1, w2, count(*) AS c FROM e WHERE w1 IS NOT NULL GROUP BY ALL), o2 AS (SELECT r, w1, w2, count(*) AS o FROM e WHERE w1 IS NOT NULL GROUP BY ALL),
     c3 AS (SELECT w0, w1, w2, count(*) AS c FROM e WHERE w0 IS NOT NULL GROUP BY ALL), o3 AS (SELECT r, w0, w1, w2, count(*) AS o FROM e WHERE w0 IS NOT NULL GROUP BY ALL),
     s AS (SELECT e.r, CASE WHEN c3.c > o3.o THEN log10((c3.c - o3.o) / d2.c)
                       ELSE CASE WHEN e.w0 IS NULL THEN 0 ELSE log10({ALPHA}) END + CASE WHEN c2.c > o2.o THEN log10((c2.c - o2.o) / d1.c) ELSE log10({ALPHA} * u.c / (SELECT sum(c) FROM c1)) END END AS s
           FROM e JOIN c2 USING (w1, w2) JOIN o2 USING (r, w1, w2) JOIN c1 AS d1 ON d1.w = e.w1 JOIN c1 AS u ON u.w = e.w2
           LEFT JOIN c3 ON c3.w0 = e.w0 AND c3.w1 = e.w1 AND c3.w2 = e.w2 LEFT JOIN o3 ON o3.r = e.r AND o3.w0 = e.w0 AND o3.w1 = e.w1 AND o3.w2 = e.w2
           LEFT JOIN c2 AS d2 ON d2.w1 = e.w0 AND d2.w2 = e.w1),
     m AS (SELECT r, sum(s) AS s FROM s GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, CASE WHEN len(w) > 1 THEN round(s / (len(w) - 1), 6) END AS score FROM t LEFT JOIN m USING (r)
"""

"""Best-fit packing planned on the histogram of lengths.

Documents become pieces of at most CAPACITY tokens.  The plan sees only how many pieces have each length (CAPACITY numbers
at most, whatever the input's size) and does best fit, longest first, over counts: a group of sequences with the same room
takes as many pieces of a length as there are, at once.  Each step is a row of the plan: pieces of this length and of these
ranks stand at this offset of these sequences.  Pieces get their rank among those of their length (salted, so that a length
of many pieces is counted by many tasks) and with it their place.
"""

from __future__ import annotations

import bisect
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.llm._bytes import spelled_words
from quarry.llm._shared import arrow_rows, staged, table
from quarry.llm.tokens import BYTE_LEVEL, vocabulary
from quarry.workers import give_back, ship

CAPACITY, END = 2048, 0
#: Pieces of one length that a task ranks, about.
SALTED = 4_000
#: What a worker holds of words and of their letters, at most.
MOST_WORDS, MOST_CORES = 300_000, 60_000
#: Bytes of texts whose words are looked up at once.
BLOCK = 1 << 18
#: Letters that stay themselves in the tokenizer's normal form, in lower case; marks that it splits off a word's end.
LETTERS = re.compile("[a-zß-öø-ÿ]+").fullmatch
MARKS = ".,;:!?"


class IdPool:
    """Token ids of words, found by the word's 64-bit hash: of code c they are ids[starts[c] : starts[c] + lengths[c]].

    Hashes are held sorted, and the words with them: each word of a text is compared with the one it was found as, byte by byte, and
    a block in which one differs is encoded word by word without hashes.  A new word of Latin letters, with or without one mark at its end, is put together
    from the ids of its letters in lower case, merged without the tokenizer's splitting, and of the mark; any other is encoded whole.
    Beyond MOST_WORDS or MOST_CORES what is held is forgotten, and encoded again when met again."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(path)
        encode, merge = whole.encode, whole.model.tokenize
        self.encode = lambda x: array("I", encode(x, add_special_tokens=False).ids).tobytes()
        self.merge = lambda x: array("I", [t.id for t in merge(x if x.isascii() else x.encode().decode("latin-1").translate(BYTE_LEVEL))]).tobytes()
        self.marks = {m: self.encode(m) for m in MARKS}
        self.cores: dict[str, bytes] = {}
        self.forget()

    def forget(self) -> None:
        self.keys, self.codes = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.lengths, self.starts, self.ids = np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.uint32)
        self.sizes, self.spots, self.spelled = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint8)

    def spell(self, word: str) -> bytes:
        core, mark = word.lower(), b""
        if core[-1] in self.marks:
            core, mark = core[:-1], self.marks[core[-1]]
        found = self.cores.get(core)
        if found is None:
            if not LETTERS(core):
                return self.encode(word)
            if len(self.cores) >= MOST_CORES:
                self.cores.clear()
            found = self.cores[core] = self.merge(core)
        return found + mark

    def agree(self, own: np.ndarray, first: np.ndarray, lens: np.ndarray, data: np.ndarray) -> bool:
        """Whether each word is that of its code."""
        if not (self.sizes[own] == lens).all():
            return False
        at = np.cumsum(lens) - lens
        spot = np.arange(int(lens.sum()))
        return bool((data[np.repeat(first - at, lens) + spot] == self.spelled[np.repeat(self.spots[own] - at, lens) + spot]).all())

    def tokens(self, words: np.ndarray, offs: np.ndarray, first: np.ndarray, lens: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a block of texts, and each text's first and end in them."""
        if not len(words):
            return np.zeros(0, np.uint32), np.zeros(len(offs), np.int64)
        if len(self.keys) > MOST_WORDS:
            self.forget()
        keys, spot, which = np.unique(words, return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, keys)
        near = np.minimum(at, max(0, len(self.keys) - 1))
        new = np.flatnonzero(self.keys[near] != keys) if len(self.keys) else np.arange(len(keys))
        if len(new):
            lo = first[spot[new]]
            raw = data.tobytes()
            texts = [raw[a:b] for a, b in zip(lo.tolist(), (lo + lens[spot[new]]).tolist(), strict=True)]
            found = [self.spell(x.decode()) for x in texts]
            size = lens[spot[new]]
            self.spots, self.sizes = np.concatenate([self.spots, len(self.spelled) + np.cumsum(size) - size]), np.concatenate([self.sizes, size])
            self.spelled = np.concatenate([self.spelled, np.frombuffer(b"".join(texts), np.uint8)])
            n = np.fromiter(map(len, found), np.int32, len(found)) // 4
            codes = np.arange(len(self.lengths), len(self.lengths) + len(new), dtype=np.int32)
            self.starts = np.concatenate([self.starts, (len(self.ids) + np.cumsum(n) - n).astype(np.int32)])
            self.lengths, self.ids = np.concatenate([self.lengths, n]), np.concatenate([self.ids, np.frombuffer(b"".join(found), "<u4")])
            self.codes, self.keys = np.insert(self.codes, at[new], codes), np.insert(self.keys, at[new], keys[new])
            at = np.searchsorted(self.keys, keys)
        own = self.codes[at][which]
        if not self.agree(own, first, lens, data):
            raw, found = data.tobytes(), {}
            spelled = [raw[a:b] for a, b in zip(first.tolist(), (first + lens).tolist(), strict=True)]
            for x in spelled:
                if x not in found:
                    found[x] = self.spell(x.decode())
            ends = np.cumsum([0, *(len(found[x]) // 4 for x in spelled)])
            return np.frombuffer(b"".join([found[x] for x in spelled]), "<u4"), ends[offs]
        n = self.lengths[own].astype(np.int64)
        ends = np.cumsum(n)
        ids = self.ids[np.arange(int(ends[-1])) + np.repeat(self.starts[own] - (ends - n), n)]
        return ids, np.concatenate([[0], ends])[offs]


_pools: dict[str, IdPool] = {}


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32.  Null texts are empty: one piece, the end id.

    White space is dropped by the tokenizer and never merged across, so words are encoded one by one, each once a worker."""
    ship(docs.sparkSession)
    path, end = path or vocabulary(), np.array([END], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _pools:
            _pools[path] = IdPool(path)
        pool = _pools[path]
        for b in batches:
            at, piece, start, length, crc = [], [], [], [], []
            for i, j, words, offs, first, lens, data in spelled_words(b.column(1), fold=False, block=BLOCK):
                ids, ends = pool.tokens(words, offs, first, lens, data)
                raw, ends = memoryview(ids.astype("<u4").tobytes()), ends.tolist()
                for row in range(i, j):
                    lo, hi = ends[row - i], ends[row - i + 1]
                    for k, s in enumerate(range(0, hi - lo + 1, capacity)):
                        n = min(capacity, hi - lo + 1 - s)
                        own = zlib.crc32(raw[4 * (lo + s) : 4 * min(lo + s + n, hi)])
                        at.append(row), piece.append(k), start.append(s), length.append(n), crc.append(zlib.crc32(end, own) if lo + s + n > hi else own)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])
        give_back()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, pieces, first sequence, offset): piece rank r stands in sequence first sequence + r - first rank."""
    rows, made = [], 0
    rooms: list[int] = []  # with sequences, ascending
    room: dict[int, list[tuple[int, int]]] = {}  # room -> (first sequence, sequences)

    def keep(left: int, first: int, n: int) -> None:
        if left and n:
            if left not in room:
                bisect.insort(rooms, left)
                room[left] = []
            room[left].append((first, n))

    for length in sorted(counts, reverse=True):
        n, rank = counts[length], 0
        while n:
            k = bisect.bisect_left(rooms, length)
            if k < len(rooms):
                space = rooms[k]
                first, there = room[space].pop()
                if not room[space]:
                    del room[space], rooms[k]
            else:
                space, first, there = capacity, made, -(-n // (capacity // length))
                made += there
            each = min(space // length, n)
            full = min(there, n // each)
            for j in range(each):
                rows.append((length, rank + j * full, full, first, capacity - space + j * length))
            keep(space - each * length, first, full)
            if space < capacity or there - full:
                keep(space, first + full, there - full)
            rank, n = rank + each * full, n - each * full
    return rows


def pack(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Every document has a piece, empty and null ones that of the end id alone.  Repeated rows are packed each by itself;
    ids may be null; other columns are not read.  An empty table gives no row."""
    spark = docs.sparkSession
    with arrow_rows(spark):
        made = staged(token_pieces(docs, capacity, path), "op10-pieces")
    counts = {r["length"]: r["n"] for r in made.groupBy("length").agg(F.count("*").alias("n")).collect()}  # `capacity` rows at most
    rows = sorted(plan(counts, capacity))
    salts = max(1, -(-max(counts.values(), default=0) // SALTED))
    salted = made.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    before = W.partitionBy("length").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)
    ahead = salted.groupBy("length", "salt").agg(F.count("*").alias("n")).withColumn("ahead", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    own = W.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("own", F.row_number().over(own)).join(ahead, ["length", "salt"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("ahead") + F.col("own") - 1).alias("rank"))
    steps = np.array(rows or [(0, 0, 0, 0, 0)], np.int64).T
    shared = spark.sparkContext.broadcast(steps)  # its size follows the number of lengths, not of pieces

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, ranks, _, firsts, offsets = shared.value
        start = {int(x): (int(np.searchsorted(lengths, x)), int(np.searchsorted(lengths, x, "right"))) for x in np.unique(lengths)}
        for b in batches:
            length, rank = (b.column(i).to_numpy(zero_copy_only=False) for i in (3, 5))
            row = np.zeros(len(length), np.int64)
            for x in np.unique(length):
                lo, hi = start[int(x)]
                own = length == x
                row[own] = lo + np.searchsorted(ranks[lo:hi], rank[own], "right") - 1
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(firsts[row] + rank - ranks[row]), pa.array(offsets[row])], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return ranked.mapInArrow(run, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))

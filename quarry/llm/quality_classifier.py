"""Quality by nearest-neighbour voting on latent-semantic vectors.

A document's terms are its whole text's words (A-Z folded), its runs of one, two and three bytes as they are, and the patterns of
recurrence of four neighbouring words (which of them are equal).  Terms are hashed to TERMS numbers; a document's vector has
ln(1 + count) times the term's inverse document frequency, scaled to length one.  The vectors of a bounded sample of labelled
rows give the latent space (a truncated singular value decomposition, made on the driver) and, projected and scaled to length
one, are broadcast: SAMPLE times DIMENSIONS numbers, whatever the corpus' size.  Every document is projected the same way, its
cosines with all labelled vectors are computed in blocks, exactly, and the NEIGHBOURS nearest vote with a weight that grows
with similarity.  The share of the votes is made a probability by a logistic curve, fitted to the votes that the labelled rows
get from each other.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm._bytes import spelled_words
from quarry.llm._shared import sized, staged, table
from quarry.workers import give_back, ship

#: Labelled rows that are learnt from, at most: those of the smallest xxhash64(doc_id), of documents that are there.
SAMPLE = 4000
#: Labels that are broadcast at most.
MOST_LABELS = 1_000_000
TERMS, DIMENSIONS, NEIGHBOURS, POWER, THRESHOLD = 4096, 64, 25, 24, 0.3
#: Rows whose terms are counted at once.
ROWS = 256
_rng = np.random.default_rng(5)
_BYTES = [[_rng.integers(0, TERMS, 256) for _ in range(n)] for n in (1, 2, 3)]
_PATTERNS = _rng.integers(0, TERMS, 64)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def terms(column: pa.Array, patterns: bool = True) -> Iterator[tuple[int, int, np.ndarray]]:
    """(row, end row, counts of terms) by blocks; empty texts have none.  patterns: of recurrence of words, too."""
    for at in range(0, len(column), ROWS):
        part = column.slice(at, ROWS)
        part = (part.fill_null("") if part.null_count else part).cast(pa.large_string())
        offs = np.frombuffer(part.buffers()[1], np.int64)[part.offset : part.offset + len(part) + 1]
        for i, j, words, ends, _, _, data in spelled_words(part):
            n, size = j - i, np.diff(offs[i : j + 1])
            row = np.repeat(np.arange(n), size)
            found = [row * TERMS + _BYTES[0][0][data]]
            for tables in _BYTES[1:]:
                k = len(tables) - 1
                if len(data) > k:
                    code = tables[0][data[:-k]]
                    for t, table in enumerate(tables[1:], 1):
                        code = code ^ table[data[t : len(data) - k + t]]
                    found.append((row[:-k] * TERMS + code)[row[:-k] == row[k:]])
            row = np.repeat(np.arange(n), np.diff(ends))
            found.append(row * TERMS + (words % np.uint64(TERMS)).astype(np.int64))
            if patterns and len(words) > 3:
                four, code = [words[t : len(words) - 3 + t] for t in range(4)], 0
                for bit, (one, two) in enumerate(itertools.combinations(four, 2)):
                    code = code | (one == two).astype(np.int64) << bit
                found.append((row[:-3] * TERMS + _PATTERNS[code])[row[:-3] == row[3:]])
            yield at + i, at + j, np.bincount(np.concatenate(found), minlength=n * TERMS).reshape(n, TERMS).astype(np.float32)


def _length(x: np.ndarray) -> np.ndarray:
    """Of each row; 1 of a zero row."""
    n = np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
    return np.where(n == 0, 1, n)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / _length(x)


class Model:
    """idf, mean, basis: term counts to latent dimensions; vectors, votes: of the labelled rows; curve: slope and offset.

    x, the labelled rows' counts, is overwritten: it is the largest thing that the driver holds."""

    def __init__(self, x: np.ndarray, votes: np.ndarray):
        rng = np.random.default_rng(11)
        self.idf = (np.log((1 + len(x)) / (1 + np.count_nonzero(x, axis=0))) + 1).astype(np.float32)
        c = np.log1p(x, out=x)
        c *= self.idf
        c /= _length(c)
        self.mean = c.mean(0) if len(x) else np.zeros(TERMS, np.float32)
        c -= self.mean
        k = min(DIMENSIONS, *c.shape) if len(x) else 1
        q = rng.standard_normal((TERMS, k + 10)).astype(np.float32)
        for _ in range(5):  # subspace iteration
            q, _ = np.linalg.qr(c.T @ (c @ q)) if len(x) else (q, None)
        if len(x):
            _, _, vt = np.linalg.svd(c @ q, full_matrices=False)
            q = q @ vt.T[:, :k]
        self.basis = q.astype(np.float32)
        self.vectors, self.votes = _unit(c @ self.basis), votes.astype(np.float32)
        self.curve = self._fitted()

    def project(self, x: np.ndarray) -> np.ndarray:
        return _unit((_unit(np.log1p(x) * self.idf) - self.mean) @ self.basis)

    def share(self, cos: np.ndarray) -> np.ndarray:
        """Of the votes, by cosines with all labelled rows."""
        k = min(NEIGHBOURS, len(self.votes))
        near = np.argpartition(-cos, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(cos, near, 1), 1e-3) ** POWER
        return (weight * self.votes[near]).sum(1) / weight.sum(1)

    def _fitted(self, block: int = 512) -> np.ndarray:
        """Slope and offset that make the labels likeliest, given what rows get from all others; held towards (1, 0)."""
        curve, n = np.array([1.0, 0.0]), len(self.votes)
        if n < 2:
            return curve
        own = []
        for i in range(0, n, block):
            cos = self.vectors[i : i + block] @ self.vectors.T
            cos[np.arange(len(cos)), np.arange(i, i + len(cos))] = -1
            own.append(self.share(cos))
        x, y = np.stack([_log_odds(np.concatenate(own)), np.ones(n)], 1), self.votes.astype(np.float64)
        for _ in range(50):  # Newton's method
            p = _logistic(x @ curve)
            curve = curve + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.eye(2), x.T @ (y - p) - (curve - [1, 0]))
        return curve if curve[0] > 0 else np.array([1.0, 0.0])

    def score(self, x: np.ndarray) -> np.ndarray:
        """0.5 without labelled rows."""
        if not len(self.votes):
            return np.full(len(x), 0.5)
        return _logistic(self.curve[0] * _log_odds(self.share(self.project(x) @ self.vectors.T)) + self.curve[1])


def _log_odds(p: np.ndarray) -> np.ndarray:
    return np.log((p + 0.01) / (1.01 - p))


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, patterns: bool = True) -> Model:
    """Labels without an id or a quality, and held-out ones, are left out; without any label every score is 0.5.

    At most `sample` labels of documents that are there are taken, and of rows of docs that have them, where ids repeat, as many: the
    first by hash of id and text.  Only they come to the driver, as counts of terms."""
    ship(docs.sparkSession)
    known = labels.where("doc_id is not null and quality is not null").where(~held_out(F.col("doc_id")))
    known, _ = sized(known.select(F.col("doc_id").alias("__id"), F.col("quality").cast("double").alias("vote")).distinct(), MOST_LABELS)
    here = docs.select("doc_id").join(known, F.col("doc_id") == F.col("__id")).select("__id", "vote").distinct()
    known = staged(here.orderBy(F.xxhash64("__id"), "vote").limit(sample), "op2-labels")
    rows = docs.select("doc_id", "text").join(F.broadcast(known), F.col("doc_id") == F.col("__id")).select("vote", "text", F.xxhash64("__id", "text").alias("place"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, x in terms(b.column(1), patterns):
                packed = [np.flatnonzero(r).astype("<u2").tobytes() + r[r > 0].astype("<f4").tobytes() for r in x]
                yield pa.RecordBatch.from_arrays([b.column(2).slice(i, j - i), b.column(0).slice(i, j - i), pa.array(packed, pa.binary())], ["place", "vote", "x"])

    got = rows.mapInArrow(run, "place bigint, vote double, x binary").orderBy("place", "vote").limit(sample).collect()
    got.sort(key=lambda r: (r["place"], r["vote"], bytes(r["x"])))  # the same model whatever order tasks end in
    x = np.zeros((len(got), TERMS), np.float32)
    for own, r in zip(x, got, strict=True):
        n = len(r["x"]) // 6
        own[np.frombuffer(r["x"], "<u2", n)] = np.frombuffer(r["x"], "<f4", n, 2 * n)
    return Model(x, np.array([r["vote"] for r in got]))


def with_scores(docs: DataFrame, model: Model, name: str = "__score") -> DataFrame:
    """docs and a double column `name`, 0 to 1; a column of that name is replaced.  Null and empty texts have the zero vector, and a score like any other.  Rows may repeat, ids may be null."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        # only the text goes to Python and only the score comes back
        for text in texts:
            scores = [shared.value.score(x) for _, _, x in terms(text)]
            yield pa.array(np.concatenate(scores) if scores else np.zeros(0), pa.float64())
        give_back()

    return docs.drop(name).withColumn(name, score("text"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = with_scores(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= THRESHOLD).cast("int").alias("predicted"))

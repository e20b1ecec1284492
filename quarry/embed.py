"""Embedding backends.

An Embedder turns a list of texts into unit vectors.  Backends are made inside the Python worker, once each, from a name.
The built-in one hashes terms: it is lexical, not semantic, needs no model file and gives the same vectors everywhere.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.workers import ship


#: Terms whose places a worker remembers at most.
MOST_TERMS = 100_000
#: Rows whose texts are strings in Python at once.
ROWS = 256


class Embedder(Protocol):
    def encode(self, texts: list[str]) -> np.ndarray: ...


class HashingEmbedder:
    """Term counts in dim buckets (md5 of the term), signed, of length one; texts without terms are zero."""

    def __init__(self, dim: int = 64):
        self.dim, self.known = dim, {}

    def _bucket(self, term: str) -> tuple[int, int]:
        if term not in self.known:
            if len(self.known) >= MOST_TERMS:
                self.known.clear()
            h = int.from_bytes(hashlib.md5(term.encode()).digest()[:8], "little")  # noqa: S324
            self.known[term] = (h % self.dim, 1 if h >> 63 else -1)
        return self.known[term]

    def encode(self, texts: list[str] | str) -> np.ndarray:
        texts = [texts] if isinstance(texts, str) else texts
        out = np.zeros((len(texts), self.dim), np.float32)
        for row, text in zip(out, texts, strict=True):
            for t in re.findall("[a-z0-9_]+", (text or "").lower()):
                at, sign = self._bucket(t)
                row[at] += sign
        return normalized(out)


def normalized(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n == 0, 1, n)


def mean_pooled(hidden: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Mean over the tokens of (batch, token, dim) that the mask keeps."""
    m = mask[..., None].astype(hidden.dtype)
    return (hidden * m).sum(1) / np.maximum(m.sum(1), 1e-9)


BACKENDS: dict[str, Callable[[], Embedder]] = {"hashing": HashingEmbedder, "hashing-256": lambda: HashingEmbedder(256)}
_made: dict[str, Embedder] = {}


def backend(name: str) -> Embedder:
    """One for each Python process."""
    if name not in BACKENDS:
        raise KeyError(f"no embedding backend {name!r}; there are {sorted(BACKENDS)}")
    if name not in _made:
        _made[name] = BACKENDS[name]()
    return _made[name]


def cache_info() -> dict:
    """Backends that this Python process has made, and how many."""
    return {"backends": sorted(_made), "n": len(_made)}


def embed(df: DataFrame, name: str = "hashing", text: str = "text", batch: int = 16) -> DataFrame:
    """df with a column embedding (array<float>).  Of ROWS texts those of like length are a batch; no more of them are held at once beside Spark's own batch."""
    ship(df.sparkSession)
    if "embedding" in df.columns:
        df = df.drop("embedding")
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in df.schema.fields)}, embedding array<float>"
    place = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = backend(name)
        for b in batches:
            for lo in range(0, len(b), ROWS):
                own = b.slice(lo, ROWS)
                order = np.argsort(pc.fill_null(pc.binary_length(own.column(place)), 0).to_numpy(zero_copy_only=False), kind="stable")
                texts = own.column(place).to_pylist()
                found = [model.encode([texts[j] for j in order[i : i + batch]]) for i in range(0, len(order), batch)]
                vectors = np.concatenate(found).astype(np.float32)[np.argsort(order)]
                width = vectors.shape[1]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(vectors) + 1, dtype=np.int32) * width), pa.array(vectors.ravel()))
                yield pa.RecordBatch.from_arrays([*own.columns, lists], [*own.schema.names, "embedding"])

    return df.mapInArrow(run, schema)

"""Exact vector search by squared Euclidean distance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions.vectors import squared_l2
from quarry.operators.grid import grid
from quarry.workers import ship

#: Queries that are sent to every task at most; more meet the vectors in a grid.
BLOCK = 1024
#: Distances of queries and vectors that a task holds at once.
CELLS = 1_000_000


def matrices(column: pa.ListArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Of each length: rows of the column that have it, and their numbers; null lists are left out."""
    size = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    flat, ends = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64), np.cumsum(np.maximum(size, 0))
    out = {}
    for dim in np.unique(size[size > 0]).tolist():
        rows = np.flatnonzero(size == dim)
        out[dim] = rows, flat[(ends[rows] - dim)[:, None] + np.arange(dim)]
    return out


def stretches(n: int, width: int) -> Iterator[slice]:
    """Of n rows, parts that have CELLS numbers at most where a row has `width`; a row at least."""
    step = max(1, CELLS // max(1, width))
    for lo in range(0, n, step):
        yield slice(lo, min(lo + step, n))


class Nearest:
    """The k nearest vectors of each of some queries.  A matrix product picks candidates; exact distances come from the
    differences; a matrix has CELLS numbers, whatever the number of queries.  Vectors of another length than a query's are not near it, whatever they hold."""

    def __init__(self, ids: np.ndarray, vectors: pa.ListArray, k: int):
        self.k = k
        self.parts = {dim: [ids[rows], q, np.full((len(rows), k), np.inf), np.zeros((len(rows), k), np.int64)] for dim, (rows, q) in matrices(vectors).items()}

    def add(self, items: pa.RecordBatch) -> None:
        ids, found = items.column(0).to_numpy(), matrices(items.column(1))
        for dim, part in self.parts.items():
            if dim in found:
                rows, v = found[dim]
                for at in stretches(len(part[1]), len(v)):
                    part[2][at], part[3][at] = self._nearer(part[1][at], part[2][at], part[3][at], ids[rows], v)

    def _nearer(self, q: np.ndarray, best_d: np.ndarray, best_i: np.ndarray, own: np.ndarray, v: np.ndarray) -> list[np.ndarray]:
        rough = (q * q).sum(1)[:, None] + (v * v).sum(1)[None, :] - 2 * q @ v.T
        m = min(len(v), self.k + 8)
        pick = np.argpartition(rough, m - 1, axis=1)[:, :m]
        edge = np.take_along_axis(rough, pick, 1).max(1)
        close = rough <= edge[:, None] + 1e-9  # ties at the edge stay, whatever the partition picked
        most = int(close.sum(1).max())
        pick = np.argsort(~close, axis=1, kind="stable")[:, :most]
        exact = np.stack([((v[p] - x) ** 2).sum(1) for x, p in zip(q, pick, strict=True)])
        exact[~np.take_along_axis(close, pick, 1)] = np.inf
        d, i = np.concatenate([best_d, exact], 1), np.concatenate([best_i, own[pick]], 1)
        keep = np.lexsort((i, d), axis=1)[:, : self.k]
        return [np.take_along_axis(d, keep, 1), np.take_along_axis(i, keep, 1)]

    def hits(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        out = [(np.repeat(ids, d.shape[1])[np.isfinite(d).ravel()], i[np.isfinite(d)], d[np.isfinite(d)]) for ids, _, d, i in self.parts.values()]
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def top_one(vectors: DataFrame, query: list[float], k: int) -> DataFrame:
    """id, distance, score, dense_rank of the k nearest of vectors (id, embedding) to one query, without leaving the JVM."""
    near = vectors.select("id", squared_l2(F.col("embedding"), F.array(*map(F.lit, query))).alias("distance")).orderBy("distance", "id").limit(k)
    return ranked(near.withColumn("query_id", F.lit(0).cast("long"))).drop("query_id")


def ranked(near: DataFrame) -> DataFrame:
    order = W.partitionBy("query_id").orderBy("distance", "id")
    return near.select("query_id", "id", "distance", (1.0 - F.col("distance")).alias("score"), F.row_number().over(order).alias("dense_rank"))


def top(vectors: DataFrame, queries: DataFrame, k: int, few: int = BLOCK) -> DataFrame:
    """query_id, id, distance, score, dense_rank of the k nearest vectors of each of queries (query_id, embedding).

    Up to `few` queries are sent to every task, and the vectors stay where they are; more, whatever their number, meet the vectors in
    a grid, of which they are the rows, by one scan of the vectors.  Either way k hits a query leave a task.  Queries and vectors
    without an embedding are left out; k <= 0 finds nothing."""
    spark = vectors.sparkSession
    ship(spark)
    asked = queries.where("embedding is not null").select(F.col("query_id").cast("long").alias("id"), F.col("embedding").cast("array<float>").alias("embedding"))
    own = vectors.where("embedding is not null").select(F.col("id").cast("long").alias("id"), F.col("embedding").cast("array<float>").alias("embedding"))
    k = max(0, k)
    head = asked.limit(few + 1).toArrow()
    if len(head) > few:
        found = grid(asked, own, asked.count(), lambda _, q: Nearest(q.column(0).to_numpy(), q.column(1).combine_chunks(), k))
    else:
        shared = spark.sparkContext.broadcast((head.column(0).to_numpy(), head.column(1).combine_chunks()))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            work = Nearest(*shared.value, k)
            for b in batches:
                if len(b):
                    work.add(b)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in work.hits()], ["query_id", "id", "value"])

        found = own.mapInArrow(run, "query_id bigint, id bigint, value double")
    return ranked(found.select("query_id", "id", F.col("value").alias("distance"))).where(F.col("dense_rank") <= k)

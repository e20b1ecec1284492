"""An inverted-file index of vectors: k-means cells, product-quantized codes, probes of the nearest cells, exact rerank.

Cells are found by Lloyd steps whose sums are made in tasks, over all vectors or, beyond TRAIN of them, a sample by hash; every
vector is indexed.  The index is a table by cell, so that a search reads the files of the cells it probes and no others, and of these the
codes only; the vectors of the few candidates are read after that.  Centroids, radii and codebooks are a few numbers a cell: they
are the only things that the driver and all tasks hold, MOST_CELLS of them at most.

search() probes as many cells as a bounded sample of vectors needed for nearly all of its neighbours.  search_exact() takes the distances it finds as a threshold and then scans each cell that
may hold something nearer, by the triangle inequality: its hits are those of a scan of all vectors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions.vectors import squared_l2
from quarry.operators.dense import Nearest, matrices, ranked, stretches, top
from quarry.operators.grid import QUERIES, met
from quarry.workers import ship

MOST_CELLS, TRAIN, STEPS = 4096, 262_144, 6
#: Parts that a vector's code has, values of each, vectors that codebooks are fitted on at most.
PARTS, VALUES, CODED = 8, 256, 16_384
#: Vectors that the number of probes is tuned on, and the share of their ten neighbours that it must reach.
TUNED, RECALL = 200, 0.985
#: Vectors of a cell that one task's stream reads; more are dealt to several.
BLOCK = 65_536
#: Pairs of a query and a cell that leave a task at once.
PROBED = 16_384
CELL = "id bigint, embedding array<float>, cell int, code binary"


def nearest_cells(v: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of each vector to each centroid."""
    return np.maximum((v * v).sum(1)[:, None] + (centroids * centroids).sum(1)[None, :] - 2 * v @ centroids.T, 0)


def nearest_cell(v: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The nearest centroid of each vector."""
    return np.concatenate([np.zeros(0, np.int64), *[nearest_cells(v[at], centroids).argmin(1) for at in stretches(len(v), len(centroids))]])


def pairs(q: np.ndarray, centroids: np.ndarray, n: np.ndarray, radius: np.ndarray, most: int, reach: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers of vectors and of their `most` nearest cells of those that hold any (n), PROBED of them at a time; with reach, of all that may hold something so near."""
    m = min(most, int((n > 0).sum()))
    for at in stretches(len(q), len(centroids)):
        far = nearest_cells(q[at], centroids)
        far[:, n == 0] = np.inf
        if reach is not None:
            own, cell = np.nonzero(np.isfinite(far) & (np.sqrt(far) - radius[None, :] <= np.sqrt(reach[at])[:, None] + 1e-6))
        else:
            cell = np.argsort(far, 1, kind="stable")[:, :m].ravel()
            own = np.repeat(np.arange(len(far)), m)
        for lo in range(0, len(own), PROBED):
            yield at.start + own[lo : lo + PROBED], cell[lo : lo + PROBED]


def lloyd_step(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Means of the vectors nearest to each centroid; one without any stays.  Tasks pass on a sum for each cell."""
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        total, n = np.zeros(c.shape), np.zeros(len(c), np.int64)
        for b in batches:
            for dim, (_, v) in matrices(b.column(0)).items():
                if dim == c.shape[1]:
                    own = nearest_cell(v, c)
                    np.add.at(total, own, v)
                    n += np.bincount(own, minlength=len(c))
        has = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(has.astype(np.int32)), pa.array(n[has]), pa.array(list(total[has]), pa.list_(pa.float64()))], ["cell", "n", "total"])

    sums = vectors.select("embedding").mapInArrow(run, "cell int, n bigint, total array<double>")
    each = sums.select("cell", "n", F.posexplode("total").alias("i", "x")).groupBy("cell", "i").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    out = centroids.copy()
    for r in each.groupBy("cell").agg(F.array_sort(F.collect_list(F.struct("i", (F.col("x") / F.col("n")).alias("x")))).alias("m")).collect():  # a row a cell
        out[r["cell"]] = [m["x"] for m in r["m"]]
    return out


def codebook(v: np.ndarray, values: int = VALUES, steps: int = 8) -> np.ndarray:
    """k-means of one part of residuals; fewer values where there are fewer different vectors."""
    c = np.unique(v, axis=0)
    c = c[np.linspace(0, len(c) - 1, min(values, len(c))).astype(int)] if len(c) else np.zeros((1, v.shape[1]))
    for _ in range(steps if len(v) else 0):
        own = nearest_cells(v, c).argmin(1)
        n = np.bincount(own, minlength=len(c))
        total = np.zeros(c.shape)
        np.add.at(total, own, v)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
    return c


class Coded:
    """The `k` vectors of one cell that are nearest to each query by their codes: distances of parts come from a table a query."""

    def __init__(self, ids: np.ndarray, residuals: np.ndarray, books: list[np.ndarray], k: int):
        self.ids, self.k = ids, k
        self.tables, at = [], 0
        for book in books:
            self.tables.append(nearest_cells(residuals[:, at : at + book.shape[1]], book))
            at += book.shape[1]
        self.d, self.i = np.full((len(ids), k), np.inf), np.zeros((len(ids), k), np.int64)

    def add(self, items: pa.RecordBatch) -> None:
        own = items.column(0).to_numpy()
        codes = np.frombuffer(b"".join(items.column(2).to_pylist()), np.uint8).reshape(len(own), -1)
        for at in stretches(len(self.ids), len(own)):
            d = sum(t[at][:, codes[:, j]] for j, t in enumerate(self.tables))
            d, i = np.concatenate([self.d[at], d], 1), np.concatenate([self.i[at], np.broadcast_to(own, d.shape)], 1)
            keep = np.lexsort((i, d), axis=1)[:, : self.k]
            self.d[at], self.i[at] = np.take_along_axis(d, keep, 1), np.take_along_axis(i, keep, 1)

    def hits(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        found = np.isfinite(self.d)
        return np.repeat(self.ids, found.sum(1)), self.i[found], self.d[found]


class VectorIndex:
    """Below `base`: vectors/cell=N (id, embedding, code), cells (cell, n, radius, centroid), books (part, values)."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")
        ship(spark)

    # -- building

    def build(self, vectors: DataFrame, cells: int | None = None, steps: int = STEPS) -> None:
        """Indexes vectors (id, embedding).  Those without an embedding, and of another length than most, are left out."""
        own = vectors.where("id is not null and size(embedding) > 0").select(F.col("id").cast("long").alias("id"), F.col("embedding").cast("array<float>").alias("embedding"))
        sizes = own.groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").first()
        dim, n = (sizes["dim"], sizes["n"]) if sizes else (1, 0)
        own = own.where(F.size("embedding") == dim)
        h = F.xxhash64("id")
        learnt = own.where(F.pmod(h, F.lit(max(1, n // TRAIN))) == 0)
        k = min(MOST_CELLS, cells or max(1, math.isqrt(n)))
        c = np.array([r["embedding"] for r in learnt.orderBy(h, "id").limit(k).collect()], np.float64).reshape(-1, dim)
        for _ in range(steps if len(c) else 0):
            c = lloyd_step(learnt, c)
        c = c if len(c) else np.zeros((1, dim))
        some = [np.array(r["embedding"], np.float64) for r in learnt.orderBy(F.xxhash64("id", F.lit(1)), "id").limit(CODED).collect()]
        some = np.array(some).reshape(-1, dim)
        residuals = some - c[nearest_cell(some, c)]
        books = [codebook(x) for x in np.array_split(residuals, min(PARTS, dim), axis=1)]
        self._write(own, c, books)
        self._tuned(own.select("id", "embedding"))

    def _tuned(self, own: DataFrame) -> None:
        """Writes how many cells hold RECALL of the neighbours of TUNED vectors, by hash: what search() probes."""
        asked = own.orderBy(F.xxhash64("id", F.lit(2)), "id").limit(TUNED).withColumnRenamed("id", "query_id")
        held = self.spark.read.schema(CELL).parquet(f"{self.base}/vectors").select("id", "cell")
        near = top(own, asked, 11).where("id <> query_id").join(held, "id").select("query_id", "cell").join(asked, "query_id").select("embedding", "cell").collect()  # TUNED times ten rows
        c = self.meta[0]
        far = nearest_cells(np.array([r["embedding"] for r in near], np.float64).reshape(-1, c.shape[1]), c)
        ranks = np.sort((far < np.take_along_axis(far, np.array([r["cell"] for r in near], np.int64)[:, None], 1)).sum(1) + 1) if near else np.ones(1, np.int64)
        probes = int(ranks[min(len(ranks) - 1, math.ceil(RECALL * len(ranks)))])
        self.spark.createDataFrame([(probes,)], "probes int").write.mode("overwrite").parquet(f"{self.base}/tuned")

    @cached_property
    def probed(self) -> int:
        return self.spark.read.parquet(f"{self.base}/tuned").first()["probes"]

    def _write(self, own: DataFrame, c: np.ndarray, books: list[np.ndarray]) -> None:
        shared = self.spark.sparkContext.broadcast((c, books))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            c, books = shared.value
            for b in batches:
                v = np.asarray(b.column(1).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(b), c.shape[1])
                cell = nearest_cell(v, c)
                rest, at, code = v - c[cell], 0, []
                for book in books:
                    code.append(nearest_cells(rest[:, at : at + book.shape[1]], book).argmin(1).astype(np.uint8))
                    at += book.shape[1]
                packed = np.stack(code, 1)
                distance = np.sqrt(((v - c[cell]) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cell.astype(np.int32)), pa.array([x.tobytes() for x in packed], pa.binary()), pa.array(distance)], ["id", "embedding", "cell", "code", "distance"])

        coded = own.select("id", "embedding").mapInArrow(run, CELL + ", distance double")
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        part = F.pmod(F.xxhash64("id"), F.lit(max(1, n // 8)))  # a hot cell is written by several tasks
        coded.repartition(n, "cell", part).sortWithinPartitions("cell").write.mode("overwrite").partitionBy("cell").parquet(f"{self.base}/vectors")
        table = self.spark.read.schema(CELL + ", distance double").parquet(f"{self.base}/vectors")
        stats = {r["cell"]: (r["n"], r["radius"]) for r in table.groupBy("cell").agg(F.count("*").alias("n"), F.max("distance").alias("radius")).collect()}
        rows = [(i, *stats.get(i, (0, 0.0)), x.tolist()) for i, x in enumerate(c)]
        self.spark.createDataFrame(rows, "cell int, n bigint, radius double, centroid array<double>").write.mode("overwrite").parquet(f"{self.base}/cells")
        self.spark.createDataFrame([(j, x.tolist()) for j, x in enumerate(books)], "part int, book array<array<double>>").write.mode("overwrite").parquet(f"{self.base}/books")

    # -- searching

    @cached_property
    def meta(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
        """Centroids, numbers of vectors, radii, codebooks."""
        rows = self.spark.read.parquet(f"{self.base}/cells").orderBy("cell").collect()
        books = [np.array(r["book"]) for r in self.spark.read.parquet(f"{self.base}/books").orderBy("part").collect()]
        return np.array([r["centroid"] for r in rows]), np.array([r["n"] for r in rows]), np.array([r["radius"] for r in rows]), books

    def vectors(self, cells: list[int]) -> DataFrame:
        """id, embedding, code, cell of these cells: the files of no others are read."""
        return self.spark.read.schema(CELL).parquet(f"{self.base}/vectors").where(F.col("cell").isin(cells) if cells else F.lit(False))

    def probes(self, queries: DataFrame, most: int, within: bool = False) -> DataFrame:
        """id, embedding, cell of the `most` nearest cells of each query that hold vectors; within: of all that may hold something at a distance of at most the column `reach`."""
        shared, names = self.spark.sparkContext.broadcast(self.meta[:3]), ["id", "embedding", *(["reach"] if within else [])]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            c, n, radius = shared.value
            for b in batches:
                for dim, (rows, q) in matrices(b.column(1)).items():
                    if dim != c.shape[1] or not n.any():
                        continue
                    for own, cell in pairs(q, c, n, radius, most, b.column(2).to_numpy()[rows] if within else None):
                        part = b.take(pa.array(rows[own]))
                        yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(cell.astype(np.int32))], ["id", "embedding", "cell"])

        return queries.select(*names).mapInArrow(run, "id bigint, embedding array<float>, cell int")

    def _met(self, asked: DataFrame, items: list[str], kernel) -> tuple[DataFrame, list[int]]:  # noqa: ANN001
        """Hits of the kernel of each cell over its vectors, and the cells.  Cells with many vectors or many queries are dealt to several tasks."""
        counts = {r["cell"]: r["count"] for r in asked.groupBy("cell").count().collect()}  # a row a cell
        n = self.meta[1]
        shape = {c: (-(-k // QUERIES), max(1, -(-int(n[c]) // BLOCK))) for c, k in counts.items()}
        wide = {c: s for c, s in shape.items() if s != (1, 1)}

        def side(df: DataFrame, own: int) -> DataFrame:
            parts = []
            for i in (own, 1 - own):
                sizes = F.create_map(*[F.lit(x) for c, s in wide.items() for x in (c, s[i])]) if wide else None
                parts.append(F.coalesce(F.try_element_at(sizes, F.col("cell")), F.lit(1)) if wide else F.lit(1))
            mine, other = F.pmod(F.xxhash64("id"), parts[0]), F.explode(F.sequence(F.lit(0), parts[1] - 1))
            df = df.withColumns({"__mine": mine, "__other": other})
            a, b = ("__mine", "__other") if own == 0 else ("__other", "__mine")
            return df.withColumn("key", (F.col("cell").cast("bigint") * 1_000_000 + F.col(a) * 1000 + F.col(b)).cast("bigint")).drop("__mine", "__other")

        none = [F.lit(None).cast(kind).alias(name) for name, kind in (("embedding", "array<float>"), ("code", "binary"))]
        of = lambda have: [F.col("id"), *[F.col(x) if x in have else next(c for c, name in zip(none, ("embedding", "code"), strict=True) if name == x) for x in ("embedding", "code")]]
        queries = side(asked, 0).select("key", "cell", *of(["embedding"]))
        vectors = side(self.vectors(sorted(counts)).select("id", "cell", *items), 1).select("key", "cell", *of(items))
        return met(queries, vectors, kernel), sorted(counts)

    def search(self, queries: DataFrame, k: int, probes: int | None = None, rerank: int = 20) -> DataFrame:
        """query_id, id, distance, score, dense_rank of the k nearest vectors found for each of queries (query_id, embedding) in `probes` cells, or as many as were tuned: of the rerank * k best by code, the best by distance."""
        c, _, _, books = self.meta
        asked = self._staged(self.probes(self._asked(queries), probes or self.probed), "probes")
        shared, most = self.spark.sparkContext.broadcast((c, books)), max(1, rerank * k)

        def kernel(cell: int, q: pa.Table) -> Coded:
            c, books = shared.value
            vectors = np.asarray(q.column(1).combine_chunks().flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(q), -1)
            return Coded(q.column(0).to_numpy(), vectors - c[cell], books, most)

        found, cells = self._met(asked, ["code"], kernel)
        best = found.withColumn("r", F.row_number().over(W.partitionBy("query_id").orderBy("value", "id"))).where(F.col("r") <= most).select("query_id", "id")
        best = self._staged(best, "candidates")
        near = best.join(self.vectors(cells).select("id", "embedding"), "id").join(queries.select("query_id", F.col("embedding").alias("__q")), "query_id")
        return ranked(near.select("query_id", "id", squared_l2(F.col("embedding"), F.col("__q")).alias("distance"))).where(F.col("dense_rank") <= k)

    def search_exact(self, queries: DataFrame, k: int, probes: int = 4) -> DataFrame:
        """What a scan of all vectors finds.  The kth distance in `probes` cells is how far a query reaches; without k hits there, everywhere."""
        asked = self._asked(queries)
        first, _ = self._met(self._staged(self.probes(asked, probes), "probes"), ["embedding"], lambda _, q: Nearest(q.column(0).to_numpy(), q.column(1).combine_chunks(), k))
        kth = ranked(first.select("query_id", "id", F.col("value").alias("distance"))).where(F.col("dense_rank") == k).select(F.col("query_id").alias("id"), F.col("distance").alias("reach"))
        reaching = asked.join(kth, "id", "left").withColumn("reach", F.coalesce("reach", F.lit(float("inf"))))
        every, _ = self._met(self._staged(self.probes(reaching, 0, True), "reaches"), ["embedding"], lambda _, q: Nearest(q.column(0).to_numpy(), q.column(1).combine_chunks(), k))
        return ranked(every.select("query_id", "id", F.col("value").alias("distance"))).where(F.col("dense_rank") <= k)

    @staticmethod
    def _asked(queries: DataFrame) -> DataFrame:
        return queries.where("embedding is not null").select(F.col("query_id").cast("long").alias("id"), F.col("embedding").cast("array<float>").alias("embedding"))

    def _staged(self, df: DataFrame, name: str) -> DataFrame:
        """df as a table beside the index: counted, then read again, by whoever searches."""
        import uuid

        path = f"{self.base}/scratch/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

"""Many queries against many items, as streams of grid cells.

Queries and items are dealt to cells by the caller; a cell's task reads its queries first, which are few, and then its items in
batches.  A kernel made of the queries takes the batches and keeps what it needs: k hits a query, so that neither the task's memory nor
what it passes on grows with the items.  Nothing goes through the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.workers import ship

#: Queries of a cell at most, where grid() deals them.
QUERIES = 4096
HITS = "query_id bigint, id bigint, value double"


class Kernel(Protocol):
    def add(self, items: pa.RecordBatch) -> None: ...

    def hits(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """query ids, item ids, values."""


def met(queries: DataFrame, items: DataFrame, kernel: Callable[[int, pa.Table], Kernel]) -> DataFrame:
    """HITS of kernel(cell, its queries) over its items.  queries: key, cell, id, and others; items: key, cell, and the same columns.

    key: of the cell's task; cell: a number that the kernel is told."""
    spark = queries.sparkSession
    ship(spark)
    columns = ["id", *[c for c in queries.columns if c not in ("key", "cell", "id")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, asked, work = None, [], None

        def done() -> Iterator[pa.RecordBatch]:
            if work is not None:
                q, i, v = work.hits()
                yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(i, pa.int64()), pa.array(v, pa.float64())], ["query_id", "id", "value"])

        for b in batches:
            key, cell, kind = (b.column(i).to_numpy() for i in range(3))
            edges = (np.flatnonzero((key[1:] != key[:-1]) | (kind[1:] != kind[:-1])) + 1).tolist()
            for lo, hi in zip([0, *edges], [*edges, len(b)], strict=True):
                if hi == lo:
                    continue
                if key[lo] != now:
                    yield from done()
                    now, asked, work = key[lo], [], None
                part = b.slice(lo, hi - lo).select(range(3, b.num_columns))
                if kind[lo] == 0:
                    asked.append(part)
                elif asked:
                    work = work or kernel(int(cell[lo]), pa.Table.from_batches(asked))
                    work.add(part)
        yield from done()

    side = lambda df, kind: df.select("key", "cell", F.lit(kind).alias("kind"), *columns)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    both = side(queries, 0).unionByName(side(items, 1)).repartition(n, "key").sortWithinPartitions("key", "kind")
    return both.mapInArrow(run, HITS)


def dealt(df: DataFrame, own: Column, n_own: int, n_other: int, by_row: bool) -> DataFrame:
    """df with key and cell of a grid: its rows by `own` in n_own parts, each there for all n_other parts of the other side."""
    other = F.explode(F.sequence(F.lit(0), F.lit(n_other - 1)))
    out = df.withColumns({"__own": F.pmod(F.xxhash64(own), F.lit(n_own)), "__other": other})
    row, column = ("__own", "__other") if by_row else ("__other", "__own")
    return out.withColumns({"key": (F.col(row) * (n_other if by_row else n_own) + F.col(column)).cast("bigint"), "cell": F.lit(0)}).drop("__own", "__other")


def grid(queries: DataFrame, items: DataFrame, n_queries: int, kernel: Callable[[int, pa.Table], Kernel]) -> DataFrame:
    """HITS of queries (id, ...) and items (id, the same columns), every query against every item, the kernel's hits of each cell.

    n_queries decides on the number of rows, QUERIES to each; there are as many columns as fill the shuffle's partitions.  An item is
    read once and sent to each row of the grid."""
    rows = max(1, -(-n_queries // QUERIES))
    columns = max(1, -(-int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions")) // rows))
    return met(dealt(queries, F.col("id"), rows, columns, True), dealt(items, F.col("id"), columns, rows, False), kernel)

"""The engine's functions for SQL users: register(spark), then

    SELECT quarry_tokenize(text), c.* FROM files, LATERAL quarry_chunk_lines(text, 50, 5) c
    SELECT * FROM quarry_fuse(k => 60, top_k => 10, hits => TABLE(hits) PARTITION BY query_id ORDER BY rank)
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructType

from quarry.operators.chunking import python_symbols
from quarry.workers import ship


@udtf(returnType="chunk_idx int, text string, line_start int, line_end int")
class ChunkLines:
    def eval(self, text: str, size: int, overlap: int) -> Iterator[tuple]:
        lines, step = (text or "").splitlines(), max(1, size - overlap)
        for k, i in enumerate(range(0, len(lines), step)):
            end = min(i + size, len(lines))
            yield k, "\n".join(lines[i:end]), i + 1, end


@udtf(returnType="chunk_idx int, text string, type string, name string, line_start int, line_end int")
class ChunkSymbols:
    """Symbols of Python source; none where it doesn't parse."""

    def eval(self, text: str) -> Iterator[tuple]:
        try:
            found = python_symbols(text or "")
        except (SyntaxError, ValueError, RecursionError):
            return
        for k, (body, kind, name, first, last, _, _) in enumerate(found):
            yield k, body, kind, name, first, last


@udtf
class Fuse:
    """Reciprocal rank fusion of both lists of each query: hits (query_id, id, side: dense or sparse, rank), k, top_k.

    The table is dealt by query and comes in the order of ranks; what one query has is two lists of hits, and is held."""

    def __init__(self) -> None:
        self.query, self.ranks = None, {"dense": {}, "sparse": {}}

    @staticmethod
    def analyze(hits: AnalyzeArgument, k: AnalyzeArgument | None = None, top_k: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not hits.isTable:
            raise ValueError("hits is a table")
        missing = {"query_id", "id", "side", "rank"} - set(hits.dataType.fieldNames())
        if missing:
            raise ValueError(f"the table has no {sorted(missing)}")
        out = StructType().add("query_id", LongType()).add("id", LongType()).add("score", DoubleType()).add("rank", IntegerType())
        return AnalyzeResult(schema=out)

    def eval(self, hits: Row, k: int = 60, top_k: int = 10) -> None:
        self.query, self.k, self.top_k = hits["query_id"], k, top_k
        own = self.ranks[hits["side"]]
        if hits["side"] == "dense" or hits["id"] not in own:  # of an id's ranks the last in the dense list, the first in the sparse one
            own[hits["id"]] = hits["rank"]

    def terminate(self) -> Iterator[tuple]:
        if self.query is None:
            return
        d, s = self.ranks["dense"], self.ranks["sparse"]
        part = lambda own, i: 1 / (self.k + own[i]) if i in own else 0.0
        far = float("inf")
        best = sorted(((part(d, i) + part(s, i), i) for i in d.keys() | s.keys()), key=lambda x: (-x[0], d.get(x[1], far), s.get(x[1], far)))
        for rank, (score, i) in enumerate(best[: self.top_k], 1):
            yield self.query, i, score, rank


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.udtf.register("quarry_chunk_lines", ChunkLines)
    spark.udtf.register("quarry_chunk_symbols", ChunkSymbols)
    spark.udtf.register("quarry_fuse", Fuse)
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION quarry_tokenize(t STRING) RETURNS ARRAY<STRING> RETURN filter(regexp_extract_all(lower(t), '[a-z0-9_]+', 0), x -> length(x) >= 2)")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION quarry_squared_l2(a ARRAY<FLOAT>, b ARRAY<FLOAT>) RETURNS DOUBLE RETURN aggregate(zip_with(a, b, (x, y) -> (CAST(x AS DOUBLE) - CAST(y AS DOUBLE)) * (CAST(x AS DOUBLE) - CAST(y AS DOUBLE))), CAST(0 AS DOUBLE), (s, x) -> s + x)")

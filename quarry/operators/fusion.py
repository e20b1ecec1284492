"""Reciprocal rank fusion, and hybrid search composed of both sides."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.operators import bm25, dense

K, OVERFETCH = 60, 2


def _fused(dense_hits: DataFrame, sparse_hits: DataFrame, k: int) -> DataFrame:
    """All hits of both lists: query_id, id, dense_rank, near (the dense score), sparse_rank, score, rank."""
    near = F.max("score") if "score" in dense_hits.columns else F.lit(None).cast("double")
    d = dense_hits.groupBy("query_id", "id").agg(F.max("dense_rank").alias("dense_rank"), near.alias("near"))
    s = sparse_hits.groupBy("query_id", "id").agg(F.min("sparse_rank").alias("sparse_rank"))
    part = lambda c: F.coalesce(F.lit(1.0) / (F.lit(k) + F.col(c)), F.lit(0.0))
    both = d.join(s, ["query_id", "id"], "full_outer").withColumn("score", part("dense_rank") + part("sparse_rank"))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("dense_rank"), "sparse_rank")
    return both.withColumn("rank", F.row_number().over(order))


def fuse(dense_hits: DataFrame, sparse_hits: DataFrame, k: int = K, top_k: int = 10) -> DataFrame:
    """query_id, id, score, dense_rank, sparse_rank, rank: 1 / (k + rank) of both lists, summed.

    Of an id's ranks in the dense list the last counts, in the sparse list the first.  Equal scores go by dense rank, then
    by sparse rank.  The cut to top_k comes before any look-up."""
    return _fused(dense_hits, sparse_hits, k).where(F.col("rank") <= top_k).drop("near")


def looked_up(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Hits with their chunks' columns; hits without a chunk go, so that fewer than top_k may stay."""
    return hits.join(chunks, "id")


def hybrid_search(chunks: DataFrame, vectors: DataFrame, texts: DataFrame, queries: DataFrame, top_k: int = 5, k: int = K, sparse: DataFrame | None = None) -> DataFrame:
    """query_id, id, score, dense_rank, sparse_rank, rank, search_type, and the chunk's columns.

    chunks: id, text, ...; vectors: id, embedding; texts: query_id, text; queries: query_id, embedding.  A query without any
    sparse hit gets its first top_k dense hits, with 1 - distance as the score.  sparse: hits of texts, where an index has them."""
    near = dense.top(vectors, queries, OVERFETCH * top_k)
    if sparse is None:
        sparse = bm25.top_batch(bm25.tokens(chunks), texts, OVERFETCH * top_k)
    has = F.max(F.col("sparse_rank").isNotNull()).over(W.partitionBy("query_id"))  # each side is searched once
    hits = _fused(near, sparse, k).withColumn("has", has)
    hits = hits.select("query_id", "id", F.when(F.col("has"), F.col("score")).otherwise(F.col("near")).alias("score"), "dense_rank", "sparse_rank", F.when(F.col("has"), F.col("rank")).otherwise(F.col("dense_rank")).alias("rank"), F.when(F.col("has"), "hybrid_rrf").otherwise("dense_only").alias("search_type"))
    return looked_up(hits.where(F.col("rank") <= top_k), chunks)

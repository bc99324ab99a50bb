"""Reciprocal rank fusion, and the test for a lexical result that needs no second opinion."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60
STRONG_RATIO = 3.0


def fuse(bm25: DataFrame, near: DataFrame, k: int = RRF_K, top_k: int | None = None) -> DataFrame:
    """bm25 (chunk_id, score, rank), near (chunk_id, distance, rank) -> (chunk_id, rrf_score, bm25_score, bm25_rank, vector_distance, vector_rank, rank).

    A union and one aggregation of two short lists; ties go by id.
    """
    k = k if k > 0 else RRF_K
    none = lambda kind: F.lit(None).cast(kind)
    a = bm25.select("chunk_id", F.col("score").alias("bm25_score"), F.col("rank").alias("bm25_rank"), none("double").alias("vector_distance"), none("int").alias("vector_rank"), "rank")
    b = near.select("chunk_id", none("double").alias("bm25_score"), none("int").alias("bm25_rank"), F.col("distance").alias("vector_distance"), F.col("rank").alias("vector_rank"), "rank")
    both = a.unionByName(b).groupBy("chunk_id").agg(F.round(F.sum(1 / (k + F.col("rank"))), 9).alias("rrf_score"), F.max("bm25_score").alias("bm25_score"), F.max("bm25_rank").alias("bm25_rank"), F.max("vector_distance").alias("vector_distance"), F.max("vector_rank").alias("vector_rank"))
    ordered = both.orderBy(F.desc("rrf_score"), "chunk_id")
    ordered = ordered.limit(top_k) if top_k else ordered
    return ordered.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("rrf_score"), "chunk_id")))


def strong_signal(scores: list[float]) -> bool:
    """Whether the best lexical score is over three times the second (both positive)."""
    return len(scores) > 1 and scores[0] > 0 and scores[1] > 0 and scores[0] / scores[1] > STRONG_RATIO

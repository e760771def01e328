"""Fusion of result lists, deduplication and selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.sources.tables import stripped


def rrf(ranked: DataFrame, k: int = 60) -> DataFrame:
    """(query_id, chunk_id, score): sums of 1 / (k + rank) over the sets of a query; a query with one set keeps its raw scores.

    ``ranked`` is (query_id, set_id, chunk_id, rank, score).
    """
    per_query = Window.partitionBy("query_id")
    sets = F.size(F.collect_set("set_id").over(per_query))
    part = F.when(sets == 1, F.col("score")).otherwise(F.lit(1.0) / (F.col("rank") + k))
    return ranked.withColumn("part", part).groupBy("query_id", "chunk_id").agg(F.round(F.sum("part"), 9).alias("score"))


def hybrid_join(semantic: DataFrame, keyword: DataFrame) -> DataFrame:
    """Semantic and keyword scores by query and chunk; a missing one is 0."""
    s = semantic.select("query_id", "chunk_id", F.col("score").alias("semantic_score"))
    w = keyword.select("query_id", "chunk_id", F.col("score").alias("keyword_score"))
    both = s.join(w, ["query_id", "chunk_id"], "full_outer")
    return both.withColumn("is_keyword", F.col("keyword_score").isNotNull()).na.fill(0.0, ["semantic_score", "keyword_score"])


def hybrid_fuse(semantic: DataFrame, keyword: DataFrame, weights: DataFrame | None = None, normalise: bool = False) -> DataFrame:
    """Weighted sums (0.7 and 0.3, or by query from ``weights``); without any keyword hit for a query the semantic score alone.

    Semantic scores may come from rrf and be far smaller than keyword ones; ``normalise`` divides them by
    the best of the query first.
    """
    both = hybrid_join(semantic, keyword)
    if normalise:
        best = F.max("semantic_score").over(Window.partitionBy("query_id"))
        both = both.withColumn("semantic_score", F.when(best > 0, F.col("semantic_score") / best).otherwise(0.0))
    if weights is None:
        both = both.withColumns({"semantic_weight": F.lit(0.7), "keyword_weight": F.lit(0.3)})
    else:
        both = both.join(weights, "query_id")
    any_keyword = F.max("is_keyword").over(Window.partitionBy("query_id"))
    mixed = F.col("semantic_weight") * F.col("semantic_score") + F.col("keyword_weight") * F.col("keyword_score")
    return both.withColumn("score", F.round(F.when(any_keyword, mixed).otherwise(F.col("semantic_score")), 9)).select("query_id", "chunk_id", "semantic_score", "keyword_score", "score")


def merge_sentences(chunks: DataFrame, sentences: DataFrame, boost: float = 1.2, limit: int | None = None) -> DataFrame:
    """Chunks and boosted sentences (query_id, item_id, content, score), one of each opening of 100 characters; ties keep chunks and smaller ids."""
    a = chunks.select("query_id", "item_id", "content", "score", F.lit(0).alias("source"))
    b = sentences.select("query_id", "item_id", "content", (F.col("score") * boost).alias("score"), F.lit(1).alias("source"))
    both = a.unionByName(b).withColumn("score", F.round("score", 9)).withColumn("opening", F.substring(F.lower(stripped("content")), 1, 100))
    first = Window.partitionBy("query_id", "opening").orderBy(F.col("score").desc(), "source", "item_id")
    kept = both.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n", "opening")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "source", "item_id")
    kept = kept.withColumn("rank", F.row_number().over(order))
    return kept if limit is None else kept.where(F.col("rank") <= limit)


def multi_step_merge(hits: DataFrame, limit: int) -> DataFrame:
    """Results of sub-questions (query_id, sub, rank, chunk_id, page_number, content) cut to max(3, limit div n) each, equal pages and texts once, cut to limit."""
    subs = F.size(F.collect_set("sub").over(Window.partitionBy("query_id")))
    cut = hits.withColumn("each", F.greatest(F.lit(3), F.floor(F.lit(limit) / subs))).where("rank <= each").drop("each")
    same = Window.partitionBy("query_id", "page_number", "content").orderBy("sub", "rank")
    once = cut.withColumn("n", F.row_number().over(same)).where("n = 1").drop("n")
    order = Window.partitionBy("query_id").orderBy("sub", "rank", "chunk_id")
    return once.withColumn("position", F.row_number().over(order)).where(F.col("position") <= limit)


def content_hash_groups(rows: DataFrame, key: str, content: str = "content") -> DataFrame:
    """(content_hash, n, first) of contents that occur more than once."""
    hashed = rows.where(F.col(content).isNotNull()).select(F.sha2(content, 256).alias("content_hash"), key)
    return hashed.groupBy("content_hash").agg(F.count("*").alias("n"), F.min(key).alias("first")).where("n > 1")

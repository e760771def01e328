"""Keyword search: all terms must match; ranks by occurrences or by cover density."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Words without weight in a query.
STOP = ["a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "with"]


def terms(text: Column) -> Column:
    """Lower-case words; a stemmer may be mapped over them by the caller."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), 0)


def query_terms(text: Column) -> Column:
    return F.array_except(F.array_distinct(terms(text)), F.array(*[F.lit(w) for w in STOP]))


def keyword_match(queries: DataFrame, chunks: DataFrame, by: str = "doc_id") -> DataFrame:
    """(query_id, chunk_id, n_terms, occurrences) of the chunks of a query's document that hold all its terms.

    Chunks of documents that no query asks for, and terms that none asks of its document, are left out before
    anything is counted: by semi-joins, which need no exchange of the chunks as long as the queries are small.
    """
    asked = queries.select("query_id", by, query_terms(F.col("query")).alias("t")).withColumn("n_terms", F.size("t")).where("n_terms > 0")
    asked = asked.select("query_id", by, "n_terms", F.explode("t").alias("term"))
    wanted = asked.select(by, "term").distinct()
    mine = chunks.join(wanted.select(by).distinct(), by, "left_semi")
    posted = mine.select("chunk_id", by, F.explode(terms(F.col("content"))).alias("term")).join(wanted, [by, "term"], "left_semi")
    posted = posted.groupBy("chunk_id", by, "term").agg(F.count("*").alias("n"))
    met = asked.join(posted, [by, "term"]).groupBy("query_id", "chunk_id", "n_terms").agg(F.count("*").alias("found"), F.sum("n").alias("occurrences"))
    return met.where("found = n_terms").drop("found")


def normalised(ranked: DataFrame, score: str = "score", keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """The score as a share of the best of its result set; 0 if that is 0."""
    best = F.max(score).over(Window.partitionBy(*keys))
    return ranked.withColumn(score, F.when(best > 0, F.col(score) / best).otherwise(0.0))


def occurrence_rank(queries: DataFrame, chunks: DataFrame, k: int = 10, by: str = "doc_id") -> DataFrame:
    """The k chunks of each query with most occurrences of its terms, as shares of the best."""
    matched = keyword_match(queries, chunks, by).withColumn("score", F.lit(0.1) * F.col("occurrences"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "chunk_id")
    best = matched.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return normalised(best).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


def cover_density(positions: list[np.ndarray]) -> float:
    """0.1 / (1 + places between) for each smallest range that holds all terms; positions by term."""
    if len(positions) == 1:
        return 0.1 * len(positions[0])
    places = sorted((int(p), t) for t, ps in enumerate(positions) for p in ps)
    last: dict[int, int] = {}
    covers: list[tuple[int, int]] = []
    for p, t in places:
        last[t] = p
        if len(last) == len(positions):
            start = min(last.values())
            if covers and covers[-1][0] == start:
                continue  # the earlier range lies inside
            covers.append((start, p))
    return sum(0.1 / (1 + (e - s + 1 - len(positions))) for s, e in covers)


def scored(matches: DataFrame) -> DataFrame:
    """(query_id, chunk_id, score): cover density of matches from the places of each term."""

    def density(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[["query_id", "chunk_id"]].assign(score=[cover_density([np.asarray(p) for p in ps]) for ps in b["places"]])

    rows = matches.select("query_id", "chunk_id", "places")
    kinds = dict(rows.dtypes)
    return rows.mapInPandas(density, f"query_id {kinds['query_id']}, chunk_id {kinds['chunk_id']}, score double")


def keyword_rank(queries: DataFrame, chunks: DataFrame, k: int = 10, by: str = "doc_id") -> DataFrame:
    """The k best matches of each query by cover density, as shares of the best; only matched chunks are scored."""

    matched = keyword_match(queries, chunks, by).select("query_id", "chunk_id")
    asked = queries.select("query_id", query_terms(F.col("query")).alias("t"))
    full = matched.join(asked, "query_id").join(chunks.select("chunk_id", "content"), "chunk_id")
    words = terms(F.col("content"))
    places = F.transform("t", lambda t: F.filter(F.transform(F.col("words"), lambda w, i: F.when(w == t, i)), lambda i: i.isNotNull()))
    placed = full.withColumn("words", words).select("query_id", "chunk_id", places.alias("places"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "chunk_id")
    best = scored(placed).withColumn("score", F.round("score", 9)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return normalised(best).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")

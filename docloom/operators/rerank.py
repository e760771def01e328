"""Scores of (query text, text) pairs: a batched scorer, late interaction of hashed words by default, and reranking by it."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.operators.vectors import top

Scorer = Callable[[list[str], list[str]], np.ndarray]
_WORD = re.compile(r"\w+")


def word_vector(word: str, dim: int = 256) -> np.ndarray:
    """How many character trigrams of the word, with marks at its ends, hash to each place."""
    marked, out = f"^{word}$", np.zeros(dim)
    for i in range(len(marked) - 2):
        out[zlib.crc32(marked[i : i + 3].encode()) % dim] += 1
    return out


def late_interaction(queries: list[str], texts: list[str], dim: int = 256) -> np.ndarray:
    """For each pair the mean, over the distinct words of the query, of the cosine of the most similar word of the text; 0 where either has none."""
    words = [[list(dict.fromkeys(_WORD.findall((t or "").lower()))) for t in side] for side in (queries, texts)]
    places = {w: i for i, w in enumerate(dict.fromkeys(w for side in words for ws in side for w in ws))}
    vectors = np.stack([word_vector(w, dim) for w in places]) if places else np.zeros((0, dim))
    own = (vectors * vectors).sum(axis=1)
    out = np.zeros(len(queries))
    for i, (q, t) in enumerate(zip(*words, strict=True)):
        if q and t:
            a, b = [places[w] for w in q], [places[w] for w in t]
            near = (vectors[a] @ vectors[b].T) / np.sqrt(np.outer(own[a], own[b]))
            out[i] = near.max(axis=1).mean()
    return out


def pair_scorer(score: Callable[[], Scorer] = lambda: late_interaction, batch: int = 32):
    """A UDF of (query text, text): ``score`` makes the model once for each task, which then gets ``batch`` pairs at a time."""

    @F.pandas_udf("double")
    def scores(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = score()
        for queries, texts in batches:
            q, t = queries.fillna("").tolist(), texts.fillna("").tolist()
            parts = [np.asarray(model(q[at : at + batch], t[at : at + batch]), np.float64) for at in range(0, len(q), batch)]
            yield pd.Series(np.concatenate(parts) if parts else np.zeros(0))

    return scores


def rerank_texts(candidates: DataFrame, k: int = 15, scorer: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """The k best candidates (query_id, chunk_id, query, content) of each query by its text and theirs; ties go to the smaller chunk id.

    An earlier similarity is kept as original_similarity. Only the columns asked for afterwards leave the scoring task with their score.
    """
    rows = candidates.withColumnRenamed("similarity", "original_similarity").drop("rank")
    score = scorer or pair_scorer()
    return top(rows.withColumn("similarity", F.round(score(F.col("query"), F.col("content")), 9)), ["query_id"], "similarity", "chunk_id", k)


def sentence_scores(sentences: DataFrame, scorer: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """Adds score to (query, content) sentences, as ``budget.compress_chunks`` takes them."""
    return sentences.withColumn("score", F.round((scorer or pair_scorer())(F.col("query"), F.col("content")), 9))

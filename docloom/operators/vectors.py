"""Vector search: cosine, exact nearest chunks, reranking, embedding."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of chunks that meet a query block at once.
BLOCK = 4096
_WORD = re.compile(r"\w+")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity, 0 when either norm is 0."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, 0.0).otherwise(dot(a, b) / norm)


def top(rows: DataFrame, keys: list[str], score: str, tie: str, k: int) -> DataFrame:
    """The k best rows of each key with their rank from 1."""
    order = Window.partitionBy(*keys).orderBy(F.col(score).desc(), tie)
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """The vectors of an Arrow list column, all of one length, as rows."""
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(values), -1) if len(values) else np.zeros((0, 0))


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows of unit length; rows of zeros stay."""
    return x / np.maximum(np.linalg.norm(x, axis=1), 1e-300)[:, None]


def whole_vectors(rows: DataFrame, name: str) -> DataFrame:
    """Rows whose vector is there and holds no null and no NaN."""
    return rows.where(F.col(name).isNotNull() & ~F.exists(name, lambda x: x.isNull() | F.isnan(x)))


def knn(queries: DataFrame, chunks: DataFrame, k: int, by: str = "document_id", block: int = BLOCK) -> DataFrame:
    """(query_id, chunk_id, similarity, rank): the k chunks nearest by cosine to each query within its document.

    Queries (query_id, ``by``, query_vector) and chunks (chunk_id, ``by``, embedding) meet by document in
    a cogroup. Chunks and queries of a document are dealt to blocks of about ``block`` rows, and every block
    of the one meets every block of the other, so a hot document spreads over tasks and memory is bounded.
    In a task, a matrix product gives the similarities, and only k rows of each query and block leave it,
    which a window then merges. Ties go to the smaller chunk id. Queries and chunks whose vector is null or
    holds a null or a NaN take no part.
    """
    return top(block_hits(queries, chunks, k, by, block), ["query_id"], "similarity", "chunk_id", k)


def block_hits(queries: DataFrame, chunks: DataFrame, k: int, by: str, block: int = BLOCK) -> DataFrame:
    """(query_id, chunk_id, similarity): the k best of each query and block, as described at ``knn``."""

    def run(q: pa.Table, c: pa.Table) -> pa.Table:
        kinds = pa.schema([("query_id", q.schema.field("query_id").type), ("chunk_id", c.schema.field("chunk_id").type), ("similarity", pa.float64())])
        if not q.num_rows or not c.num_rows:
            return kinds.empty_table()
        c = c.sort_by("chunk_id")
        names, x, out = c.column("chunk_id").combine_chunks(), unit_rows(matrix(c.column("embedding"))), []
        for lo in range(0, q.num_rows, 512):
            part = q.slice(lo, 512)
            s = np.round(unit_rows(matrix(part.column("query_vector"))) @ x.T, 9)
            take = np.argsort(-s, axis=1, kind="stable")[:, :k]
            asked = part.column("query_id").combine_chunks().take(pa.array(np.repeat(np.arange(len(take)), take.shape[1])))
            out.append(pa.table([asked, names.take(pa.array(take.ravel())), pa.array(np.take_along_axis(s, take, 1).ravel())], schema=kinds))
        return pa.concat_tables(out)

    queries, chunks = whole_vectors(queries, "query_vector"), whole_vectors(chunks, "embedding")
    ids = dict(chunks.dtypes)["chunk_id"]
    number = lambda rows, name: rows.groupBy(by).agg(F.ceil(F.count("*") / block).cast("int").alias(name))
    sizes = number(chunks, "chunk_blocks").join(number(queries, "query_blocks"), by)
    mine = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = chunks.select(by, "chunk_id", "embedding").join(sizes, by).withColumn("cb", mine("chunk_id", "chunk_blocks")).withColumn("qb", each("query_blocks"))
    asked = queries.select(by, "query_id", "query_vector").join(sizes, by).withColumn("qb", mine("query_id", "query_blocks")).withColumn("cb", each("chunk_blocks"))
    # aliased, as both sides may come from one table
    dealt = dealt.select(*[F.col(c).alias(c) for c in (by, "qb", "cb", "chunk_id", "embedding")])
    asked = asked.select(*[F.col(c).alias(c) for c in (by, "qb", "cb", "query_id", "query_vector")])
    return asked.groupBy(by, "qb", "cb").cogroup(dealt.groupBy(by, "qb", "cb")).applyInArrow(run, f"query_id {dict(queries.dtypes)['query_id']}, chunk_id {ids}, similarity double")


def rerank(candidates: DataFrame, k: int = 15, scorer: Callable[[Column, Column], Column] = cosine) -> DataFrame:
    """The k best candidates of each query by ``scorer`` of query and chunk vectors; keeps the earlier score as original_similarity."""
    scored = candidates.withColumn("original_similarity", F.col("similarity")).withColumn("similarity", F.round(scorer(F.col("query_vector"), F.col("embedding")), 9))
    return top(scored.drop("rank"), ["query_id"], "similarity", "chunk_id", k)


def hashed_counts(texts: Sequence[str | None], dim: int = 64) -> np.ndarray:
    """[text, place] how many words of each text hash to each place."""
    out, places = np.zeros((len(texts), dim)), {}
    for i, t in enumerate(texts):
        for w in _WORD.findall((t or "").lower()):
            at = places.get(w)
            if at is None:
                at = places[w] = zlib.crc32(w.encode()) % dim
            out[i, at] += 1
    return out


def hashed_embedder(dim: int = 64):
    """A default embedder: hashed term frequencies, L2-normalised. Any iterator UDF of text batches may take its place."""

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out = hashed_counts(texts.tolist(), dim).astype(np.float32)
            out /= np.maximum(np.linalg.norm(out, axis=1), 1e-9)[:, None]
            yield pd.Series(list(out))

    return embed


def neighbour_distances(embed: Callable[[list[str]], np.ndarray], batch: int = 50):
    """A UDF from the texts of a row to the cosine distances of each text to the next; 1 where either vector is zero.

    The texts of many rows are embedded together, ``batch`` at a time and in order.
    """

    @F.pandas_udf("array<double>")
    def distances(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in batches:
            texts = [t for r in rows for t in r]
            x = np.concatenate([np.asarray(embed(texts[at : at + batch]), np.float64) for at in range(0, len(texts), batch)] or [np.zeros((0, 1))])
            own = (x * x).sum(axis=1)
            norm = np.sqrt(own[:-1] * own[1:])
            far = 1 - np.divide((x[:-1] * x[1:]).sum(axis=1), norm, out=np.zeros(len(norm)), where=norm > 0)
            ends = np.cumsum([len(r) for r in rows])
            yield pd.Series([far[e - len(r) : max(e - 1, 0)] for r, e in zip(rows, ends, strict=True)])

    return distances

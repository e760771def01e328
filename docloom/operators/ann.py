"""Approximate nearest chunks: inverted lists around centroids, residual product codes, exact scores for the best of them."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.operators.vectors import matrix, top, unit_rows, whole_vectors

#: Rows that the centroids and codes are fitted on at most; the rows of the smallest hashes are taken.
SAMPLE = 20_000
#: Chunks of a document that stand in one cell, about; larger documents are cut along their lists.
BLOCK = 16_384


@dataclass(frozen=True)
class Codebook:
    """centroids [list, dim], and codes [part, code, dim / parts] of what is left of a vector besides its centroid."""

    centroids: np.ndarray
    codes: np.ndarray

    def lists_of(self, x: np.ndarray) -> np.ndarray:
        return nearest(x, self.centroids)

    def probed(self, y: np.ndarray, probes: int) -> np.ndarray:
        """[query, list] whether a list is among the ``probes`` whose centroids have the greatest product with the query."""
        order = np.argsort(-(y @ self.centroids.T), axis=1, kind="stable")[:, :probes]
        out = np.zeros((len(y), len(self.centroids)), bool)
        np.put_along_axis(out, order, True, axis=1)
        return out

    def encoded(self, x: np.ndarray, lists: np.ndarray) -> np.ndarray:
        parts, _, width = self.codes.shape
        rest = (x - self.centroids[lists]).reshape(len(x), parts, width)
        return np.stack([nearest(rest[:, i], self.codes[i]) for i in range(parts)], axis=1).astype(np.uint8)

    def estimates(self, y: np.ndarray, lists: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Product of one query with every encoded row, from the codes alone."""
        parts, n, width = self.codes.shape
        table = np.einsum("pcw,pw->pc", self.codes, y.reshape(parts, width)).astype(np.float32).ravel()
        return (self.centroids @ y)[lists] + table[codes + (np.arange(parts) * n)].sum(axis=1)


def nearest(x: np.ndarray, centres: np.ndarray, rows: int = 8_192) -> np.ndarray:
    out = np.empty(len(x), np.int32)
    half = (centres**2).sum(axis=1) / 2
    for at in range(0, len(x), rows):
        out[at : at + rows] = (half - x[at : at + rows] @ centres.T).argmin(axis=1)
    return out


def _means(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """Centres of Lloyd's algorithm; each starts at a row drawn by its squared distance to those before, so copies of one row start once."""
    picked = [int(rng.integers(len(x)))]
    far = ((x - x[picked[0]]) ** 2).sum(axis=1)
    while len(picked) < k and far.max() > 0:
        picked.append(int(np.searchsorted(np.cumsum(far), rng.random() * far.sum(), "right").clip(0, len(x) - 1)))
        far = np.minimum(far, ((x - x[picked[-1]]) ** 2).sum(axis=1))
    centres = x[picked].copy()
    for _ in range(rounds):
        own = nearest(x, centres)
        sums, n = np.zeros_like(centres), np.bincount(own, minlength=len(centres))
        np.add.at(sums, own, x)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]  # an empty one keeps its place
    return centres


def fit(chunks: DataFrame, lists: int = 64, parts: int = 32, codes: int = 256, sample: int = SAMPLE, rounds: int = 12, seed: int = 1) -> Codebook | None:
    """A codebook from at most ``sample`` chunk vectors (unit length); null without any. ``parts`` falls to the next divisor of the dimension."""
    rows = whole_vectors(chunks, "embedding")
    step = max(1, rows.count() // sample)
    mark = F.xxhash64("chunk_id")
    taken = rows.where(F.pmod(mark, F.lit(step)) == 0).orderBy(mark, "chunk_id").limit(sample).select("embedding").toArrow()
    if not taken.num_rows:
        return None
    x = unit_rows(matrix(taken.column(0)))
    rng = np.random.default_rng(seed)
    centroids = _means(x, lists, rounds, rng)
    parts = max(p for p in range(1, parts + 1) if x.shape[1] % p == 0)
    rest = (x - centroids[nearest(x, centroids)]).reshape(len(x), parts, -1)
    books = [_means(np.ascontiguousarray(rest[:, i]), codes, rounds, rng) for i in range(parts)]
    same = max(map(len, books))
    return Codebook(centroids, np.stack([np.concatenate([b, b[:1].repeat(same - len(b), axis=0)]) for b in books]))


def build_index(chunks: DataFrame, book: Codebook, by: str = "document_id") -> DataFrame:
    """(``by``, chunk_id, list, codes, embedding) of every chunk with a whole vector: a byte for each part beside the vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = unit_rows(matrix(b.column(2)))
                lists = book.lists_of(x)
                codes = book.encoded(x, lists)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lists, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary()), b.column(2)], names=[by, "chunk_id", "list", "codes", "embedding"])

    rows = whole_vectors(chunks.where(F.col(by).isNotNull()), "embedding").select(by, "chunk_id", F.col("embedding").cast("array<double>").alias("embedding"))
    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, f"{by} {kinds[by]}, chunk_id {kinds['chunk_id']}, list int, codes binary, embedding array<double>")


def save_index(index: DataFrame, book: Codebook, path: str, by: str = "document_id") -> None:
    """Keep an index: rows sorted by document and list, so that a search for few documents skips row groups; the codebook beside them."""
    index.repartitionByRange(by, "list").sortWithinPartitions(by, "list").write.parquet(f"{path}/rows")
    spark, (parts, _, width) = index.sparkSession, book.codes.shape
    flat = lambda kind, x: [(kind, i, v.tolist()) for i, v in enumerate(x)]
    rows = flat("centroid", book.centroids) + flat(f"code/{parts}/{width}", book.codes.reshape(-1, width))
    spark.createDataFrame(rows, "kind string, number int, vector array<double>").coalesce(1).write.parquet(f"{path}/codebook")


def load_index(spark: SparkSession, path: str) -> tuple[DataFrame, Codebook]:
    """The rows and the codebook of a kept index; the codebook has a row for each list and code."""
    kept = spark.read.parquet(f"{path}/codebook").orderBy("kind", "number").collect()
    centroids = np.array([r.vector for r in kept if r.kind == "centroid"])
    parts, width = (int(x) for x in kept[-1].kind.split("/")[1:])
    return spark.read.parquet(f"{path}/rows"), Codebook(centroids, np.array([r.vector for r in kept if r.kind != "centroid"]).reshape(parts, -1, width))


def search(queries: DataFrame, index: DataFrame, book: Codebook, k: int, by: str = "document_id", probes: int = 48, share: float = 0.1, most: int = 50, block: int = BLOCK, counted: DataFrame | None = None) -> DataFrame:
    """(query_id, chunk_id, similarity, rank, n_scored): the k best chunks by cosine among those whose codes look best.

    A query reads the codes of the ``probes`` lists nearest to it, and the best of these estimates are scored exactly: ``share``
    of a cell's chunks, at least k and at most ``most`` times k. n_scored counts these for the query over all its cells.

    Documents of at most ``block`` chunks are one cell, so every vector and query is exchanged once. Larger ones are cut
    along their lists into cells of about ``block`` rows, however large a list is, and a query goes to the cells of its
    lists only. ``counted`` has the rows to find large documents by, where counting the index would build it once more.
    Similarities are exact; ties go to the smaller chunk id. Rows with a null document, and vectors that are
    null or hold a null or NaN, take no part.
    """
    asked = whole_vectors(queries.where(F.col(by).isNotNull()), "query_vector").select(by, "query_id", F.col("query_vector").cast("array<double>").alias("query_vector"))
    large = (index if counted is None else counted).groupBy(by).count().where(F.col("count") > block).select(by)
    if large.isEmpty():
        index, asked = index.withColumn("cell", F.lit(0).cast("long")), asked.withColumn("cell", F.lit(0).cast("long"))
    else:
        index, asked = _dealt(index, asked, book, large, by, probes, block)
    ids = {n: kind for n, kind in [*index.dtypes, *asked.dtypes]}

    def run(q: pa.Table, c: pa.Table) -> pa.Table:
        found = {"query_id": [], "chunk_id": [], "similarity": [], "scored": []}
        if q.num_rows and c.num_rows:
            c = c.sort_by("chunk_id")
            names, lists = c.column("chunk_id"), c.column("list").to_numpy()
            codes = np.frombuffer(b"".join(c.column("codes").to_pylist()), np.uint8).reshape(len(lists), -1).astype(np.int64)
            x, y = unit_rows(matrix(c.column("embedding"))), unit_rows(matrix(q.column("query_vector")))
            wanted = book.probed(y, probes)
            scored = min(max(k, int(share * len(lists))), most * k)
            for i in range(len(y)):
                near = np.flatnonzero(wanted[i][lists])
                if not len(near):
                    continue
                if len(near) > scored:
                    near = np.sort(near[np.argpartition(-book.estimates(y[i], lists[near], codes[near]), scored - 1)[:scored]])
                s = np.round(x[near] @ y[i], 9)
                best = np.argsort(-s, kind="stable")[:k]
                found["query_id"].append(q.column("query_id").slice(i, 1).take(pa.array(np.zeros(len(best), np.int64))))
                found["chunk_id"].append(names.take(pa.array(near[best])))
                found["similarity"].append(pa.chunked_array([pa.array(s[best], pa.float64())]))
                found["scored"].append(pa.chunked_array([pa.array([len(near)] + [0] * (len(best) - 1), pa.int64())]))
        kinds = {"query_id": q.schema.field("query_id").type, "chunk_id": c.schema.field("chunk_id").type, "similarity": pa.float64(), "scored": pa.int64()}
        return pa.table({n: pa.chunked_array([p for part in found[n] for p in part.chunks], kind) for n, kind in kinds.items()})

    hits = asked.groupBy(by, "cell").cogroup(index.groupBy(by, "cell")).applyInArrow(run, f"query_id {ids['query_id']}, chunk_id {ids['chunk_id']}, similarity double, scored long")
    hits = hits.withColumn("n_scored", F.sum("scored").over(Window.partitionBy("query_id"))).drop("scored")
    return top(hits, ["query_id"], "similarity", "chunk_id", k)


def _dealt(index: DataFrame, asked: DataFrame, book: Codebook, large: DataFrame, by: str, probes: int, block: int) -> tuple[DataFrame, DataFrame]:
    """Index and queries with their cells, where documents are larger than a cell.

    The lists of a document stand one after the other; a chunk's place within its list is drawn by the hash of its id.
    """
    spans = index.join(large, by, "left_semi").groupBy(by, "list").agg(F.count("*").alias("n"))
    before = Window.partitionBy(by).orderBy("list").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("begin", F.coalesce(F.sum("n").over(before), F.lit(0)))
    cell = F.floor((F.col("begin") + F.pmod(F.xxhash64("chunk_id"), F.col("n"))) / block)
    index = index.join(spans, [by, "list"], "left").withColumn("cell", F.coalesce(cell, F.lit(0)).cast("long")).drop("n", "begin")

    @F.pandas_udf("array<int>")
    def lists(vectors):
        import pandas as pd

        wanted = book.probed(unit_rows(np.stack(vectors.to_numpy())), probes)
        return pd.Series([np.flatnonzero(w).tolist() for w in wanted])

    own = spans.groupBy(by).agg(F.collect_list(F.struct("list", F.floor(F.col("begin") / block).alias("first"), F.floor((F.col("begin") + F.col("n") - 1) / block).alias("last"))).alias("spans"))
    asked = asked.withColumn("wanted", lists("query_vector")).join(own, by, "left")
    reached = F.transform(F.filter("spans", lambda s: F.array_contains("wanted", s["list"])), lambda s: F.sequence(s["first"], s["last"]))
    cells = F.coalesce(F.array_distinct(F.flatten(reached)), F.array(F.lit(0).cast("long")))
    return index, asked.withColumn("cell", F.explode(cells)).drop("wanted", "spans")


def ann(queries: DataFrame, chunks: DataFrame, k: int, by: str = "document_id", book: Codebook | None = None, probes: int = 48, **how) -> DataFrame:
    """(query_id, chunk_id, similarity, rank) of the chunks of each query's document; fits a codebook, indexes every chunk and searches."""
    book = book or fit(chunks)
    if book is None:
        book = Codebook(np.zeros((1, 1)), np.zeros((1, 1, 1)))
    return search(queries, build_index(chunks, book, by), book, k, by, probes, counted=chunks, **how)

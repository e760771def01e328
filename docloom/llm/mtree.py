"""Exact top-k inner products by best-first search of a distributed M-tree."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import discard, materialize, small_batches, table

#: Entries of a leaf page, and of a tree (one row of the index, one read of a task).
PAGE, TREE = 256, 8192
#: At most so many trees; with more rows trees grow, so that their directory stays small enough to send.
MOST_TREES = 16_384
#: Rows drawn by hash as routing objects and for a first bound of every query.
SAMPLE = 1024
QUERY_BLOCK = 256


class Metric:
    """Inner products as distances: data get a last coordinate that lifts them to one norm, queries get zero there.

    Then d(q, x)^2 = |q|^2 + M^2 - 2 q.x, so the largest products are the nearest neighbours, and the
    triangle inequality holds between data, routing objects and queries.
    """

    def __init__(self, most: float):
        self.most = most

    def lift(self, x: np.ndarray) -> np.ndarray:
        x = x.astype(np.float64)
        return np.hstack([x, np.sqrt(np.maximum(0, self.most - (x * x).sum(axis=1)))[:, None]])

    @staticmethod
    def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        square = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)
        return np.sqrt(np.maximum(0, square))


def spread_centres(x: np.ndarray, count: int) -> np.ndarray:
    """Row numbers of routing objects, each the farthest from those before."""
    chosen = [0]
    near = Metric.distances(x, x[:1])[:, 0]
    while len(chosen) < count and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, Metric.distances(x, x[chosen[-1:]])[:, 0])
    return np.array(chosen)


def build_tree(ids: np.ndarray, x: np.ndarray, metric: Metric, page: int = PAGE) -> dict[str, bytes | int]:
    """A tree as arrays: a root over pages with covering radii, entries sorted by page and distance to the page's routing object.

    Every page has its distance to the root and every entry its distance to the page.
    """
    lifted = metric.lift(x)
    centres = lifted[spread_centres(lifted, max(1, -(-len(x) // page)))]
    owner, own = np.empty(len(x), dtype=np.int64), np.empty(len(x))
    for lo in range(0, len(x), TREE):
        near = Metric.distances(lifted[lo : lo + TREE], centres)
        owner[lo : lo + TREE] = near.argmin(axis=1)
        own[lo : lo + TREE] = near.min(axis=1)
    order = np.lexsort((own, owner))
    owner, own = owner[order], own[order]
    # a crowded page is cut into several with the same routing object
    begins = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1])]))
    begins = np.concatenate([np.arange(a, b, 2 * page) for a, b in zip(begins, [*begins[1:], len(x)], strict=True)])
    ends = np.append(begins[1:], len(x))
    root, pages = lifted.mean(axis=0), centres[owner[begins]]
    return {
        "n": len(x), "ids": ids[order].astype(np.int64).tobytes(), "x": x[order].astype(np.float64).tobytes(), "parent": own.tobytes(),
        "begins": begins.astype(np.int64).tobytes(), "centres": pages.tobytes(), "radii": own[ends - 1].tobytes(), "page_parent": Metric.distances(pages, root[None, :])[:, 0].tobytes(),
        "root": root.tobytes(), "root_radius": float(Metric.distances(lifted, root[None, :]).max()),
    }


def products(x: np.ndarray, q: np.ndarray, metric: Metric) -> np.ndarray:
    """Integer inner products of rows with one vector: in floating point where that is exact, else in whole numbers."""
    if metric.most < 2.0**52:
        return (x @ q).astype(np.int64)
    whole = [int(c) for c in q]
    return np.array([sum(int(a) * b for a, b in zip(row, whole, strict=True)) for row in x], dtype=object)


def search(tree: dict, q_ids: np.ndarray, q: np.ndarray, floor: np.ndarray, k: int, metric: Metric, counts: dict[str, int] | None = None) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """For each query (id, vec_ids, scores) of its best k entries here, those that can't reach ``floor`` left out.

    Best first: pages wait in the order of their lower bound, d(q, page) - radius, and the search ends at the first
    that can't hold a better entry. Stored distances save others: d(q, page) is not computed where
    |d(q, root) - d(page, root)| - radius is out of reach already, and an entry's product not where
    |d(q, page) - d(entry, page)| exceeds the distance of the k-th best. ``counts`` gets how many of each were computed.
    """
    ids = np.frombuffer(tree["ids"], dtype=np.int64)
    dim = q.shape[1]
    x = np.frombuffer(tree["x"]).reshape(len(ids), dim)
    parent, begins = np.frombuffer(tree["parent"]), np.frombuffer(tree["begins"], dtype=np.int64)
    ends = np.append(begins[1:], len(ids))
    radii, page_parent = np.frombuffer(tree["radii"]), np.frombuffer(tree["page_parent"])
    centres = np.frombuffer(tree["centres"]).reshape(len(begins), dim + 1)
    raised = np.hstack([q, np.zeros((len(q), 1))])
    to_root = Metric.distances(raised, np.frombuffer(tree["root"])[None, :])[:, 0]
    norms = (q**2).sum(axis=1) + metric.most
    slack = 1e-6 * (1 + norms)
    reaches = np.where(floor > -np.inf, np.sqrt(np.maximum(0, norms - 2 * np.where(floor > -np.inf, floor, 0)) + slack), np.inf)
    counts = {} if counts is None else counts
    out = []
    for i in range(len(q)):
        worst, reach = float(floor[i]), float(reaches[i])
        best_ids, best = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        open_pages = np.flatnonzero(np.abs(to_root[i] - page_parent) - radii <= reach)
        to_page = Metric.distances(raised[i : i + 1], centres[open_pages])[0] if len(open_pages) else np.zeros(0)
        counts["pages"] = counts.get("pages", 0) + len(open_pages)
        lower = np.maximum(0, to_page - radii[open_pages])
        for j in np.argsort(lower, kind="stable"):
            if lower[j] > reach:
                break
            a, b, d = begins[open_pages[j]], ends[open_pages[j]], to_page[j]
            lo = a + np.searchsorted(parent[a:b], d - reach)  # parent distances are sorted within a page
            hi = a + np.searchsorted(parent[a:b], d + reach, side="right")
            if lo >= hi:
                continue
            counts["entries"] = counts.get("entries", 0) + int(hi - lo)
            scores = products(x[lo:hi], q[i], metric)
            use = (scores >= worst).astype(bool) & (ids[lo:hi] != q_ids[i])
            if use.any():
                best = np.concatenate([best, scores[use]])
                best_ids = np.concatenate([best_ids, ids[lo:hi][use]])
                if len(best) > k:
                    top = np.lexsort((best_ids, -best))[:k] if best.dtype != object else np.array(sorted(range(len(best)), key=lambda t: (-best[t], best_ids[t]))[:k])
                    best, best_ids = best[top], best_ids[top]
                if len(best) == k and best.min() > worst:
                    worst = float(best.min())
                    if int(worst) > best.min():  # rounded up
                        worst = float(np.nextafter(worst, -np.inf))
                    reach = np.sqrt(max(0.0, norms[i] - 2 * worst) + slack[i])
        out.append((int(q_ids[i]), best_ids, best))
    return out


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(id, v array<double>, whole numbers) of the vectors without null or non-finite components."""
    x = F.col(vector_col)
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.where(x.isNotNull() & F.col(id_col).isNotNull()).where(finite)

    def floor(c: F.Column) -> F.Column:
        scaled = c.cast("double") * scale
        return F.when(F.abs(scaled) < 2.0**53, F.floor(scaled).cast("double")).otherwise(scaled)  # beyond, all doubles are whole

    return rows.select(F.col(id_col).cast("long").alias("id"), F.transform(x, floor).alias("v"))


def top_k(vectors: DataFrame, is_query: F.Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products of every query row with all other rows.

    Components become floor(scale * x). Ties go to the smaller id. Rows with a null id, a null vector or a
    null or non-finite component take no part; vectors meet only those of their own length. Repeated rows are
    candidates one by one, query rows alike in id and vector ask once, and a query never meets its own id.
    An empty table gives no rows. A score that a long can't hold raises an error.

    Rows go to the nearest of a bounded set of routing objects; crowded ones are salted. Each group
    becomes one tree. The directory of roots (at most ``MOST_TREES``, or a few more by salting) is sent to the tasks.
    The search goes through the trees in waves, best first: every query visits its nearest tree, then the next two, the
    next four and so on, each time only those that its k-th best so far leaves within reach. So
    the rows that come back grow with queries times k times the number of waves, not with the number of trees.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    rows = materialize(quantised(vectors, id_col, vector_col, scale), "mtree-rows")
    dims = [r[0] for r in rows.groupBy(F.size("v")).count().orderBy("count", ascending=False).collect()]
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    parts = [_top_k(rows.where(F.size("v") == d), rows.where(F.size("v") == d).where(is_query), d, k) for d in dims if d]
    out = empty
    for part in parts:
        out = out.unionByName(part)
    return out


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, dim)


def _top_k(rows: DataFrame, queries: DataFrame, dim: int, k: int) -> DataFrame:
    spark = rows.sparkSession
    n, most = rows.agg(F.count("*"), F.max(F.aggregate("v", F.lit(0.0), lambda s, c: s + c * c))).first()
    metric, size = Metric(float(most)), max(TREE, -(-n // MOST_TREES))
    drawn = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()  # bounded
    sample_ids, sample = np.array([r[0] for r in drawn]), np.array([r[1] for r in drawn], dtype=np.float64).reshape(-1, dim)
    lifted = metric.lift(sample)
    routes = lifted[spread_centres(lifted, max(1, min(SAMPLE, -(-n // size))))]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                near = Metric.distances(metric.lift(_matrix(b.column(1), dim)), routes).argmin(axis=1)
                yield table({"id": b.column(0), "v": b.column(1), "route": pa.array(near.astype(np.int32))})

    routed = materialize(rows.mapInArrow(assign, "id long, v array<double>, route int"), "mtree-routed")
    salts = routed.groupBy("route").agg(F.ceil(F.count("*") / size).cast("long").alias("salts"))
    tree_id = F.col("route").cast("long") * (1 << 32) + F.pmod(F.xxhash64("id"), F.col("salts"))
    # at most SAMPLE routes
    placed = routed.join(F.broadcast(salts), "route").select("id", "v", tree_id.alias("tree"))
    fields = "tree long, n long, ids binary, x binary, parent binary, begins binary, centres binary, radii binary, page_parent binary, root binary, root_radius double"

    def grow(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        made = build_tree(group["id"].to_numpy(), _matrix(group["v"].combine_chunks(), dim), metric)
        row = {"tree": group["tree"][0].as_py()} | made
        return pa.table({c.split()[0]: [row[c.split()[0]]] for c in fields.split(", ")})

    trees = materialize(placed.groupBy("tree").applyInArrow(grow, fields), "mtree-trees")
    found = trees.select("tree", "root", "root_radius").collect()
    directory = spark.sparkContext.broadcast((np.array([r[0] for r in found]), np.array([np.frombuffer(r[1]) for r in found]).reshape(-1, dim + 1), np.array([r[2] for r in found])))

    def asking(first: int, last: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        """Blocks of queries for each tree that is from first-th to before last-th nearest to them and within their reach."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, roots, radii = directory.value
            for b in batches:
                for lo in range(0, b.num_rows, QUERY_BLOCK):
                    part = b.slice(lo, QUERY_BLOCK)
                    ids, q, floor = part.column(0).to_numpy(), _matrix(part.column(1), dim), part.column(2).to_numpy(zero_copy_only=False)
                    norms = (q**2).sum(axis=1) + metric.most
                    if first == 0 and len(sample) > k:
                        scores = q @ sample.T
                        scores[ids[:, None] == sample_ids[None, :]] = -np.inf
                        floor = np.sort(scores, axis=1)[:, -k] - 1e-9 * norms
                    if metric.most >= 2.0**52:
                        floor = floor - 1e-9 * norms  # scores so large are rounded here
                    reach = np.sqrt(np.maximum(0, norms - 2 * np.maximum(floor, -norms)) + 1e-6 * (1 + norms))
                    far = Metric.distances(np.hstack([q, np.zeros((len(q), 1))]), roots)
                    rank = far.argsort(axis=1, kind="stable").argsort(axis=1, kind="stable")
                    near = (far - radii[None, :] <= reach[:, None]) & (rank >= first) & (rank < last)
                    for t in np.flatnonzero(near.any(axis=0)):
                        m = near[:, t]
                        yield table({"tree": pa.array([int(names[t])]), "q_ids": pa.array([ids[m].tobytes()], pa.binary()), "q": pa.array([q[m].tobytes()], pa.binary()), "floor": pa.array([floor[m].tobytes()], pa.binary())})

        return run

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                q = np.frombuffer(row["q"]).reshape(-1, dim)
                hits = search(row, np.frombuffer(row["q_ids"], dtype=np.int64), q, np.frombuffer(row["floor"]), k, metric)
                scores = [int(s) for h in hits for s in h[2]]
                yield table({"query_id": pa.array(np.repeat([h[0] for h in hits], [len(h[1]) for h in hits]).astype(np.int64)), "vec_id": pa.array(np.concatenate([h[1] for h in hits])), "score": pa.array(scores, pa.int64())})

    asked = materialize(queries.select("id", "v").distinct(), "mtree-queries")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    best, first, last = None, 0, 1
    while first < len(found):
        floors = asked.withColumn("floor", F.lit(float("-inf")))
        if best is not None:
            kth = best.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").cast("double").alias("floor"))
            floors = asked.join(kth.groupBy("id").agg(F.min("floor").alias("floor")), "id", "left").fillna(float("-inf"), "floor")
        blocks = materialize(floors.select("id", "v", "floor").mapInArrow(asking(first, last), "tree long, q_ids binary, q binary, floor binary"), f"mtree-asked-{first}")
        met = blocks.join(trees, "tree").mapInArrow(visit, "query_id long, vec_id long, score long")
        met = met if best is None else met.union(best.drop("rank"))
        before, best = best, materialize(met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), f"mtree-best-{first}")
        discard(blocks, *[df for df in [before] if df is not None])
        first, last = last, 2 * last + 1
    discard(trees, asked)
    return best.select("query_id", "rank", "vec_id", "score")

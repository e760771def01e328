"""Connected components of a link table as Spark jobs (distributed union-find)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import discard, materialize, table

#: Nodes that a task keeps in its local forest before it passes them on.
FOREST_NODES = 500_000


def local_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over the links of one task; yields node-to-root links only, so cliques shrink to stars."""
    parent: dict = {}
    kind = pa.int64()

    def find(x):
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while parent.get(x, x) != root:
            parent[x], x = root, parent[x]
        return root

    def flush() -> pa.RecordBatch:
        pairs = [(x, find(x)) for x in list(parent)]
        pairs = [(x, r) for x, r in pairs if x != r]
        parent.clear()
        return table({"u": pa.array([x for x, _ in pairs], kind), "v": pa.array([r for _, r in pairs], kind)})

    for batch in batches:
        kind = batch.schema.field(0).type
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ra, rb = find(a), find(b)
            if ra != rb:
                low, high = (ra, rb) if ra < rb else (rb, ra)
                parent[high] = low
                parent.setdefault(low, low)
        if len(parent) > FOREST_NODES:
            yield flush()
    if parent:
        yield flush()


def connected_components(links: DataFrame, label: str = "components") -> DataFrame:
    """(node, component) for every node of the links (u, v), bigint or binary; component is the smallest node of each.

    Every task first unites its own links. The remaining forests are then hooked to their smallest
    neighbour, large star and small star in turn, until nothing changes; that takes a number of rounds
    in the order of the logarithm of the longest path. Minima are pre-aggregated and joined back, so
    no task holds all links of a node. Self links and repeated links do no harm; nodes are not null.
    """
    links = links.toDF("u", "v").where("u <> v")
    kind = dict(links.dtypes)["u"]
    forest = materialize(links.mapInArrow(local_forest, f"u {kind}, v {kind}").distinct(), f"{label}-forest")
    seen = None
    while True:
        state = forest.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or state[0] == 0:
            break
        seen = state
        both = forest.union(forest.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, f"{label}-large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(
            F.explode(F.array(F.struct(F.col("v").alias("a"), F.col("m").alias("b")), F.struct(F.col("u").alias("a"), F.col("m").alias("b")))).alias("x")
        )
        small = small.select(F.col("x.a").alias("u"), F.col("x.b").alias("v")).where("u <> v").distinct()
        before, forest = forest, materialize(small, f"{label}-small")
        discard(before, large)
    roots = forest.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return forest.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)

"""Exact Jaccard verification of candidate pairs, shared by the near-duplicate operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import table


def jaccard(a: set, b: set) -> float:
    shared = len(a & b)
    return shared / (len(a) + len(b) - shared) if a or b else 1.0


def with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(u, v, text_u, text_v) of pairs (u, v): two equi-joins with ``texts``, which has (node, text), one row a node."""
    left = texts.select(F.col("node").alias("u"), F.col("text").alias("text_u"))
    right = texts.select(F.col("node").alias("v"), F.col("text").alias("text_v"))
    return pairs.toDF("u", "v").join(right, "v").join(left, "u").select("u", "v", "text_u", "text_v")


def verified(pairs: DataFrame, texts: DataFrame, shingles: Callable[[str], set], threshold: float) -> DataFrame:
    """The pairs (u, v) whose shingle sets have a Jaccard similarity of ``threshold`` or more.

    A pair is judged where it stands, so memory holds one Arrow batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, made = None, set()
        for b in batches:
            same = []
            for left, right in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if left != last:
                    last, made = left, shingles(left)
                same.append(jaccard(made, shingles(right)) >= threshold)
            keep = pa.array(same, pa.bool_())
            yield table({"u": b.column(0).filter(keep), "v": b.column(1).filter(keep)})

    both = with_texts(pairs, texts)
    kind = dict(both.dtypes)["u"]
    return both.mapInArrow(run, f"u {kind}, v {kind}")

"""A stored positional index: (document, term) postings in blocks with their maxima, and top-k search that passes blocks over."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.operators import keyword

#: Chunks of a document in a block, about.
BLOCK = 128
#: So many documents or terms asked for at most go into the scan as filters; beyond it a join alone picks them.
PUSHED = 200
#: So many documents asked for at most are sent to the tasks, so that only their postings are exchanged.
SENT = 5_000_000


def build_postings(chunks: DataFrame, by: str = "doc_id", block: int = BLOCK) -> DataFrame:
    """(``by``, term, block, most, entries): where a term stands in the chunks of a block of a document.

    entries are struct<chunk_id, n, places> by chunk id, places from 0 among the words of the chunk; most is the greatest n.
    A chunk's block is drawn by the hash of its id, so all terms of a document have the same blocks and none holds much more
    than ``block`` chunks. Stop words are left out; null contents have no terms.

    The chunks themselves are exchanged once, in ranges of document and block; their terms are never exchanged, and a task
    holds the words of one block and one Arrow batch.
    """
    blocks = chunks.groupBy(by).agg(F.ceil(F.count("*") / block).alias("blocks")).where("blocks > 1")  # a row for each ``block`` chunks at most
    dealt = chunks.join(F.broadcast(blocks), by, "left").withColumn("block", F.coalesce(F.pmod(F.xxhash64("chunk_id"), F.col("blocks")), F.lit(0)).cast("int"))
    dealt = dealt.where("content IS NOT NULL").select(by, "block", "chunk_id", "content").repartitionByRange(by, "block").sortWithinPartitions(by, "block", "chunk_id")
    kinds = dict(dealt.dtypes)
    entry = f"struct<chunk_id: {kinds['chunk_id']}, n: int, places: array<int>>"
    words = dealt.select(by, "block", "chunk_id", keyword.terms(F.col("content")).alias("words"))
    return words.mapInArrow(_posted, f"`{by}` {kinds[by]}, term string, block int, most int, entries array<{entry}>")


def _posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings of (document, block, chunk_id, words) rows in order of document, block and chunk, whole blocks at a time."""
    kept: pa.Table | None = None
    for b in batches:
        rows = pa.Table.from_batches([b]) if kept is None else pa.concat_tables([kept, pa.Table.from_batches([b])])
        key = pa.StructArray.from_arrays([c.combine_chunks() for c in rows.columns[:2]], ["by", "block"])
        last = key[-1].as_py()
        end = rows.num_rows
        while end and key[end - 1].as_py() == last:  # may go on in the next batch
            end -= 1
        yield from _inverted(rows.slice(0, end))
        kept = rows.slice(end)
    if kept is not None:
        yield from _inverted(kept)


def _inverted(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """Postings of whole blocks in order."""
    words = rows.column(3).combine_chunks() if rows.num_rows else None
    if words is None or not len(words.flatten()):
        return
    coded = words.flatten().dictionary_encode()
    code, sizes = coded.indices.to_numpy(), np.diff(words.offsets.to_numpy())
    chunk = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(code)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    keys = [c.combine_chunks() for c in rows.columns[:3]]
    new = np.zeros(len(sizes), dtype=bool)  # where a block begins
    for c in keys[:2]:
        number = c.dictionary_encode(null_encoding="encode").indices.to_numpy()
        new[1:] |= number[1:] != number[:-1]
    group = np.cumsum(new)[chunk]
    weighty = ~np.isin(coded.dictionary.to_numpy(zero_copy_only=False).astype(object), keyword.STOP)[code]
    code, chunk, place, group = (x[weighty] for x in (code, chunk, place, group))
    if not len(code):
        return
    order = np.lexsort((chunk, code, group))  # keeps the order of places
    code, chunk, place, group = (x[order] for x in (code, chunk, place, group))
    begins = lambda *columns: np.flatnonzero(np.concatenate([[True], np.any([c[1:] != c[:-1] for c in columns], axis=0)]))
    entry, posting = begins(group, code, chunk), begins(group, code)
    n = np.diff(np.append(entry, len(code)))
    first = np.searchsorted(entry, posting)  # the entry with which a posting begins
    offsets = lambda at, end: pa.array(np.append(at, end).astype(np.int32))
    places = pa.ListArray.from_arrays(offsets(entry, len(code)), pa.array(place.astype(np.int32)))
    entries = pa.StructArray.from_arrays([keys[2].take(pa.array(chunk[entry])), pa.array(n.astype(np.int32)), places], ["chunk_id", "n", "places"])
    entries = pa.ListArray.from_arrays(offsets(first, len(entry)), entries)
    at = pa.array(chunk[posting])
    out = pa.RecordBatch.from_arrays(
        [keys[0].take(at), coded.dictionary.take(pa.array(code[posting])), keys[1].take(at), pa.array(np.maximum.reduceat(n, first).astype(np.int32)), entries],
        names=[rows.column_names[0], "term", "block", "most", "entries"],
    )
    for lo in range(0, out.num_rows, 10_000):
        yield out.slice(lo, 10_000)


def save_postings(postings: DataFrame, path: str, by: str = "doc_id", page_rows: int = 2_000) -> None:
    """Write an index sorted by document and term, in small pages with their bounds, so that a search skips what it doesn't ask for.

    ``build_postings`` gives it in ranges of documents already, each of which becomes a file; only a large document lies in several.
    """
    ordered = postings.sortWithinPartitions(by, "term", "block")
    ordered.write.option("parquet.page.row.count.limit", page_rows).parquet(path)


def open_postings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def asked_terms(queries: DataFrame, by: str = "doc_id") -> DataFrame:
    """(query_id, ``by``, n_terms, term) of the queries (query_id, ``by``, query); queries of stop words alone ask for nothing."""
    rows = queries.select("query_id", by, keyword.query_terms(F.col("query")).alias("t")).withColumn("n_terms", F.size("t"))
    return rows.where("n_terms > 0").select("query_id", by, "n_terms", F.explode("t").alias("term"))


def _pushed(postings: DataFrame, asked: DataFrame, name: str) -> DataFrame:
    values = [r[0] for r in asked.select(name).where(F.col(name).isNotNull()).distinct().limit(PUSHED + 1).collect()]
    if len(values) > PUSHED:
        return postings
    same: list[Column] = [F.col(name) == v for v in sorted(values)]
    return postings.where(reduce(lambda a, b: a | b, same) if same else F.lit(False))


def only_asked(postings: DataFrame, asked: DataFrame, by: str = "doc_id") -> DataFrame:
    """The postings of documents and terms that are asked for, if these are few: their values reach the scan, which skips pages by their bounds.

    A list of more than ten values would reach it as its least and greatest only, so the values are compared one by one.
    With more documents their ids are sent to all tasks, up to ``SENT`` of them, so that the rest of the index is read but not exchanged.
    """
    few = _pushed(postings, asked, by)
    if few is postings:
        ids = asked.select(by).where(F.col(by).isNotNull()).distinct()
        few = postings.join(F.broadcast(ids) if ids.limit(SENT + 1).count() <= SENT else ids, by, "left_semi")
    return _pushed(few, asked, "term")


def match(queries: DataFrame, postings: DataFrame, by: str = "doc_id") -> DataFrame:
    """(query_id, chunk_id, n_terms, occurrences), as ``keyword.keyword_match``, from the index."""
    asked = asked_terms(queries, by)
    return _found(asked.join(only_asked(postings, asked, by), [by, "term"])).select("query_id", "chunk_id", "n_terms", "occurrences")


def _found(met: DataFrame) -> DataFrame:
    """The chunks of (query, term, block) rows that hold all terms of their query, with the places of each."""
    entries = met.select("query_id", "n_terms", "term", F.explode("entries").alias("e")).select("query_id", "n_terms", "term", "e.*")
    grouped = entries.groupBy("query_id", "chunk_id", "n_terms").agg(F.count("*").alias("found"), F.sum("n").cast("long").alias("occurrences"), F.collect_list("places").alias("places"))
    return grouped.where("found = n_terms")


def top_matches(queries: DataFrame, postings: DataFrame, k: int = 10, by: str = "doc_id", density: bool = True, first: int = 1) -> DataFrame:
    """(query_id, chunk_id, score, rank): the k best matches by cover density, or else by occurrences, as shares of the best.

    No chunk of a block scores more than 0.1 for each occurrence that the maxima of the query's terms allow, and
    a block that lacks a term has no match. The ``first`` blocks with the highest bounds of each query are scored; of the
    others only those whose bound reaches the k-th score so far are opened. Bounds come from a scan without entries.
    """
    asked = asked_terms(queries, by)
    mine = only_asked(postings, asked, by)
    bounds = asked.join(mine.select(by, "term", "block", "most"), [by, "term"]).groupBy("query_id", by, "block", "n_terms").agg(F.count("*").alias("found"), F.sum("most").alias("most"))
    bounds = bounds.where("found = n_terms").withColumn("bound", F.lit(0.1) * F.col("most"))
    bounds = bounds.withColumn("turn", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("bound").desc(), "block"))).select("query_id", by, "block", "bound", "turn").persist()
    score = keyword.scored if density else lambda found: found.select("query_id", "chunk_id", (F.lit(0.1) * F.col("occurrences")).alias("score"))
    opened = lambda blocks: score(_found(asked.join(blocks.select("query_id", by, "block"), ["query_id", by]).join(mine, [by, "term", "block"])))
    hits = opened(bounds.where(F.col("turn") <= first))
    if not bounds.where(F.col("turn") > first).isEmpty():
        kth = hits.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "chunk_id"))).where(F.col("r") == k).select("query_id", F.col("score").alias("kth"))
        rest = bounds.where(F.col("turn") > first).join(kth, "query_id", "left").where(F.col("kth").isNull() | (F.col("bound") >= F.col("kth")))
        hits = hits.unionByName(opened(rest))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "chunk_id")
    best = hits.withColumn("score", F.round("score", 9)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return keyword.normalised(best).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")

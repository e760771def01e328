"""Joins around chunks: parents, headers, ownership, cascades, citations, annotations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.sources.tables import stripped


def parents_of_children(hits: DataFrame, edges: DataFrame, k: int) -> DataFrame:
    """(query_id, parent_chunk_id, similarity, rank): the k parents of a query with the best children. Parents are ranked by their best child."""
    met = hits.join(edges, hits["chunk_id"] == edges["child_chunk_id"]).groupBy("query_id", "parent_chunk_id").agg(F.max("similarity").alias("similarity"))
    order = Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), "parent_chunk_id")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def with_parents(edges: DataFrame, chunks: DataFrame) -> DataFrame:
    """(child_chunk_id, child_index, and the columns of the parent's chunk): without an exchange if edges are bucketed by parent and chunks by id."""
    return edges.join(chunks, edges["parent_chunk_id"] == chunks["chunk_id"]).select(edges["child_chunk_id"], edges["parent_chunk_id"], *[chunks[c] for c in chunks.columns if c != "chunk_id"])


def preceding_headers(pages: DataFrame, headers: DataFrame, most: int | None = None) -> DataFrame:
    """(doc_id, page_number, headers): the headers of the document up to and on the page, by a running list over its pages.

    All of them make lists that grow with the document; ``most`` keeps so many of the last ones.
    """
    own = headers.groupBy("doc_id", "page_number").agg(F.sort_array(F.collect_list(F.struct("line_index", "text"))).alias("h"))
    base = pages.select("doc_id", "page_number").distinct().join(own, ["doc_id", "page_number"], "left")
    along = Window.partitionBy("doc_id").orderBy("page_number").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    texts = F.transform(F.flatten(F.collect_list("h").over(along)), lambda x: x["text"])
    kept = texts if most is None else F.slice(texts, F.greatest(F.lit(1), F.size(texts) - most + 1), F.lit(most))
    return base.select("doc_id", "page_number", kept.alias("headers"))


def section_title(pages: DataFrame, headers: DataFrame) -> DataFrame:
    """(doc_id, page_number, section_title): the last header of the page, else the first of the document so far."""
    own = headers.groupBy("doc_id", "page_number").agg(F.max_by("text", "line_index").alias("last"), F.min_by("text", "line_index").alias("first"))
    base = pages.select("doc_id", "page_number").distinct().join(own, ["doc_id", "page_number"], "left")
    along = Window.partitionBy("doc_id").orderBy("page_number").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return base.select("doc_id", "page_number", F.coalesce("last", F.first("first", ignorenulls=True).over(along)).alias("section_title"))


def owned(rows: DataFrame, owners: DataFrame, on: str) -> DataFrame:
    """Rows whose key the owners' table lists."""
    return rows.join(owners.select(on), on, "left_semi")


def conversation_list(conversations: DataFrame, documents: DataFrame) -> DataFrame:
    """Conversations with their document, which may be missing, newest first."""
    return conversations.join(documents, "doc_id", "left").orderBy(F.col("last_turn").desc(), F.col("conv_id").desc())


def cascade_delete(tables: dict[str, DataFrame], dropped: DataFrame) -> dict[str, DataFrame]:
    """documents, chunks, edges, conversations and messages without the dropped doc_ids and all that hangs on them."""
    out = dict(tables)
    out["documents"] = tables["documents"].join(dropped, "doc_id", "left_anti")
    out["chunks"] = tables["chunks"].join(dropped, "doc_id", "left_anti")
    gone = tables["chunks"].join(dropped, "doc_id", "left_semi").select("chunk_id")
    edges = tables["edges"].join(gone.withColumnRenamed("chunk_id", "parent_chunk_id"), "parent_chunk_id", "left_anti")
    out["edges"] = edges.join(gone.withColumnRenamed("chunk_id", "child_chunk_id"), "child_chunk_id", "left_anti")
    out["conversations"] = tables["conversations"].join(dropped, "doc_id", "left_anti")
    out["messages"] = tables["messages"].join(tables["conversations"].join(dropped, "doc_id", "left_semi").select("conv_id"), "conv_id", "left_anti")
    return out


def is_hierarchical(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    flagged = chunks.where(F.col("chunk_level").isin("parent", "child")).select("doc_id").distinct().withColumn("has_levels", F.lit(True))
    return documents.select("doc_id").join(flagged, "doc_id", "left").select("doc_id", F.coalesce("has_levels", F.lit(False)).alias("is_hierarchical"))


def match_annotation_text(annotations: DataFrame, chunks: DataFrame) -> DataFrame:
    """(annotation_id, chunk_id): the first chunk by rank of the answer's page that holds the text, upper and lower case alike."""
    met = annotations.join(chunks, ["answer_id", "page_number"]).where(F.lower("content").contains(F.lower("text_to_highlight")))
    return met.groupBy("annotation_id").agg(F.min_by("chunk_id", F.struct("rank", "chunk_id")).alias("chunk_id"))


def match_annotation_image(annotations: DataFrame, chunks: DataFrame) -> DataFrame:
    images = chunks.where("chunk_type = 'image'").select(F.col("chunk_id").alias("image_chunk_id"), "url")
    return annotations.join(images, "image_chunk_id").select("annotation_id", "image_chunk_id", "url")


def highlight_spans(spans: DataFrame) -> DataFrame:
    """(item_id, span_id) to highlight, from (item_id, query, span_id, span).

    A span that isn't blank matches if it holds a word of the query of over 2 characters, or if it has over 3
    characters and the query holds it; an item without any match takes the spans with the first such word.
    """
    q, s = F.lower(stripped("query")), F.lower("span")
    words = F.filter(F.split(q, r"[\t-\r\x1C-\x20\x85\pZ]+"), lambda w: F.length(w) > 2)
    hit = F.exists(words, lambda w: s.contains(w)) | ((F.length(stripped(s)) > 3) & q.contains(stripped(s)))
    marked = spans.withColumn("hit", F.coalesce(hit, F.lit(False))).withColumn("starts", F.coalesce(s.contains(F.get(words, F.lit(0))), F.lit(False)))
    marked = marked.where(stripped("span") != "").withColumn("any_hit", F.max("hit").over(Window.partitionBy("item_id")))
    return marked.where(F.col("hit") | (~F.col("any_hit") & F.col("starts"))).select("item_id", "span_id")

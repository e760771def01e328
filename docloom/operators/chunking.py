"""Chunking of pages: recursive, by content type, in two levels, and by meaning."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.functions import questions as fq
from docloom.functions import text_stats as ts
from docloom.operators.vectors import hashed_counts, neighbour_distances
from docloom.sources.tables import stable_id, stripped

# Separators by content type, tried in this order.
PROSE = ["\n\n", "\n", ". ", "! ", "? ", "; ", ", ", " ", ""]
SEPARATORS = {"code": ["\n\n\n", "\n\n", "\n", " ", ""], "table": ["\n\n", "\n", "|", " ", ""], "list": ["\n\n", "\n", ". ", ", ", " ", ""]}
LEVELS = ["\n\n", "\n", ". ", " ", ""]
_SENTENCE = re.compile(r"(?<=[.!?])\s+(?=[A-Z])")
_SENTENCE_END = re.compile(r"[.!?](?=\s+[A-Z]|\s*$)")


def _packed(pieces: list[str], size: int, overlap: int) -> list[str]:
    """Neighbouring pieces joined up to ``size``, each chunk starting with up to ``overlap`` of the one before."""
    out, held, total = [], [], 0
    for piece in pieces:
        if held and total + len(piece) > size:
            out.append("".join(held).strip())
            while total > overlap or (total > 0 and total + len(piece) > size):
                total -= len(held.pop(0))
        held.append(piece)
        total += len(piece)
    out.append("".join(held).strip())
    return [c for c in out if c]


def split_text(text: str, size: int, overlap: int, separators: list[str]) -> list[str]:
    """Chunks of at most ``size`` characters, cut at the first separator that occurs and, where a piece stays too long, at later ones.

    A separator stays at the start of the piece that it opens.
    """
    at = next(i for i, s in enumerate(separators) if s == "" or s in text)
    mark, later = separators[at], separators[at + 1 :]
    if mark:
        head, *tail = text.split(mark)
        pieces = [p for p in (head, *(mark + t for t in tail)) if p]
    else:
        pieces = list(text)
    out, small = [], []
    for piece in pieces:
        if len(piece) < size:
            small.append(piece)
            continue
        if small:
            out += _packed(small, size, overlap)
            small = []
        out += split_text(piece, size, overlap, later) if later else [piece]
    return out + (_packed(small, size, overlap) if small else [])


def repaired(chunks: list[str]) -> list[str]:
    """Chunks of a page, moved so that each ends with a finished sentence.

    The page is read as one text, and the end of every chunk moves back to the last sentence end since
    the end before; where there is none, the two chunks become one. What follows the last one stays as it is.
    """
    page, out, begin, end = " ".join(chunks), [], 0, -1
    for chunk in chunks:
        end += 1 + len(chunk)
        stops = [m.end() for m in _SENTENCE_END.finditer(page, begin, end)]
        if stops:
            out.append(" ".join(s.strip() for s in _SENTENCE.split(page[begin : stops[-1]].strip())))
            begin = stops[-1]
    rest = page[begin:].strip()
    return [*out, rest] if rest else out


def _chunk_rows(rows: DataFrame, repair: bool) -> DataFrame:
    """(doc_id, page_number, chunk_index, content) from rows with size, overlap and separators."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = b.to_pydict()
            out = {"doc_id": [], "page_number": [], "chunk_index": [], "content": []}
            for doc, page, text, size, overlap, seps in zip(*(c[k] for k in ("doc_id", "page_number", "content", "size", "overlap", "separators")), strict=True):
                chunks = split_text(text, size, overlap, seps)
                for i, chunk in enumerate(repaired(chunks) if repair else chunks):
                    for k, v in zip(out, (doc, page, i, chunk), strict=True):
                        out[k].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out["doc_id"], pa.int64()), pa.array(out["page_number"], pa.int32()), pa.array(out["chunk_index"], pa.int32()), pa.array(out["content"], pa.string())], names=list(out))

    return rows.mapInArrow(run, "doc_id long, page_number int, chunk_index int, content string")


def _with(pages: DataFrame, size, overlap, separators) -> DataFrame:
    return pages.select("doc_id", "page_number", "content", size.alias("size"), overlap.alias("overlap"), separators.alias("separators"))


def _marks(xs: list[str]) -> F.Column:
    return F.array(*[F.lit(x) for x in xs])


def split_flat(pages: DataFrame, size: int = 1000, overlap: int = 200) -> DataFrame:
    """Flat chunks of each page."""
    return _chunk_rows(_with(pages, F.lit(size), F.lit(overlap), _marks(PROSE)), False)


@F.udtf(returnType="chunk_index int, content string", useArrow=True)
class SplitText:
    """The flat splitter for SQL: a row for each chunk of a text; none for null."""

    def eval(self, content: str, size: int, overlap: int):
        if content is not None:
            yield from enumerate(split_text(content, size, overlap, PROSE))


def register_splitter(spark: SparkSession, name: str = "split_text") -> None:
    """Makes ``SELECT ... FROM pages p, LATERAL split_text(p.content, 1000, 200) s`` work in the session."""
    spark.udtf.register(name, SplitText)


def split_adaptive(pages: DataFrame, repair: bool = False) -> DataFrame:
    """Chunks sized and cut by the content type of their page; ``repair`` moves incomplete sentences on."""
    kind = ts.identify_content_type(F.col("content"))
    size, overlap = fq.adaptive_size(kind)
    marks = F.when(kind == "code", _marks(SEPARATORS["code"])).when(kind == "table", _marks(SEPARATORS["table"])).when(kind == "list", _marks(SEPARATORS["list"])).otherwise(_marks(PROSE))
    return _chunk_rows(_with(pages, size, overlap, marks), repair)


def split_hierarchical(pages: DataFrame) -> DataFrame:
    """(parent, children) of each page as rows: parent_id, parent_index, parent, child_id, child_index, child.

    One pass makes both levels; parents, children and edges are projections of it.
    """
    base = ts.recommend_chunk_size(F.col("density"))
    sizes = fq.hierarchical_sizes(base, ts.recommend_overlap(base))
    rows = pages.select("doc_id", "page_number", "content", ts.overall_density(F.col("content")).alias("density"))
    rows = rows.select("doc_id", "page_number", "content", *[v.alias(k) for k, v in sizes.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                for i, parent in enumerate(split_text(r["content"], r["parent_size"], r["parent_overlap"], LEVELS)):
                    for j, child in enumerate(split_text(parent, r["child_size"], r["child_overlap"], LEVELS)):
                        out.append((r["doc_id"], r["page_number"], i, parent, j, child))
            cols = list(zip(*out, strict=True)) or [[]] * 6
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "page_number", "parent_index", "parent", "child_index", "child"])

    made = rows.mapInArrow(run, "doc_id long, page_number int, parent_index int, parent string, child_index int, child string")
    made = made.withColumn("parent_id", stable_id("doc_id", F.lit("parent"), "page_number", "parent_index"))
    return made.withColumn("child_id", stable_id("parent_id", F.lit("child"), "child_index"))


def parents(levels: DataFrame) -> DataFrame:
    one = levels.where("child_index = 0")
    return one.select(F.col("parent_id").alias("chunk_id"), "doc_id", "page_number", F.col("parent_index").alias("chunk_index"), F.lit("text").alias("chunk_type"), F.lit("parent").alias("chunk_level"), F.col("parent").alias("content"))


def children(levels: DataFrame) -> DataFrame:
    return levels.select(F.col("child_id").alias("chunk_id"), "doc_id", "page_number", F.col("child_index").alias("chunk_index"), F.lit("text").alias("chunk_type"), F.lit("child").alias("chunk_level"), F.col("child").alias("content"))


def edges(levels: DataFrame) -> DataFrame:
    return levels.select(F.col("parent_id").alias("parent_chunk_id"), F.col("child_id").alias("child_chunk_id"), "child_index")


def split_semantic(sentences: DataFrame, key: str | list[str] = "doc_id", order: str = "sentence_index", vector: str = "vector", percentile: float = 0.5) -> DataFrame:
    """Adds semantic_chunk: a new chunk begins after a sentence whose cosine distance to the next is above the percentile (0 to 100) of its document.

    For sentences that have vectors already; their key should be a section of bounded size. ``split_semantic_pages`` begins at the text.
    """
    keys = [key] if isinstance(key, str) else key
    along = Window.partitionBy(*keys).orderBy(order)
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    own, following = F.col(vector), F.lead(vector).over(along)
    distance = 1 - dot(own, following) / F.sqrt(dot(own, own) * dot(following, following))
    rows = sentences.withColumn("distance", F.round(distance, 9))
    threshold = F.percentile("distance", F.lit(percentile / 100)).over(Window.partitionBy(*keys))
    rows = rows.withColumn("breaks", (F.col("distance") > threshold).cast("int"))
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("semantic_chunk", F.coalesce(F.sum("breaks").over(before), F.lit(0)).cast("int")).drop("breaks")


def split_semantic_pages(pages: DataFrame, embed: Callable[[list[str]], np.ndarray] = hashed_counts, percentile: float = 0.5, neighbours: int = 1) -> DataFrame:
    """(doc_id, page_number, chunk_index, content, n_sentences): pages cut where their meaning turns.

    Sentences end with a full stop, question or exclamation mark before white space. Each is embedded together with
    ``neighbours`` sentences on both sides; a chunk ends after a sentence whose cosine distance to the next is above the
    percentile (0 to 100, interpolated) of its page's distances, so the default of 0.5 breaks nearly everywhere. A page is a
    row from start to end: nothing is exchanged, and only the texts to embed leave the JVM. ``embed`` takes texts to
    vectors, 50 at a time. A page of one sentence is one chunk; null and blank pages have none.
    """
    s, far = F.col("s"), F.col("far")
    found = F.filter(F.split("content", r"(?<=[.?!])[\t-\r\x1C-\x20\x85\pZ]+", -1), lambda x: stripped(x) != "")
    first = lambda i: F.greatest(i + 1 - neighbours, F.lit(1))
    windows = F.transform(s, lambda _, i: F.array_join(F.slice(s, first(i), i + 2 + neighbours - first(i)), " "))
    rows = pages.select("doc_id", "page_number", found.alias("s")).where(F.size("s") > 0)
    rows = rows.withColumn("far", neighbour_distances(embed)(windows))
    ranked, rank = F.array_sort(far), (F.size(far) - 1) * F.lit(percentile / 100)
    low = F.element_at("ranked", F.floor("rank").cast("int") + 1)
    high = F.element_at("ranked", F.least(F.floor("rank").cast("int") + 2, F.size(far)))
    rows = rows.withColumns({"ranked": ranked, "rank": rank}).withColumn("limit", F.when(F.size(far) > 0, low + (high - low) * (F.col("rank") - F.floor("rank"))))
    ends = F.filter(F.transform(far, lambda d, i: F.when(d > F.col("limit"), i + 1)), lambda e: e.isNotNull())
    rows = rows.withColumn("ends", F.concat(ends, F.array(F.size(s))))
    rows = rows.select("doc_id", "page_number", "s", F.posexplode(F.transform("ends", lambda e, i: F.struct(F.when(i > 0, F.get("ends", i - 1)).otherwise(0).alias("begin"), e.alias("end")))).alias("chunk_index", "span"))
    size = F.col("span.end") - F.col("span.begin")
    return rows.select("doc_id", "page_number", "chunk_index", F.array_join(F.slice("s", F.col("span.begin") + 1, size), " ").alias("content"), size.alias("n_sentences"))


def all_chunks(*kinds: DataFrame) -> DataFrame:
    """Text, image and table chunks as one table; columns that a kind lacks are null."""
    out = kinds[0]
    for k in kinds[1:]:
        out = out.unionByName(k, allowMissingColumns=True)
    return out


def attach_embeddings(chunks: DataFrame, vectors: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Chunks with their vectors; a chunk without one, or a vector without a chunk, raises an error when the rows are computed."""
    both = chunks.join(vectors.select(key, "embedding", F.lit(True).alias("has_vector")), key, "full_outer")
    both = both.withColumn("missing", F.col("has_vector").isNull() | F.col("content").isNull())
    checked = F.when(F.col("missing"), F.raise_error(F.concat(F.lit("chunk and embedding counts differ at "), F.col(key).cast("string")))).otherwise(F.col("embedding"))
    return both.withColumn("embedding", checked).drop("has_vector", "missing")

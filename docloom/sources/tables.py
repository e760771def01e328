"""Readers and writers: pages, chunks, edges, message contexts, event lines, JDBC."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PAGE_CHARS = 3000
#: White space of Unicode, with the four ASCII separators.
WHITE = "".join(chr(c) for c in [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])

CHUNK = T.StructType([
    T.StructField("chunk_id", T.StringType()), T.StructField("doc_id", T.LongType()), T.StructField("page_number", T.IntegerType()),
    T.StructField("chunk_index", T.IntegerType()), T.StructField("chunk_type", T.StringType()), T.StructField("chunk_level", T.StringType()),
    T.StructField("content", T.StringType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
])
EDGE = T.StructType([T.StructField("parent_chunk_id", T.StringType()), T.StructField("child_chunk_id", T.StringType()), T.StructField("child_index", T.IntegerType())])


def stripped(col: F.Column | str) -> F.Column:
    """The text without white space at its ends."""
    return F.btrim(F.col(col) if isinstance(col, str) else col, F.lit(WHITE))


def stable_id(*parts: F.Column | str) -> F.Column:
    """A deterministic id, so that retried tasks make the same rows."""
    return F.sha2(F.concat_ws("|", *[p if isinstance(p, F.Column) else F.col(p) for p in parts]), 256)


def pages_of(documents: DataFrame, size: int = PAGE_CHARS) -> DataFrame:
    """(doc_id, page_number, content): windows of ``size`` code points, pages with blank text left out.

    One pass cuts a text into its pages, so no page row carries the whole text.
    """
    cut = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{size}}}"), 0)
    rows = documents.where("text IS NOT NULL").select("doc_id", F.posexplode(cut).alias("i", "content"))
    return rows.where(stripped("content") != "").select("doc_id", (F.col("i") + 1).alias("page_number"), "content")


def spread(rows: DataFrame) -> DataFrame:
    """Rows dealt out to all cores where they come in fewer partitions, as from a file of one row group; larger inputs stay as they are.

    For work that costs far more than an exchange of its rows.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def read_pages(spark: SparkSession, path: str, size: int = PAGE_CHARS) -> DataFrame:
    return pages_of(spread(spark.read.parquet(path)), size)


def write_chunks(chunks: DataFrame, path: str, buckets: int = 64) -> dict[str, int]:
    """Write chunks by document bucket; a null type is text, a null level flat, and rows without content are errors.

    Spark sizes the writing tasks: small buckets share one, a large bucket is split over several.
    """
    seen = Observation()
    ready = backfill_defaults(chunks).withColumn("bad", F.col("content").isNull())
    ready = ready.observe(seen, F.count_if(~F.col("bad")).alias("success"), F.count_if("bad").alias("errors"))
    out = ready.where(~F.col("bad")).drop("bad").withColumn("doc_bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)))
    out.hint("rebalance", "doc_bucket").write.mode("overwrite").partitionBy("doc_bucket").parquet(path)
    return {k: int(v or 0) for k, v in seen.get.items()}


def write_edges(edges: DataFrame, path: str) -> int:
    """Write parent-child edges, each pair once; returns their number."""
    seen = Observation()
    once = edges.dropDuplicates(["parent_chunk_id", "child_chunk_id"]).observe(seen, F.count(F.lit(1)).alias("n"))
    once.write.mode("overwrite").parquet(path)
    return int(seen.get["n"])


def backfill_defaults(chunks: DataFrame) -> DataFrame:
    """Older rows: a null chunk_type is text, a null chunk_level is flat."""
    return chunks.withColumns({"chunk_type": F.coalesce("chunk_type", F.lit("text")), "chunk_level": F.coalesce("chunk_level", F.lit("flat"))})


CONTEXT = "chunks array<struct<id:string,content:string,pageNumber:int>>, annotations array<struct<pageNumber:int,explanation:string>>"


def parse_context(messages: DataFrame, column: str = "context") -> DataFrame:
    """Adds context_chunks and context_annotations; JSON that is no object passes through as context_other."""
    parsed = F.from_json(F.col(column), CONTEXT)
    is_object = stripped(column).startswith("{")
    return messages.withColumns({
        "context_chunks": F.when(is_object, parsed["chunks"]), "context_annotations": F.when(is_object, parsed["annotations"]),
        "context_other": F.when(~is_object, F.col(column)),
    })


EVENT = "type string, step string, content string, message string"


def parse_event_lines(lines: DataFrame, column: str = "line") -> DataFrame:
    """The events of ``data: {json}`` lines with their route; other lines and broken JSON are skipped."""
    body = F.when(F.col(column).startswith("data: "), F.substring(F.col(column), 7, 1 << 30))
    event = F.from_json(body, EVENT)
    kind = F.col("event.type")
    route = F.when(kind == "step_complete", "step").when(kind == "chunk", "chunk").when(kind.isin("done", "final_response"), "final").when(kind == "error", "error")
    return lines.withColumn("event", event).where(kind.isNotNull()).withColumn("route", route)


def read_jdbc(spark: SparkSession, url: str, table: str, column: str | None = None, lower: int = 0, upper: int = 0, parts: int = 1, properties: dict | None = None) -> DataFrame:
    """A relational table; with a partition column it is read in parallel ranges."""
    if column is None:
        return spark.read.jdbc(url, table, properties=properties or {})
    return spark.read.jdbc(url, table, column=column, lowerBound=lower, upperBound=upper, numPartitions=parts, properties=properties or {})


def read_jdbc_ranges(spark: SparkSession, url: str, table: str, column: str, parts: int = 8, properties: dict | None = None, quote: str = '"') -> DataFrame:
    """A relational table read in ``parts`` ranges between the least and the greatest value of a numeric column, which the database is asked for.

    Filters and columns asked for later are sent to the database. Rows with a null in the column come with the first range.
    """
    bounds = spark.read.jdbc(url, f"(SELECT MIN({quote}{column}{quote}) AS low, MAX({quote}{column}{quote}) AS high FROM {table}) bounds", properties=properties or {}).first()
    if bounds[0] is None:
        return read_jdbc(spark, url, table, properties=properties)
    return read_jdbc(spark, url, table, column, int(bounds[0]), int(bounds[1]) + 1, parts, properties)


def write_jdbc(df: DataFrame, url: str, table: str, properties: dict | None = None) -> None:
    df.write.jdbc(url, table, mode="append", properties=properties or {})

"""Queries on the batch twins of the streaming jobs (inventory A2-A4, K1-K7, J8)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from docloom.operators import chunking
from docloom.plans.registry import PAGES, query, read, shared
from docloom.plans.texts import pages
from docloom.sources import stored, tables
from docloom.streaming import jobs


@query("a02_stream_pages")
def ingested(spark, sf_dir):
    """Runs the ingestion stream over the documents and reads what it wrote."""
    schema = read(spark, sf_dir, "documents").schema
    out, checkpoint = shared(spark), shared(spark)
    jobs.ingest_stream(spark, f"{sf_dir}/documents.parque?", out, checkpoint, schema).awaitTermination()
    return spark.read.parquet(out).select("doc_id", "page_number", "chunk_index", "chunk_id", "content")


@query("a03_write_chunks", "SELECT count(*) FILTER (text IS NOT NULL) AS success, count(*) FILTER (text IS NULL) AS errors, count(*) FILTER (text IS NOT NULL) AS stored FROM documents")
def written(spark, sf_dir):
    path = shared(spark)
    rows = read(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"), F.lit(None).cast("string").alias("chunk_type"), F.lit(None).cast("string").alias("chunk_level"))
    counts = tables.write_chunks(rows, path)
    stored = spark.read.parquet(path).where("chunk_type = 'text' AND chunk_level = 'flat'")
    return stored.agg(F.lit(counts["success"]).cast("long").alias("success"), F.lit(counts["errors"]).cast("long").alias("errors"), F.count("*").alias("stored"))


@query("a03_replace_chunks", f"WITH {PAGES} SELECT doc_id, page_number, CASE WHEN doc_id % 11 = 0 THEN 'changed ' || doc_id ELSE content END AS content FROM pages_ WHERE doc_id % 11 <> 0 OR page_number = 1")
def replaced(spark, sf_dir):
    """Every eleventh document comes again with one short page; only the buckets of these are rewritten."""
    path, rows = shared(spark), pages(spark, sf_dir)
    stored.write_by_document(rows, path)
    again = rows.where("doc_id % 11 = 0 AND page_number = 1").withColumn("content", F.concat(F.lit("changed "), F.col("doc_id").cast("string")))
    stored.replace_documents(spark, path, again)
    return spark.read.parquet(path).select("doc_id", "page_number", "content")


@query("a04_write_edges", f"WITH {PAGES} SELECT count(*) AS stored, count(*) AS counted FROM pages_")
def edges_written(spark, sf_dir):
    """Every page hangs on its document; each pair comes twice and is kept once."""
    path, page = shared(spark), F.concat_ws("/", "doc_id", "page_number")
    edges = pages(spark, sf_dir).select(F.col("doc_id").cast("string").alias("parent_chunk_id"), page.alias("child_chunk_id"), "page_number").withColumnRenamed("page_number", "child_index")
    n = tables.write_edges(edges.unionAll(edges), path)
    return spark.read.parquet(path).agg(F.count("*").alias("stored"), F.lit(n).cast("long").alias("counted"))


@query("k01_progressive_ingestion", f"WITH {PAGES} SELECT (SELECT count(*) FROM pages_) AS pages, (SELECT count(DISTINCT doc_id) FROM pages_) AS documents, TRUE AS chunks_agree, TRUE AS edges_agree")
def progressive(spark, sf_dir):
    """Runs the stream over the documents, edges included, and holds its own counts against the tables that it wrote."""
    names = [shared(spark) for _ in range(4)]
    jobs.ingest_levels_stream(spark, f"{sf_dir}/documents.parque?", *names, read(spark, sf_dir, "documents").schema).awaitTermination()
    chunks, edges, progress = (spark.read.parquet(n) for n in names[:3])
    told = progress.agg(F.sum("pages"), F.sum("chunks"), F.sum("edges")).first()
    linked = edges.join(chunks.select(F.col("chunk_id").alias("child_chunk_id")), "child_chunk_id").count()
    stored_chunks = chunks.agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("documents"))
    return stored_chunks.select(F.lit(told[0]).alias("pages"), "documents", (F.col("n") == told[1]).alias("chunks_agree"), F.lit(told[2] == linked).alias("edges_agree"))


@query("k01_flat_ingestion")
def flat_ingestion(spark, sf_dir):
    return jobs.stream_chunks(read(spark, sf_dir, "documents")).groupBy("doc_id").agg(F.count("*").alias("chunks"), F.max("page_number").alias("pages"))


query("k02_queue_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) FILTER (event_type = 'purchase') AS completed, count(*) FILTER (event_type = 'error') AS failed FROM events GROUP BY 1")(
    lambda s, d: jobs.queue_windows(read(s, d, "events"))
)
query("k02_success_windows", "WITH e_ AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) - to_hours(h) AS start, event_type FROM events, range(24) r(h)) SELECT start, coalesce(round(count(*) FILTER (event_type = 'purchase') * 100.0::DOUBLE / nullif(count(*) FILTER (event_type IN ('purchase', 'error')), 0), 4), 100.0) AS success_rate FROM e_ GROUP BY 1")(
    lambda s, d: jobs.success_windows(read(s, d, "events"))
)


_LOG = "list_filter(f_.held, lambda h: h > t_.ts - INTERVAL 3600 SECONDS)"


@query("k03_rate_limit", f"""WITH RECURSIVE t_ AS (SELECT user_id AS client, event_id AS request_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
  f_ AS (SELECT client, i, request_id, ts, TRUE AS admitted, [ts] AS held FROM t_ WHERE i = 1
   UNION ALL SELECT t_.client, t_.i, t_.request_id, t_.ts, len({_LOG}) < 4, CASE WHEN len({_LOG}) < 4 THEN list_append({_LOG}, t_.ts) ELSE {_LOG} END FROM f_ JOIN t_ ON t_.client = f_.client AND t_.i = f_.i + 1)
  SELECT client, request_id, ts, admitted FROM f_""")
def limited(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select(F.col("user_id").alias("client"), F.col("event_id").alias("request_id"), "ts")
    return jobs.rate_limit(rows, 4, 3600.0)


@query("k04_assemble_answers", """WITH d_ AS (SELECT user_id AS message_id, event_id AS seq, CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'done' ELSE 'chunk' END AS type, event_type || ' ' AS content FROM events),
  l_ AS (SELECT message_id, min(seq) FILTER (type IN ('done', 'error')) AS last, min_by(type, seq) FILTER (type IN ('done', 'error')) AS ended FROM d_ GROUP BY message_id)
  SELECT l_.message_id, coalesce(string_agg(content, '' ORDER BY seq) FILTER (type = 'chunk' AND (last IS NULL OR seq < last)), '') AS content, any_value(ended) AS ended FROM l_ JOIN d_ USING (message_id) GROUP BY l_.message_id""")
def assembled(spark, sf_dir):
    kind = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "signup", "done").otherwise("chunk")
    rows = read(spark, sf_dir, "events").select(F.col("user_id").alias("message_id"), F.col("event_id").alias("seq"), kind.alias("type"), F.concat(F.col("event_type"), F.lit(" ")).alias("content"))
    return jobs.assemble_answers(rows)


@query("k05_user_sessions", """WITH o_ AS (SELECT user_id, ts, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER w) >= 7200000000, TRUE)::INTEGER AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
  s_ AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM o_) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 2 HOUR AS end, count(*) AS n FROM s_ GROUP BY user_id, sid""")
def sessions(spark, sf_dir):
    return jobs.user_sessions(read(spark, sf_dir, "events"))


@query("k06_cached_hits", "SELECT a.event_id AS lookup_id, b.event_id AS insert_id FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts < a.ts AND b.ts >= a.ts - INTERVAL 2 HOUR WHERE a.event_type = 'view' AND b.event_type = 'purchase'")
def hits(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("key"), "ts", "event_type")
    return jobs.cached_hits(rows.where("event_type = 'view'"), rows.where("event_type = 'purchase'"))


_LIVE = "list_filter(f_.held, lambda h: h.ts > t_.ts - INTERVAL 10 HOURS)"
_NEAR = f"list_sort(list_filter(list_transform({_LIVE}, lambda h: {{'far': -round(list_cosine_similarity(h.v, t_.v), 9), 'id': h.id}}), lambda x: x.far <= -0.3))[1]"


@query("k06_semantic_cache", f"""WITH RECURSIVE t_ AS (SELECT label + 10 * (vec_id // 600) AS key, vec_id AS id, make_timestamp(vec_id * 60000000) AS ts, embedding::DOUBLE[] AS v, row_number() OVER (PARTITION BY label, vec_id // 600 ORDER BY vec_id) AS i FROM embeddings),
  f_ AS (SELECT key, i, id, ts, NULL::BIGINT AS entry_id, NULL::DOUBLE AS similarity, [{{'ts': ts, 'id': id, 'v': v}}] AS held FROM t_ WHERE i = 1
   UNION ALL SELECT t_.key, t_.i, t_.id, t_.ts, ({_NEAR}).id, -({_NEAR}).far, CASE WHEN ({_NEAR}).id IS NULL THEN list_append({_LIVE}, {{'ts': t_.ts, 'id': t_.id, 'v': t_.v}}) ELSE {_LIVE} END FROM f_ JOIN t_ ON t_.key = f_.key AND t_.i = f_.i + 1)
  SELECT key, id, ts, entry_id, similarity FROM f_""")
def answered(spark, sf_dir):
    """Every vector as a question about its document, one a minute, answered by a similar one of its ten hours; a key is a document and ten hours."""
    rows = read(spark, sf_dir, "embeddings").select((F.col("label") + 10 * F.floor(F.col("vec_id") / 600)).alias("key"), F.col("vec_id").alias("id"), F.timestamp_seconds(F.col("vec_id") * 60).alias("ts"), F.col("embedding").alias("vector"))
    return jobs.semantic_cache(rows, 0.3, 36_000.0)


query("k07_without_repeats", "SELECT count(*) AS n FROM (SELECT DISTINCT event_id FROM events)")(
    lambda s, d: jobs.without_repeats(read(s, d, "events").unionAll(read(s, d, "events").where("event_id % 2 = 0")), ["event_id"]).agg(F.count("*").alias("n"))
)


@query("a08_jdbc_customers", "SELECT c_custkey, c_name, c_nationkey, c_acctbal FROM customer WHERE c_nationkey < 12")
def customers(spark, sf_dir):
    """customer written to the embedded database of Spark's distribution and read back in ranges; the filter runs in the database.

    That database lives in the driver's process, so this one asks for a local master; a server's URL works on a cluster.
    """
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("the embedded database serves a local master only")
    url, driver = f"jdbc:derby:memory:docloom{uuid.uuid4().hex};create=true", {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    rows = read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal")
    tables.write_jdbc(rows, url, "customer", driver)
    return tables.read_jdbc_ranges(spark, url, "customer", "c_custkey", 4, driver).where("c_nationkey < 12").select("c_custkey", "c_name", "c_nationkey", "c_acctbal")

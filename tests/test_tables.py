"""JDBC tables through the embedded database that Spark brings along, writers and cache keys."""

import hashlib

from pyspark.sql import functions as F

from docloom.functions import questions as fq
from docloom.sources import tables


def test_jdbc_round_trip_in_parallel_ranges(spark):
    url, driver = "jdbc:derby:memory:docloom;create=true", {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    rows = spark.range(200).select(F.col("id").cast("int").alias("doc_id"), F.concat(F.lit("text é "), F.col("id")).alias("title"))
    tables.write_jdbc(rows.where("doc_id < 100"), url, "documents", driver)
    tables.write_jdbc(rows.where("doc_id >= 100"), url, "documents", driver)
    back = tables.read_jdbc(spark, url, "documents", "doc_id", 0, 200, 4, driver)
    assert back.rdd.getNumPartitions() == 4
    want = sorted(map(tuple, rows.collect()))
    assert sorted((r[0], r[1]) for r in back.collect()) == want
    assert sorted((r[0], r[1]) for r in tables.read_jdbc(spark, url, "documents", properties=driver).collect()) == want
    found = tables.read_jdbc(spark, url, "documents", properties=driver).where("doc_id = 7")
    assert "PushedFilters: [*IsNotNull" in found._jdf.queryExecution().toString()
    assert found.count() == 1


def test_jdbc_ranges_come_from_the_table(spark):
    url, driver = "jdbc:derby:memory:docloomranges;create=true", {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    rows = spark.range(1_000, 1_400).select(F.col("id").alias("doc_id"), (F.col("id") % 7).alias("kind"), F.concat(F.lit("t"), F.col("id")).alias("title"))
    tables.write_jdbc(rows, url, "documents", driver)
    back = tables.read_jdbc_ranges(spark, url, "documents", "doc_id", 4, driver)
    sizes = [r.n for r in back.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 4 and min(sizes) >= 90  # the ranges lie between 1000 and 1400
    found = back.where("kind < 2").select("doc_id", "kind")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "LessThan(kind,2)" in plan and "title" not in plan.split("PushedFilters")[0]
    assert found.count() == rows.where("kind < 2").count()
    tables.write_jdbc(rows.limit(0), url, "nothing", driver)
    assert tables.read_jdbc_ranges(spark, url, "nothing", "doc_id", 4, driver).count() == 0


def test_chunks_are_written_once_with_counts(spark, tmp_path):
    rows = [(str(i), i % 7, None if i % 10 == 0 else f"c{i}", None, None) for i in range(100)]
    frame = spark.createDataFrame(rows, "chunk_id string, doc_id long, content string, chunk_type string, chunk_level string")
    counts = tables.write_chunks(frame, f"file://{tmp_path}/chunks", 5)
    assert counts == {"success": 90, "errors": 10}
    back = spark.read.parquet(f"file://{tmp_path}/chunks")
    assert back.where("chunk_type = 'text' AND chunk_level = 'flat'").count() == 90
    assert back.groupBy("doc_id").agg(F.count_distinct("doc_bucket").alias("n")).where("n > 1").count() == 0


def test_vector_keys(spark):
    frame = spark.createDataFrame([(1, [0.5, -2.0]), (2, [0.5, -2.0]), (3, [0.5]), (4, None)], "i int, v array<float>")
    keys = {r.i: r.k for r in frame.select("i", fq.vector_key(F.col("v")).alias("k")).collect()}
    assert keys[1] == keys[2] == hashlib.sha256(b"0.5,-2.0").hexdigest()[:16]
    assert keys[3] != keys[1]
    assert keys[4] is None


def test_headers_so_far_with_a_cap(spark):
    from docloom.operators.joins import preceding_headers

    pages = spark.createDataFrame([(1, p) for p in range(1, 5)], "doc_id long, page_number int")
    headers = spark.createDataFrame([(1, 1, 0, "a"), (1, 1, 3, "b"), (1, 3, 1, "c")], "doc_id long, page_number int, line_index int, text string")
    got = lambda most: [r.headers for r in preceding_headers(pages, headers, most).orderBy("page_number").collect()]
    assert got(None) == [["a", "b"], ["a", "b"], ["a", "b", "c"], ["a", "b", "c"]]
    assert got(2) == [["a", "b"], ["a", "b"], ["b", "c"], ["b", "c"]]
    assert got(5) == got(None)


def test_rows_of_small_files_are_dealt_out(spark, tmp_path):
    rows = spark.range(1_000)
    rows.coalesce(1).write.parquet(f"file://{tmp_path}/one")
    one = spark.read.parquet(f"file://{tmp_path}/one")
    dealt = tables.spread(one)
    cores = spark.sparkContext.defaultParallelism
    assert dealt.rdd.getNumPartitions() == cores
    assert sorted(r.id for r in dealt.collect()) == list(range(1_000))
    many = rows.repartition(2 * cores)
    assert tables.spread(many) is many

"""Stored tables: only touched buckets are rewritten, and bucketed tables join without an exchange."""

import os

import pytest
from pyspark.sql import functions as F

from docloom.operators import joins
from docloom.sources import stored


def files(path):
    out = {}
    for folder in sorted(os.listdir(path)):
        if folder.startswith("doc_bucket="):
            out[int(folder[11:])] = sorted(f for f in os.listdir(f"{path}/{folder}") if f.endswith(".parquet"))
    return out


def rows(spark, path):
    return {(r.doc_id, r.n) for r in spark.read.parquet(f"file://{path}").collect()}


@pytest.fixture
def table(spark, tmp_path):
    frame = spark.range(200).select((F.col("id") % 40).alias("doc_id"), F.col("id").alias("n"))
    path = f"{tmp_path}/chunks"
    stored.write_by_document(frame, f"file://{path}", buckets=8)
    return path


def bucket_of(spark, ids):
    return {r.b for r in spark.createDataFrame([(i,) for i in ids], "doc_id long").select(stored.document_bucket(buckets=8).alias("b")).collect()}


def test_deletion_leaves_the_files_of_other_buckets(spark, table):
    before, touched = files(table), bucket_of(spark, [3, 17])
    dropped = spark.createDataFrame([(3,), (17,), (17,), (999,)], "doc_id long")
    assert stored.delete_documents(spark, f"file://{table}", dropped, buckets=8) == len(touched)
    after = files(table)
    for bucket, names in before.items():
        assert (after[bucket] == names) == (bucket not in touched)
    assert rows(spark, table) == {(i % 40, i) for i in range(200) if i % 40 not in (3, 17)}
    assert stored.delete_documents(spark, f"file://{table}", dropped, buckets=8) == 0  # again: nothing to do
    assert files(table) == after


def test_a_bucket_may_lose_all_its_documents(spark, table):
    bucket = min(files(table))
    gone = spark.range(40).select(F.col("id").alias("doc_id")).where(stored.document_bucket(buckets=8) == bucket)
    ids = {r.doc_id for r in gone.collect()}
    assert stored.delete_documents(spark, f"file://{table}", gone, buckets=8) == 1
    assert rows(spark, table) == {(i % 40, i) for i in range(200) if i % 40 not in ids}


def test_replacement_of_documents(spark, table):
    before, touched = files(table), bucket_of(spark, [5, 1000])
    stored.replace_documents(spark, f"file://{table}", spark.createDataFrame([(5, -1), (1000, -2)], "doc_id long, n long"), buckets=8)
    after = files(table)
    assert all((after[b] == names) == (b not in touched) for b, names in before.items())
    assert rows(spark, table) == {(i % 40, i) for i in range(200) if i % 40 != 5} | {(5, -1), (1000, -2)}


def test_cascade_over_stored_tables(spark, tmp_path):
    docs = spark.range(30).select(F.col("id").alias("doc_id"))
    names = {}
    for name, frame in {"documents": docs, "chunks": docs.withColumn("n", F.lit(1)), "messages": docs.where("doc_id > 100")}.items():
        names[name] = f"file://{tmp_path}/{name}"
        stored.write_by_document(frame.unionByName(docs.where("doc_id = 0"), allowMissingColumns=True), names[name], buckets=4)
    done = stored.cascade_delete(spark, names, docs.where("doc_id = 7"), buckets=4)
    assert done == {"chunks": 1, "messages": 0, "documents": 1}
    assert spark.read.parquet(names["documents"]).where("doc_id = 7").count() == spark.read.parquet(names["chunks"]).where("doc_id = 7").count() == 0


def test_bucketed_tables_join_without_an_exchange(spark):
    edges = spark.range(300).select((F.col("id") % 50).alias("parent_chunk_id"), F.col("id").alias("child_chunk_id"))
    chunks = spark.range(50).select(F.col("id").alias("chunk_id"), (F.col("id") % 9).alias("doc_id"), F.when(F.col("id") % 2 == 0, "parent").otherwise("flat").alias("chunk_level"))
    docs = spark.range(12).select(F.col("id").alias("doc_id"))
    tables = [("t_edges", edges, "parent_chunk_id"), ("t_chunks", chunks, "chunk_id"), ("t_by_doc", chunks, "doc_id"), ("t_docs", docs, "doc_id")]
    edges, chunks, by_doc, docs = (stored.save_bucketed(df, name, key, 4) for name, df, key in tables)
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for joined, n in ((joins.with_parents(edges, chunks), 300), (joins.is_hierarchical(docs, by_doc), 12)):
            plan = joined._jdf.queryExecution().executedPlan().toString()
            assert "Join" in plan and "Exchange" not in plan
            assert joined.count() == n
        assert "Exchange" in joins.with_parents(edges, by_doc)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
        for name, _, _ in tables:
            spark.sql(f"DROP TABLE {name}")

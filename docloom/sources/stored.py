"""Stored tables that know where a document's rows are: by buckets that can be rewritten alone, and bucketed for joins without an exchange."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders of a table, each with the documents of one hash.
BUCKETS = 64


def document_bucket(key: str = "doc_id", buckets: int = BUCKETS) -> F.Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _write(rows: DataFrame, path: str) -> None:
    """Overwrites the buckets that ``rows`` hold and no others; Spark sizes the writing tasks."""
    rows.hint("rebalance", "doc_bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("doc_bucket").parquet(path)


def write_by_document(rows: DataFrame, path: str, key: str = "doc_id", buckets: int = BUCKETS) -> None:
    """Write a new table with a folder for each document bucket."""
    placed = rows.drop("doc_bucket").withColumn("doc_bucket", document_bucket(key, buckets))
    placed.hint("rebalance", "doc_bucket").write.mode("overwrite").partitionBy("doc_bucket").parquet(path)


def _touched(table: DataFrame, ids: DataFrame, key: str, buckets: int) -> DataFrame:
    """The rows of the table in the buckets of ``ids``; there are ``buckets`` of them at most."""
    numbers = [r.b for r in ids.select(document_bucket(key, buckets).alias("b")).distinct().collect()]
    return table.where(F.col("doc_bucket").isin(numbers))


def delete_documents(spark: SparkSession, path: str, dropped: DataFrame, key: str = "doc_id", buckets: int = BUCKETS) -> int:
    """Rewrite a stored table without the rows of ``dropped`` (``key``); returns the number of buckets rewritten or emptied.

    Only buckets that hold a dropped document are read and replaced; the files of the others stay as they are. Spark sends
    the dropped ids to all tasks if they are small and joins them by exchange if not. Running it again changes nothing.
    """
    ids = dropped.select(key).distinct()
    table = spark.read.parquet(path)
    mine = _touched(table, ids, key, buckets)
    hit = [r.doc_bucket for r in mine.join(ids, key, "left_semi").select("doc_bucket").distinct().collect()]
    kept = table.where(F.col("doc_bucket").isin(hit)).join(ids, key, "left_anti").select(*table.columns)
    left = {r.doc_bucket for r in kept.select("doc_bucket").distinct().collect()}
    if left:
        _write(kept, path)
    for bucket in set(hit) - left:  # a bucket without rows is not in what was written
        spark.createDataFrame([], table.drop("doc_bucket").schema).write.mode("overwrite").parquet(f"{path}/doc_bucket={bucket}")
    return len(hit)


def cascade_delete(spark: SparkSession, paths: dict[str, str], dropped: DataFrame, key: str = "doc_id", buckets: int = BUCKETS) -> dict[str, int]:
    """Delete documents from all stored tables that hang on them, each with the document's ``key``; the documents' own table comes last.

    Each table is left whole or rewritten, and a run that broke off may be repeated.
    """
    order = sorted(paths, key=lambda name: name == "documents")
    return {name: delete_documents(spark, paths[name], dropped, key, buckets) for name in order}


def replace_documents(spark: SparkSession, path: str, rows: DataFrame, key: str = "doc_id", buckets: int = BUCKETS) -> None:
    """Put in the rows of new or changed documents in place of all earlier rows of these documents; other buckets stay as they are."""
    table = spark.read.parquet(path)
    ids = rows.select(key).distinct()
    kept = _touched(table, ids, key, buckets).join(ids, key, "left_anti").select(*table.columns)
    _write(kept.unionByName(rows.drop("doc_bucket").withColumn("doc_bucket", document_bucket(key, buckets)), allowMissingColumns=True), path)


def save_bucketed(rows: DataFrame, name: str, key: str, buckets: int = BUCKETS) -> DataFrame:
    """Save a table in buckets by ``key``, sorted within them; tables of equal number of buckets join on their keys without an exchange."""
    rows.repartition(buckets, key).write.mode("overwrite").bucketBy(buckets, key).sortBy(key).saveAsTable(name)
    return rows.sparkSession.table(name)

"""Shared helpers: written intermediate tables and the word rules of the operators."""

from __future__ import annotations

import gc
import tempfile
import uuid
from weakref import WeakKeyDictionary

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_local: dict[str, str] = {}
_written: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
#: Records in an Arrow batch sent to Python; keeps batches of very long texts small.
BATCH_ROWS = 512


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Where the setting is missing (local tests) one temporary folder is made for the application.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        name = spark.sparkContext.applicationId
        if name not in _local:
            _local[name] = "file://" + tempfile.mkdtemp(prefix="docloom-")
        folder = _local[name]
    return folder


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the written table: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    _written[back] = path
    return back


def discard(*tables: DataFrame) -> None:
    """Delete written steps that nothing reads any more; what ``materialize`` did not write is left alone."""
    for df in tables:
        if path := _written.pop(df, None):
            jvm = df.sparkSession._jvm
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(place, True)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner remove the shuffle files of finished steps.

    It does so only when the driver's JVM collects garbage, which between large steps may take too long
    for the executors' disks.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def small_batches(spark: SparkSession) -> None:
    """Send few rows at a time to Python, as single texts may be very long; Spark bounds a batch in bytes too."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def numbered(df: DataFrame, order: list[Column], label: str, within: tuple[str, ...] = (), name: str = "place") -> DataFrame:
    """``df`` with the place (from 0) of each row in the given order, counted anew for each value of ``within``.

    Rows are sorted over all partitions and written; after that only a count for each partition (and value of
    ``within`` in it) is added up, so no task holds a whole group. Rows alike in ``order`` are spread as well.
    """
    tied = df.withColumn("at", F.monotonically_increasing_id())
    ordered = tied.orderBy(*within, *order, "at").withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33))
    ordered = materialize(ordered, label)
    before = Window.partitionBy(*within).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = ordered.groupBy(*within, "part").agg(F.count("*").alias("n"), F.min("at").alias("begin"))
    parts = parts.select(*within, "part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("begin")).alias("shift"))
    return ordered.join(parts, [*within, "part"]).withColumn(name, F.col("at") + F.col("shift")).drop("at", "part", "shift")


def utf8(text: str | None) -> bytes:
    """UTF-8 of a text; null is empty."""
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def lower_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z (and nothing else) in lower case."""
    return [] if text is None else utf8(text).lower().split()


def table(columns: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

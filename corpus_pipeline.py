"""Corpus preparation: five stages over documents, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import decontaminate as leaks
from docloom.llm import hd_langid, line_dedup, mixing, simhash
from docloom.llm.common import materialize

#: A closest prototype with less than this cosine is no better than chance (vectors have 1,024 places).
LEAST_COSINE = 0.05
#: Texts of so many characters need more: by chance letters reach 0.18 there, and held-out documents have 0.26 at least.
LONG_TEXT, LEAST_COSINE_LONG = 1000, 0.2


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters go, null texts among them, and those that resemble no learned language.

    Rows are judged one by one, so repeated rows stay or go alike; a null id counts as training text.
    """
    prototypes = hd_langid.train(docs.where(hd_langid.fold("doc_id", 4) != 2))
    least = F.when(F.length("text") >= LONG_TEXT, LEAST_COSINE_LONG).otherwise(LEAST_COSINE)
    known = hd_langid.predict(docs, prototypes).where((F.col("lang_pred") != "und") & (F.col("score") >= least))
    return known.select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One line stays of each component of near-duplicate lines; documents that lose all their lines go.

    The first line by document id and place stays; a null id comes first, and null texts stay.
    """
    return line_dedup.dedup_lines(docs, drop_emptied=True)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document stays of each group of near duplicates (five-word shingles, similarity 0.8 or more): that of the smallest id.

    Null and wordless texts count as equal; rows with a null id all stay.
    """
    return simhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go; null texts hold none, and repeated rows go alike."""
    return leaks.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it, numbered by copy_number; a null source is one more source."""
    return mixing.sample(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", dedup_lines),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontaminate),
    ("source_mixing", mix_sources),
]
#: Trained profiles, signatures and fingerprints have no SQL form; a test compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over documents; n_chars stays that of the text as it was read."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs

"""All registered queries of the library with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docloom.plans import context, operations, questions, retrieval, streams, texts  # noqa: F401
from docloom.plans.registry import ORACLES, QUERIES


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["z01_question_context"](spark, sf_dir)


def queries() -> dict:
    return QUERIES


def oracle_sql() -> dict[str, str]:
    return ORACLES

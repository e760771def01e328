"""Registration of queries with their SQL twins, and SQL fragments that many share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared(spark) -> str:
    """A new path in the folder that all executors share."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="docloom-")
    return f"{folder.rstrip('/')}/{uuid.uuid4().hex}"


#: White space of Unicode as DuckDB's trim takes it.
TRIM = "||".join(f"chr({c})" for c in [9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288])
PAGES = f"""pages_ AS (
  SELECT doc_id, (i + 1)::INTEGER AS page_number, substr(text, 1 + 3000 * i, 3000) AS content
  FROM (SELECT doc_id, text, unnest(range(0, greatest(1, ceil(length(text) / 3000.0)::BIGINT))) AS i FROM documents WHERE text IS NOT NULL)
  WHERE trim(substr(text, 1 + 3000 * i, 3000), {TRIM}) <> '')"""


def count_re(text: str, pattern: str) -> str:
    return f"len(regexp_extract_all({text}, '{pattern}'))"


def crc32(text: str) -> str:
    """CRC-32 of the UTF-8 bytes of a text, bit by bit."""
    step = "lambda d, k: xor(d >> 1, 3988292384 * (d & 1))"
    octets = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: ('0x' || h)::BIGINT)"
    return f"xor(4294967295, list_reduce({octets}, lambda c, x: list_reduce(range(8), {step}, xor(c, x)), 4294967295::BIGINT))"


def word_set(text: str) -> str:
    return rf"list_distinct(regexp_extract_all(lower({text}), '[\p{{L}}\p{{N}}_]+'))"


def bounded(alternatives: str) -> str:
    """Whole words for RE2, which has no look-around: what stands beside a word is consumed.

    An alternative that ends in a percent sign ends at a boundary where a word begins.
    """
    inside, outside = r"[\p{L}\p{N}_]", r"[^\p{L}\p{N}_]"
    signs = [a for a in alternatives.split("|") if a.endswith("%")]
    words = "|".join(a for a in alternatives.split("|") if not a.endswith("%"))
    out = rf"(?i)(?:^|{outside})(?:{words})(?:$|{outside})"
    return out + "".join(rf"|(?:^|{outside}){a}{inside}" for a in signs)

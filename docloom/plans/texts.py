"""Queries on page text: reading, densities, content classes, counts (inventory A1, A7, B1-B14)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import text_stats as ts
from docloom.plans.registry import PAGES, TRIM, count_re, query, read
from docloom.sources import tables


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.pages_of(tables.spread(read(spark, sf_dir, "documents").select("doc_id", "text")))


query("a01_read_pages", f"WITH {PAGES} SELECT doc_id, page_number, content FROM pages_")(pages)

WS = r"[\t-\r\x1C-\x20\x85\pZ]"
DIGIT = r"[\p{Nd}²³¹⁰⁴-⁹₀-₉]"
SPECIAL_SQL = "'$%&*+=<>|~^_' || chr(92) || '/#@`'"


def _per(count: str, norm: float) -> str:
    return f"least({count} / length(content) / {norm}::DOUBLE, 1.0::DOUBLE)"


def _minus(chars: str, text: str = "content") -> str:
    return f"(length({text}) - length(translate({text}, {chars}, '')))"


DENSITY = {
    "token": _per(count_re("content", r"[\p{L}\p{N}_]+"), 0.25),
    "punctuation": _per(_minus("'.,;:!?()[]{}\"-'"), 0.20),
    "special": _per(_minus(SPECIAL_SQL), 0.15),
    "numeric": _per(count_re("content", DIGIT), 0.30),
    "line": _per(_minus("chr(10)"), 0.10),
    "whitespace": f"greatest(0.0::DOUBLE, 1 - {count_re('content', WS)} / length(content) / 0.30::DOUBLE)",
}
OVERALL = "least(1.0::DOUBLE, 0.30::DOUBLE * special + 0.25::DOUBLE * numeric + 0.20::DOUBLE * line + 0.10::DOUBLE * punctuation + 0.10::DOUBLE * token + 0.05::DOUBLE * whitespace)"
DENSE = f"{PAGES}, d_ AS (SELECT doc_id, page_number, content, {', '.join(f'{v} AS {k}' for k, v in DENSITY.items())} FROM pages_), o_ AS (SELECT *, {OVERALL} AS overall FROM d_)"

for number, (name, key) in enumerate([("token", "token"), ("punctuation", "punctuation"), ("special_char", "special"), ("numeric", "numeric"), ("line_break", "line"), ("whitespace", "whitespace")], 1):

    def _density(spark, sf_dir, f=getattr(ts, f"{name}_density")):
        return pages(spark, sf_dir).select("doc_id", "page_number", F.round(f(F.col("content")), 6).alias("density"))

    query(f"b{number:02}_{name}_density", f"WITH {DENSE} SELECT doc_id, page_number, round({key}, 6) AS density FROM d_")(_density)


@query("b07_overall_density", f"WITH {DENSE} SELECT doc_id, page_number, round(overall, 6) AS density FROM o_")
def overall(spark, sf_dir):
    return pages(spark, sf_dir).select("doc_id", "page_number", F.round(ts.overall_density(F.col("content")), 6).alias("density"))


CLASS = "CASE WHEN special > 0.4 OR numeric > 0.5 OR line > 0.6 THEN 'structured' WHEN special > 0.2 OR numeric > 0.3 THEN 'technical' WHEN overall > 0.6 THEN 'mixed' ELSE 'narrative' END"


@query("b08_classify_density", f"WITH {DENSE} SELECT doc_id, page_number, {CLASS} AS class FROM o_")
def classify(spark, sf_dir):
    return pages(spark, sf_dir).select("doc_id", "page_number", ts.classify_density(F.col("content")).alias("class"))


SIZE = "greatest(500, least(2000, 2000 - trunc(overall * 1500)::INTEGER))"


@query("b09_recommend_chunk_size", f"WITH {DENSE}, s_ AS (SELECT *, {SIZE} AS size FROM o_) SELECT doc_id, page_number, size, greatest(50, least(400, trunc(size * 0.15::DOUBLE)::INTEGER)) AS overlap FROM s_")
def recommend(spark, sf_dir):
    sized = pages(spark, sf_dir).select("doc_id", "page_number", ts.recommend_chunk_size(ts.overall_density(F.col("content"))).alias("size"))
    return sized.withColumn("overlap", ts.recommend_overlap(F.col("size")))


NUMBERED = r"(?i)^([0-9]+\.|[0-9]+\.[0-9]+\.?|[\p{L}\p{N}_]+[\t-\r\x1C-\x20\x85\pZ]+[0-9]+|Chapter[\t-\r\x1C-\x20\x85\pZ]+[0-9]+|Section[\t-\r\x1C-\x20\x85\pZ]+[0-9]+)"


def header_sql(t: str) -> str:
    caps = f"{count_re(t, '[[:upper:]]') if False else count_re(t, chr(92) + 'p{Lu}')} > 0.7::DOUBLE * {count_re(t, chr(92) + 'p{L}')}"
    return f"CASE WHEN length({t}) < 100 THEN CASE WHEN {caps} THEN 'all_caps' WHEN regexp_matches({t}, '{NUMBERED}') THEN 'numbered_section' END END"


def gate_sql(t: str) -> str:
    return rf"(contains({t}, '|') OR contains({t}, chr(9)||chr(9)) OR regexp_matches({t}, '[\t-\r\x1C-\x20\x85\pZ]{{4,}}'))"


def list_sql(t: str) -> str:
    return rf"(regexp_matches({t}, '^[•\-*◦▪][\t-\r\x1C-\x20\x85\pZ]+') OR regexp_matches({t}, '^[0-9]+[.)][\t-\r\x1C-\x20\x85\pZ]+'))"


CONTENT_TYPE = rf"""CASE WHEN bare = '' THEN 'paragraph' WHEN {header_sql("bare")} IS NOT NULL THEN 'header'
  WHEN {gate_sql("content")} AND ({_minus("'|'")} >= 2 OR {count_re("content", "[\\t-\\r\\x1C-\\x20\\x85\\pZ]{4,}")} >= 2) THEN 'table'
  WHEN {list_sql("bare")} THEN 'list'
  WHEN len(string_split(content, chr(10))) > 1
   AND len(list_filter(string_split(content, chr(10)), lambda x: starts_with(x, '    ') OR starts_with(x, chr(9)))) > 0.5 * len(string_split(content, chr(10)))
   AND {_minus("'{}[]()<>=;:'")} > 0.05 * length(content) THEN 'code'
  ELSE 'paragraph' END"""
# Lines of pages serve as short texts, so that every class turns up.
LINES = f"{PAGES}, lines_ AS (SELECT doc_id, page_number, (i - 1)::INTEGER AS line_index, l[i] AS content, trim(l[i], {TRIM}) AS bare FROM (SELECT doc_id, page_number, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, page_number, string_split(content, chr(10)) AS l FROM pages_)))"


def lines(spark, sf_dir):
    split = pages(spark, sf_dir).select("doc_id", "page_number", F.posexplode(F.split("content", "\n", -1)).alias("line_index", "content"))
    return split


@query("b10_identify_content_type", f"WITH {LINES} SELECT doc_id, page_number, line_index, {CONTENT_TYPE} AS content_type FROM lines_")
def content_type(spark, sf_dir):
    return lines(spark, sf_dir).select("doc_id", "page_number", "line_index", ts.identify_content_type(F.col("content")).alias("content_type"))


STRUCTURE = f"""{LINES}, kinds_ AS (SELECT *, CASE WHEN bare = '' THEN NULL WHEN {header_sql("bare")} IS NOT NULL THEN 'header' WHEN {gate_sql("content")} THEN 'table' WHEN {list_sql("bare")} THEN 'list' END AS kind,
  CASE WHEN bare <> '' THEN {header_sql("bare")} END AS header_type FROM lines_)"""


def detect_structure(page_rows: DataFrame) -> DataFrame:
    """(doc_id, page_number, line_index, kind, header_type, text) of the lines that are headers, tables or lists; headers open sections."""
    split = page_rows.select("doc_id", "page_number", F.posexplode(F.split("content", "\n", -1)).alias("line_index", "line"))
    bare = tables.stripped("line")
    found = split.select("doc_id", "page_number", "line_index", ts.line_kind(F.col("line")).alias("kind"), F.when(bare != "", ts.header_type(bare)).alias("header_type"), bare.alias("text"))
    return found.where("kind IS NOT NULL")


@query("b11_detect_structure", f"WITH {STRUCTURE} SELECT doc_id, page_number, line_index, kind, header_type, bare AS text FROM kinds_ WHERE kind IS NOT NULL")
def structure(spark, sf_dir):
    return detect_structure(pages(spark, sf_dir))


@query("b12_chunk_counts", rf"WITH {PAGES} SELECT doc_id, page_number, length(content)::INTEGER AS char_count, len(regexp_extract_all(content, '[^\t-\r\x1C-\x20\x85\pZ]+'))::INTEGER AS word_count, {count_re('content', '[.!?]+')}::INTEGER AS sentence_count FROM pages_")
def counts(spark, sf_dir):
    return pages(spark, sf_dir).select("doc_id", "page_number", *[v.alias(k) for k, v in ts.chunk_counts(F.col("content")).items()])


# Documents have few pipes; commas and full stops stand in, as lines of cells.
PIPED = "translate(content, ',.', '|' || chr(9))"


@query("b13_table_info", f"WITH {PAGES} SELECT doc_id, page_number, len(string_split(content, chr(10)))::INTEGER AS rows, contains(t, '|') AS has_pipes, CASE WHEN contains(t, '|') THEN list_max(list_transform(string_split(t, chr(10)), lambda x: length(x) - length(replace(x, '|', ''))))::INTEGER + 1 END AS estimated_columns FROM (SELECT *, {PIPED} AS t FROM pages_)")
def info(spark, sf_dir):
    t = F.translate("content", ",.", "|\t")
    return pages(spark, sf_dir).select("doc_id", "page_number", *[v.alias(k) for k, v in ts.table_info(t).items()])


@query("b14_table_shape", f"""WITH {PAGES}, t_ AS (SELECT doc_id, page_number, CASE WHEN page_number % 3 = 0 THEN content END AS html, CASE WHEN page_number % 2 = 0 THEN '' END AS markdown, CASE WHEN page_number % 5 = 4 THEN NULL ELSE {PIPED} END AS t FROM pages_),
  l_ AS (SELECT *, list_filter(string_split(coalesce(t, ''), chr(10)), lambda x: x <> '') AS l FROM t_)
  SELECT doc_id, page_number, CASE WHEN coalesce(t, '') = '' THEN 0 ELSE length(t) - length(replace(t, chr(10), '')) + 1 END::INTEGER AS rows,
   CASE WHEN contains(coalesce(t, ''), '|') THEN list_max(list_transform(l, lambda x: length(x) - length(replace(x, '|', '')))) + 1 WHEN contains(coalesce(t, ''), chr(9)) THEN list_max(list_transform(l, lambda x: length(x) - length(replace(x, chr(9), '')))) + 1 ELSE 0 END::INTEGER AS columns,
   coalesce(nullif(html, ''), nullif(markdown, ''), nullif(t, ''), '') AS data FROM l_""")
def shape(spark, sf_dir):
    html, markdown = F.when(F.col("page_number") % 3 == 0, F.col("content")), F.when(F.col("page_number") % 2 == 0, F.lit(""))
    text = F.when(F.col("page_number") % 5 == 4, None).otherwise(F.translate("content", ",.", "|\t"))
    return pages(spark, sf_dir).select("doc_id", "page_number", *[v.alias(k) for k, v in ts.table_shape(html, markdown, text).items()])

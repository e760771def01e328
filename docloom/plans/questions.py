"""Queries on sentences, questions and labels (inventory B15-B38, E9, F4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions import questions as fq
from docloom.functions import text_stats as ts
from docloom.plans.registry import PAGES, TRIM, bounded, count_re, query, read, word_set
from docloom.plans.texts import CONTENT_TYPE, DENSE, LINES, SIZE, lines, pages

# Openings put before users' messages, so that every branch of the classifiers is met.
OPENINGS = [
    "What is the definition of", "Explain how and why, or describe:", "How many", "Compare both", "id 42", 'Find "exact name" in', "Is it so? Or not? And",
    "Summarise", "Which figure and which table or chart", "why", "What percentage", "According to the results, however,",
]
_ARRAY = "[" + ", ".join("'" + o + "'" for o in OPENINGS) + "]"
QUESTIONS = f"""questions_ AS (SELECT conv_id * 100 + turn AS query_id, {_ARRAY}[((conv_id + turn) % {len(OPENINGS)} + 1)::INTEGER] || ' ' || text AS query FROM conversations WHERE role = 'user' AND text IS NOT NULL)"""


def questions(spark, sf_dir):
    messages = read(spark, sf_dir, "conversations").where("role = 'user' AND text IS NOT NULL")
    opening = F.element_at(F.array(*[F.lit(o) for o in OPENINGS]), ((F.col("conv_id") + F.col("turn")) % len(OPENINGS) + 1).cast("int"))
    return messages.select((F.col("conv_id") * 100 + F.col("turn")).alias("query_id"), F.concat(opening, F.lit(" "), "text").alias("query"))


SENTENCES = rf"""{PAGES}, sentences_ AS (SELECT doc_id, page_number, (i - 1)::INTEGER AS sentence_index, s[i] AS content FROM (
  SELECT doc_id, page_number, s, unnest(range(1, len(s) + 1)) AS i FROM (
   SELECT doc_id, page_number, list_filter(list_transform(string_split(regexp_replace(content, '([.!?])[\t-\r\x1C-\x20\x85\pZ]+([A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: trim(x, {TRIM})), lambda x: x <> '') AS s FROM pages_)))"""


def sentences(spark, sf_dir):
    return sentences_of(pages(spark, sf_dir))


def sentences_of(page_rows):
    """(doc_id, page_number, sentence_index, content); the index counts all sentences of a page from 0."""
    return page_rows.select("doc_id", "page_number", F.posexplode(fq.split_sentences(F.col("content"))).alias("sentence_index", "content"))


query("b15_split_sentences", f"WITH {SENTENCES} SELECT * FROM sentences_")(sentences)

_flag = lambda p: f"regexp_matches(content, '{bounded(p)}')::INTEGER"
CRITICAL = f"""{SENTENCES}, critical_ AS (SELECT * FROM (SELECT *, length(content)::INTEGER AS char_count, ({' + '.join(_flag(p) for p in fq.CRITICAL)})::INTEGER AS matched_patterns FROM sentences_)
  WHERE char_count BETWEEN 10 AND 500 AND (matched_patterns > 0 OR char_count < 150))"""


def critical_of(sentence_rows, shortest: int = 10, longest: int = 500, include_short: bool = True):
    """Sentences with a critical pattern, or short ones, with their counts; the length filter comes before the patterns."""
    sized = sentence_rows.withColumn("char_count", F.length("content")).where(F.col("char_count").between(shortest, longest))
    marked = sized.withColumn("matched_patterns", fq.critical_matches(F.col("content"))).withColumn("is_critical", F.col("matched_patterns") > 0).withColumn("is_short", F.col("char_count") < 150)
    return marked.where(F.col("is_critical") | (F.col("is_short") & F.lit(include_short)))


@query("b16_critical_sentences", f"WITH {CRITICAL} SELECT doc_id, page_number, sentence_index, content, char_count, matched_patterns, matched_patterns > 0 AS is_critical, char_count < 150 AS is_short FROM critical_")
def critical(spark, sf_dir):
    return critical_of(sentences(spark, sf_dir))


_any = lambda ps, t: "(" + " OR ".join(f"regexp_matches({t}, '{bounded(p)}')" for p in ps) + ")"


@query("b17_detail_query", f"WITH {QUESTIONS} SELECT query_id, {_any(fq.DETAIL, 'query')} AS is_detail FROM questions_")
def detail(spark, sf_dir):
    return questions(spark, sf_dir).select("query_id", fq.is_detail_query(F.col("query")).alias("is_detail"))


WORDS_N = count_re("query", r"[^\t-\r\x1C-\x20\x85\pZ]+")
COMPLEX = f"(({WORDS_N} > 15)::INTEGER + contains(lower(query), ' and ')::INTEGER + contains(lower(query), ' or ')::INTEGER + (length(query) - length(replace(query, '?', '')) > 1)::INTEGER + regexp_matches(lower(query), '{'|'.join(fq.COMPARING)}')::INTEGER) >= 2"


@query("b18_complex_query", f"WITH {QUESTIONS} SELECT query_id, {COMPLEX} AS is_complex FROM questions_")
def complex_query(spark, sf_dir):
    return questions(spark, sf_dir).select("query_id", fq.is_complex_query(F.col("query")).alias("is_complex"))


_KW = rf"""(regexp_matches(query, '"[\p{{L}}\p{{N}}_\t-\r\x1C-\x20\x85\pZ]+"')::INTEGER + regexp_matches(query, '[0-9]')::INTEGER + regexp_matches(lower(query), '{bounded(fq.KEYWORD_WORDS)}')::INTEGER + ({WORDS_N} < 5)::INTEGER) / 4.0::DOUBLE"""
_SEM = rf"(regexp_matches(lower(query), '{bounded(fq.SEMANTIC_WORDS)}')::INTEGER + ({WORDS_N} > 10)::INTEGER + contains(query, '?')::INTEGER) / 3.0::DOUBLE"


@query("b19_adaptive_weights", f"""WITH {QUESTIONS}, w_ AS (SELECT query_id, {_KW} AS kw, {_SEM} AS sem FROM questions_)
  SELECT query_id, CASE WHEN kw > sem + 0.3::DOUBLE THEN 0.4::DOUBLE WHEN sem > kw + 0.3::DOUBLE THEN 0.85::DOUBLE ELSE 0.7::DOUBLE END AS semantic_weight,
   CASE WHEN kw > sem + 0.3::DOUBLE THEN 0.6::DOUBLE WHEN sem > kw + 0.3::DOUBLE THEN 0.15::DOUBLE ELSE 0.3::DOUBLE END AS keyword_weight FROM w_""")
def weights(spark, sf_dir):
    semantic, keyword = fq.adaptive_weights(F.col("query"))
    return questions(spark, sf_dir).select("query_id", semantic.alias("semantic_weight"), keyword.alias("keyword_weight"))


_TYPES = ["factual", "analytical", "comparative", "follow-up", "clarification", "other"]
_LEVELS = ["simple", "moderate", "complex", "odd"]
TYPED = "typed_ AS (SELECT doc_id AS query_id, [" + ", ".join(f"'{t}'" for t in _TYPES) + "][(doc_id % 6 + 1)::INTEGER] AS kind, [" + ", ".join(f"'{t}'" for t in _LEVELS) + "][(length(text) % 4 + 1)::INTEGER] AS complexity FROM documents WHERE text IS NOT NULL)"


def typed(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").where("text IS NOT NULL")
    pick = lambda xs, i: F.element_at(F.array(*[F.lit(x) for x in xs]), (i + 1).cast("int"))
    return docs.select(F.col("doc_id").alias("query_id"), pick(_TYPES, F.col("doc_id") % 6).alias("kind"), pick(_LEVELS, F.length("text") % 4).alias("complexity"))


@query("b20_route_query", f"""WITH {TYPED} SELECT query_id, route, CASE route WHEN 'fast_path' THEN 3 WHEN 'reasoning_path' THEN 40 ELSE 5 END AS chunk_limit FROM (
  SELECT query_id, CASE WHEN kind IN ('follow-up', 'clarification') THEN 'context_aware_path' WHEN complexity = 'complex' THEN 'reasoning_path' ELSE 'fast_path' END AS route FROM typed_)""")
def route(spark, sf_dir):
    way, limit = fq.route_query(F.col("kind"), F.col("complexity"))
    return typed(spark, sf_dir).select("query_id", way.alias("route"), limit.alias("chunk_limit"))


@query("b21_normalise_classification", f"""WITH {TYPED} SELECT query_id, CASE WHEN kind = 'other' THEN 'factual' ELSE kind END AS query_type, CASE WHEN complexity = 'odd' THEN 'simple' ELSE complexity END AS complexity, complexity IN ('moderate', 'complex') AS requires_cot FROM typed_""")
def classification(spark, sf_dir):
    answer = F.to_json(F.struct(F.col("kind").alias("query_type"), "complexity"))
    kind, level, cot = fq.normalise_classification(answer)
    return typed(spark, sf_dir).select("query_id", kind.alias("query_type"), level.alias("complexity"), cot.alias("requires_cot"))


@query("b22_token_cap", f"WITH {TYPED} SELECT query_id, CASE complexity WHEN 'simple' THEN 1200 WHEN 'complex' THEN 3000 ELSE 2000 END AS cap FROM typed_")
def cap(spark, sf_dir):
    return typed(spark, sf_dir).select("query_id", fq.token_cap(F.col("complexity")).alias("cap"))


@query("b23_adaptive_size", f"""WITH {LINES}, t_ AS (SELECT doc_id, page_number, line_index, {CONTENT_TYPE} AS kind FROM lines_),
  s_ AS (SELECT *, CASE kind WHEN 'header' THEN 650 WHEN 'paragraph' THEN 1250 WHEN 'code' THEN 1200 ELSE 1000 END AS size FROM t_),
  o_ AS (SELECT *, trunc(size * 0.15::DOUBLE)::INTEGER AS base FROM s_)
  SELECT doc_id, page_number, line_index, size, least(greatest(50, least(400, CASE WHEN kind = 'header' THEN trunc(base * 0.7::DOUBLE)::INTEGER WHEN kind IN ('table', 'code') THEN trunc(base * 1.2::DOUBLE)::INTEGER ELSE base END)), size // 2)::INTEGER AS overlap FROM o_""")
def sizes(spark, sf_dir):
    size, overlap = fq.adaptive_size(F.col("kind"))
    kinds = lines(spark, sf_dir).select("doc_id", "page_number", "line_index", ts.identify_content_type(F.col("content")).alias("kind"))
    return kinds.select("doc_id", "page_number", "line_index", size.alias("size"), overlap.alias("overlap"))


@query("b24_hierarchical_sizes", f"""WITH {DENSE}, s_ AS (SELECT doc_id, page_number, {SIZE} AS base, greatest(50, least(400, trunc(({SIZE}) * 0.15::DOUBLE)::INTEGER)) AS ov FROM o_),
  p_ AS (SELECT doc_id, page_number, greatest(500, least(3000, trunc(base * 1.5::DOUBLE)::INTEGER)) AS parent_size, trunc(ov * 1.5::DOUBLE)::INTEGER AS parent_overlap FROM s_)
  SELECT *, greatest(250, least(600, trunc(parent_size * 0.2::DOUBLE)::INTEGER)) AS child_size, trunc(parent_overlap * 0.2::DOUBLE)::INTEGER AS child_overlap FROM p_""")
def parent_sizes(spark, sf_dir):
    base = ts.recommend_chunk_size(ts.overall_density(F.col("content")))
    sized = pages(spark, sf_dir).select("doc_id", "page_number", base.alias("base"), ts.recommend_overlap(base).alias("ov"))
    return sized.select("doc_id", "page_number", *[v.alias(k) for k, v in fq.hierarchical_sizes(F.col("base"), F.col("ov")).items()])


@query("b25_format_chunk", f"""WITH {PAGES} SELECT doc_id, page_number, CASE WHEN page_number % 2 = 0 THEN '[Page ' || page_number || ' - Image at bbox (' || printf('%.1f', doc_id % 100 / 10.0::DOUBLE) || ', 2.5, ' || printf('%.1f', doc_id % 100 + 100.0::DOUBLE) || ', 90.0)]:' || chr(10) || 'Image ID: ' || doc_id || chr(10) || content ELSE '[Page ' || page_number || ']: ' || content END AS formatted FROM pages_""")
def formatted(spark, sf_dir):
    box = F.when(F.col("page_number") % 2 == 0, F.array(F.col("doc_id") % 100 / F.lit(10.0), F.lit(2.5), (F.col("doc_id") % 100 + F.lit(100.0)), F.lit(90.0)))
    return pages(spark, sf_dir).select("doc_id", "page_number", fq.format_chunk(F.col("page_number"), F.col("content"), box, F.col("doc_id").cast("string")).alias("formatted"))


@query("b25_context_text", f"""WITH {PAGES} SELECT doc_id, string_agg('[Page ' || page_number || ']' || chr(10) || content, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY page_number) AS context,
  string_agg(CASE WHEN page_number <= 3 THEN substr(content, 1, 500) END, chr(10) ORDER BY page_number) AS summary_context FROM pages_ GROUP BY doc_id""")
def context_text(spark, sf_dir):
    parts = F.sort_array(F.collect_list(F.struct("page_number", "content")))
    grouped = pages(spark, sf_dir).groupBy("doc_id").agg(parts.alias("p"))
    whole = F.transform("p", lambda x: F.concat(F.lit("[Page "), x["page_number"].cast("string"), F.lit("]\n"), x["content"]))
    short = F.transform(F.filter("p", lambda x: x["page_number"] <= 3), lambda x: F.substring(x["content"], 1, 500))
    return grouped.select("doc_id", F.array_join(whole, "\n\n---\n\n").alias("context"), F.nullif(F.array_join(short, "\n"), F.lit("")).alias("summary_context"))


@query("b26_image_chunk_text", """SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'Image on page ' || (doc_id % 9) || ': No description available' ELSE
  'Image on page ' || (doc_id % 9) || ': ' || coalesce(CASE WHEN doc_id % 5 > 0 THEN lang END, 'No caption') || coalesce(chr(10) || chr(10) || 'Details: ' || nullif(text, ''), '') || CASE WHEN doc_id % 2 = 0 THEN chr(10) || chr(10) || 'Text in image: ' || source ELSE '' END || chr(10) || chr(10) || 'Tags: ' || lang || ', ' || source END AS content FROM documents WHERE text IS NOT NULL""")
def image_text(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").where("text IS NOT NULL")
    shown = lambda c: F.when(F.col("doc_id") % 7 != 0, c)
    text = fq.image_chunk_text(
        F.col("doc_id") % 9, shown(F.when(F.col("doc_id") % 5 > 0, F.col("lang"))), shown(F.col("text")), shown(F.when(F.col("doc_id") % 2 == 0, F.col("source"))), shown(F.array("lang", "source"))
    )
    return docs.select("doc_id", text.alias("content"))


@query("b27_table_chunk_text", f"WITH {PAGES} SELECT doc_id, page_number, 'Table on page ' || page_number || ': ' || CASE WHEN page_number % 3 = 0 THEN 'Table extracted from document.' ELSE content END AS content FROM pages_")
def table_text(spark, sf_dir):
    md = F.when(F.col("page_number") % 3 == 1, F.col("content"))
    tx = F.when(F.col("page_number") % 3 == 2, F.col("content"))
    return pages(spark, sf_dir).select("doc_id", "page_number", fq.table_chunk_text(F.col("page_number"), F.lit(""), md, tx).alias("content"))


@query("b28_bbox_to_percent", """SELECT vec_id, CASE WHEN vec_id % 11 = 0 THEN 10.0 ELSE round(b[1] / 612.0::DOUBLE * 100, 2) END AS x, CASE WHEN vec_id % 11 = 0 THEN 10.0 ELSE round(b[2] / 792.0::DOUBLE * 100, 2) END AS y,
  CASE WHEN vec_id % 11 = 0 THEN 30.0 ELSE round((b[3] - b[1]) / 612.0::DOUBLE * 100, 2) END AS width, CASE WHEN vec_id % 11 = 0 THEN 30.0 ELSE round((b[4] - b[2]) / 792.0::DOUBLE * 100, 2) END AS height
  FROM (SELECT vec_id, [abs(embedding[1]::DOUBLE) * 300, abs(embedding[2]::DOUBLE) * 300, 300 + abs(embedding[3]::DOUBLE) * 300, 400 + abs(embedding[4]::DOUBLE) * 300] AS b FROM embeddings)""")
def percent(spark, sf_dir):
    e = lambda i: F.abs(F.col("embedding")[i].cast("double")) * 300
    box = F.when(F.col("vec_id") % 11 != 0, F.array(e(0), e(1), 300 + e(2), 400 + e(3)))
    return read(spark, sf_dir, "embeddings").select("vec_id", *[v.alias(k) for k, v in fq.bbox_to_percent(box).items()])


@query("b29_annotation_colour", "SELECT event_id, CASE event_type WHEN 'click' THEN 'rgba(33, 150, 243, 0.5)' WHEN 'view' THEN 'rgba(76, 175, 80, 0.3)' WHEN 'error' THEN 'rgba(244, 67, 54, 0.5)' ELSE 'rgba(255, 235, 59, 0.4)' END AS colour FROM events")
def colour(spark, sf_dir):
    kind = fq.lookup(F.col("event_type"), {"click": "circle", "view": "box", "error": "underline", "signup": "highlight"}, "unknown")
    return read(spark, sf_dir, "events").select("event_id", fq.annotation_colour(kind).alias("colour"))


@query("b30_fallback_title", rf"""SELECT conv_id, turn, substr(CASE WHEN length(text) > length(t) THEN t || '...' ELSE t END, 1, 50) AS title FROM (
  SELECT *, array_to_string(regexp_extract_all(text, '[^\t-\r\x1C-\x20\x85\pZ]+')[1:6], ' ') AS t FROM conversations) WHERE role = 'user'""")
def title(spark, sf_dir):
    return read(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", fq.fallback_title(F.col("text")).alias("title"))


@query("b31_clean_scores", "SELECT doc_id, CASE WHEN s BETWEEN 0 AND 10 THEN s END AS score FROM (SELECT doc_id, TRY_CAST(CASE WHEN doc_id % 5 = 0 THEN 'n/a' ELSE (quality * 12 - doc_id % 4)::VARCHAR END AS DOUBLE) AS s FROM labels)")
def scores(spark, sf_dir):
    raw = F.when(F.col("doc_id") % 5 == 0, "n/a").otherwise((F.col("quality") * 12 - F.col("doc_id") % 4).cast("string"))
    return read(spark, sf_dir, "labels").select("doc_id", fq.clean_score(raw).alias("score"))


@query("b32_verify_answer", "SELECT doc_id, v AS verified, NOT v AND doc_id % 2 < 1 AS regenerate FROM (SELECT doc_id, coalesce(CASE WHEN doc_id % 9 = 0 THEN NULL ELSE quality * 5 + doc_id % 5 END >= 7 AND toxic = 0, FALSE) AS v FROM labels)")
def verified(spark, sf_dir):
    overall = F.when(F.col("doc_id") % 9 != 0, F.col("quality") * 5 + F.col("doc_id") % 5)
    ok, again = fq.verify_answer(overall, F.col("toxic"), F.col("doc_id") % 2)
    return read(spark, sf_dir, "labels").select("doc_id", ok.alias("verified"), again.alias("regenerate"))


_MSGS = ["Rate limit hit", "bad input", "Connection reset", "not found", "Gateway Timeout", "parse error"]


@query("b33_retryable", "SELECT event_id, coalesce(status IN (429, 500, 502, 503, 504), FALSE) OR regexp_matches(lower(message), '" + "|".join(fq.RETRYABLE) + "') AS retryable FROM (SELECT event_id, CASE WHEN event_type = 'error' THEN 495 + event_id % 10 END AS status, [" + ", ".join(f"'{m}'" for m in _MSGS) + "][(user_id % 6 + 1)::INTEGER] AS message FROM events)")
def retryable(spark, sf_dir):
    message = F.element_at(F.array(*[F.lit(m) for m in _MSGS]), (F.col("user_id") % 6 + 1).cast("int"))
    status = F.when(F.col("event_type") == "error", 495 + F.col("event_id") % 10)
    return read(spark, sf_dir, "events").select("event_id", fq.is_retryable(status, message).alias("retryable"))


@query("b34_valid_sessions", "SELECT event_id, user_id FROM events WHERE ts + INTERVAL 7 DAY >= TIMESTAMP '2024-01-20' AND event_type <> 'purchase'")
def sessions(spark, sf_dir):
    tokens = read(spark, sf_dir, "events").withColumn("expires_at", F.col("ts") + F.expr("INTERVAL 7 DAYS")).withColumn("used", F.col("event_type") == "purchase")
    return valid_sessions(tokens, "2024-01-20").select("event_id", "user_id")


def valid_sessions(tokens, now: str):
    """Sessions and reset tokens that have not expired at ``now`` and are not used."""
    return tokens.where((F.col("expires_at") >= F.lit(now).cast("timestamp_ntz")) & ~F.coalesce("used", F.lit(False)))


@query("b35_client_key", "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN '10.0.0.' || user_id WHEN event_id % 4 = 1 THEN 'real' || user_id WHEN event_id % 4 = 2 THEN 'host' ELSE 'unknown' END AS client FROM events")
def client(spark, sf_dir):
    k = F.col("event_id") % 4
    ip = F.concat(F.lit(" 10.0.0."), F.col("user_id").cast("string"), F.lit(" , 10.1.1.1"))
    return read(spark, sf_dir, "events").select("event_id", fq.client_key(F.when(k == 0, ip).otherwise(""), F.when(k == 1, F.concat(F.lit("real"), F.col("user_id").cast("string"))), F.when(k == 2, "host")).alias("client"))


@query("b36_parse_caption", f"SELECT doc_id, lang AS short, trim(text, {TRIM}) AS detailed, nullif(trim(CASE WHEN doc_id % 3 = 0 THEN '' ELSE source END), '') AS ocr FROM documents WHERE text IS NOT NULL AND doc_id % 4 <> 3 AND lang <> '' AND trim(text, {TRIM}) <> '' AND NOT contains(text, '`')")
def caption(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").where("text IS NOT NULL AND NOT contains(text, '`')")
    body = F.to_json(F.struct(F.col("lang").alias("short_caption"), F.col("text").alias("detailed_description"), F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("source")).alias("ocr_text")))
    k = F.col("doc_id") % 4
    answer = F.when(k == 0, body).when(k == 1, F.concat(F.lit("Here:\n```json\n"), body, F.lit("\n```"))).when(k == 2, F.concat(F.lit("```\n"), body, F.lit("```"))).otherwise(F.lit("no json"))
    found = docs.select("doc_id", fq.parse_caption(answer).alias("c")).where("c IS NOT NULL")
    return found.select("doc_id", F.col("c.short").alias("short"), F.col("c.long").alias("detailed"), F.col("c.ocr").alias("ocr"))


@query("b37_parse_query_list", rf"""WITH p_ AS (SELECT doc_id, list_filter(string_split(regexp_replace(text, '[^A-Za-z ]', '', 'g'), ' '), lambda x: x <> '')[1:4] AS w FROM documents WHERE text IS NOT NULL)
  SELECT doc_id, array_to_string(CASE WHEN doc_id % 4 = 0 THEN list_filter(w, lambda x: length(x) > 3)[1:3] ELSE list_filter(w[1:3], lambda x: length(x) > 3) END, '|') AS queries FROM p_ WHERE len(w) >= 4""")
def query_list(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").where("text IS NOT NULL")
    words = F.slice(F.filter(F.split(F.regexp_replace("text", "[^A-Za-z ]", ""), " "), lambda x: x != ""), 1, 4)
    rows = docs.select("doc_id", words.alias("w")).where(F.size("w") >= 4)
    as_list = lambda mark, close: F.array_join(F.transform("w", lambda x: F.concat(F.lit(mark), x, F.lit(close))), "\n")
    k = F.col("doc_id") % 4
    text = F.when(k == 0, F.to_json("w")).when(k == 1, as_list('say "', '"')).when(k == 2, as_list("1. ", "")).otherwise(as_list("- ", ""))
    return rows.select("doc_id", F.array_join(fq.parse_query_list(text, 3, 2), "|").alias("queries"))


@query("b38_cache_keys", "SELECT doc_id, substr(sha256(text), 1, 16) AS text_key, md5(text || '|3|gpt-4o-mini') AS variation_key FROM documents WHERE text IS NOT NULL")
def keys(spark, sf_dir):
    return read(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", fq.cache_key(F.col("text")).alias("text_key"), fq.expansion_key(F.col("text"), F.lit(3), F.lit("gpt-4o-mini")).alias("variation_key"))


DEDUPED = f"{CRITICAL}, unique_ AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, content ORDER BY page_number, sentence_index) AS rn FROM critical_) WHERE rn = 1)"


def dedupe_sentences(sentence_rows):
    """The first of equal sentences of a document, by page and place."""
    first = F.min(F.struct("page_number", "sentence_index", *[c for c in sentence_rows.columns if c not in ("doc_id", "content", "page_number", "sentence_index")])).alias("x")
    return sentence_rows.groupBy("doc_id", "content").agg(first).select("doc_id", "content", "x.*")


@query("f04_dedupe_sentences", f"WITH {DEDUPED} SELECT doc_id, page_number, sentence_index, content, char_count, matched_patterns, matched_patterns > 0 AS is_critical, char_count < 150 AS is_short FROM unique_")
def deduped(spark, sf_dir):
    return dedupe_sentences(critical(spark, sf_dir))


QUESTION = "how many results and what number of findings are in the method"
RANKED = f"""{DEDUPED}, scored_ AS (SELECT *, len(list_intersect({word_set("content")}, {word_set(f"'{QUESTION}'")})) / len({word_set(f"'{QUESTION}'")})::DOUBLE
   * CASE WHEN matched_patterns > 0 THEN 1.3::DOUBLE ELSE 1.0::DOUBLE END * CASE WHEN regexp_matches(content, '[0-9]') AND regexp_matches('{QUESTION}', '{bounded(fq.ASKS_NUMBER)}') THEN 1.2::DOUBLE ELSE 1.0::DOUBLE END AS raw FROM unique_),
  ranked_ AS (SELECT *, round(raw, 6) AS score FROM scored_)"""


def rank_sentences(sentence_rows, question: str):
    """Adds the share of the question's words that a sentence has, raised for critical ones and for digits where a number is asked."""
    words = lambda t: F.array_distinct(F.regexp_extract_all(F.lower(t), F.lit(r"[\p{L}\p{N}_]+"), 0))
    asked = words(F.lit(question))
    share = F.size(F.array_intersect(words(F.col("content")), asked)) / F.greatest(F.size(asked), F.lit(1))
    numeric = F.col("content").rlike("[0-9]") & fq.has_words(F.lit(question), fq.ASKS_NUMBER)
    return sentence_rows.withColumn("score", F.round(share * F.when(F.col("is_critical"), 1.3).otherwise(1.0) * F.when(numeric, 1.2).otherwise(1.0), 6))


@query("e09_rank_sentences", f"WITH {RANKED} SELECT doc_id, page_number, sentence_index, score FROM ranked_")
def ranked(spark, sf_dir):
    return rank_sentences(deduped(spark, sf_dir), QUESTION).select("doc_id", "page_number", "sentence_index", "score")


@query("z01_question_context", f"""WITH {RANKED}, top_ AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, page_number, sentence_index) AS rank FROM ranked_)
  SELECT doc_id, rank::INTEGER AS rank, '[Page ' || page_number || ']: ' || content AS context, score FROM top_ WHERE rank <= 3""")
def question_context(spark, sf_dir):
    """The three best sentences of each document for a question, formatted: pages, sentences, filter, dedup, rank, top three."""
    from pyspark.sql import Window

    order = Window.partitionBy("doc_id").orderBy(F.col("score").desc(), "page_number", "sentence_index")
    top = rank_sentences(deduped(spark, sf_dir), QUESTION).withColumn("rank", F.row_number().over(order)).where("rank <= 3")
    return top.select("doc_id", "rank", fq.format_chunk(F.col("page_number"), F.col("content")).alias("context"), "score")

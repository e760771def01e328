"""Queries on joins, token budgets and answers (inventory D1-D12, G1-G10, H1-H7, A5, A6)."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.operators import answers, budget, joins, vectors
from docloom.plans import questions as qs
from docloom.plans.registry import PAGES, TRIM, query, read, shared, word_set
from docloom.plans.retrieval import VECS, knn_sql, vector_chunks, vector_queries
from docloom.plans.texts import STRUCTURE, lines, pages, structure
from docloom.sources import stored, tables

WS = r"[\t-\r\x1C-\x20\x85\pZ]"


@query("d01_parents_of_children", f"""WITH {VECS}, {knn_sql(20, "c.vec_id % 3 = 1", name="kid").format(shift=0)}, p_ AS (SELECT query_id, chunk_id // 5 AS parent_chunk_id, max(similarity) AS similarity FROM kid_ GROUP BY 1, 2)
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, parent_chunk_id)::INTEGER AS rank FROM p_) WHERE rank <= 10""")
def parents(spark, sf_dir):
    hits = vectors.knn(vector_queries(spark, sf_dir), vector_chunks(spark, sf_dir).where("chunk_id % 3 = 1"), 20)
    edges = vector_chunks(spark, sf_dir).select(F.floor(F.col("chunk_id") / 5).alias("parent_chunk_id"), F.col("chunk_id").alias("child_chunk_id"))
    return joins.parents_of_children(hits, edges, 10)


@query("d01_parent_rows", f"""WITH {VECS}, {knn_sql(20, "c.vec_id % 3 = 1", name="kid").format(shift=0)}, p_ AS (SELECT query_id, chunk_id // 5 AS parent_chunk_id, max(similarity) AS similarity FROM kid_ GROUP BY 1, 2),
  r_ AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, parent_chunk_id)::INTEGER AS rank FROM p_)
  SELECT query_id, parent_chunk_id, similarity, rank, 'Parent ' || parent_chunk_id AS content FROM r_ WHERE rank <= 10""")
def parent_rows(spark, sf_dir):
    """The best parents of child hits with their rows, from tables bucketed by parent id."""
    rows = vector_chunks(spark, sf_dir)
    parent = F.floor(F.col("chunk_id") / 5).alias("parent_chunk_id")
    name = f"docloom_{uuid.uuid4().hex}"
    edges = stored.save_bucketed(rows.select(parent, F.col("chunk_id").alias("child_chunk_id")), f"{name}_edges", "parent_chunk_id", 8)
    numbers = rows.select(F.floor(F.col("chunk_id") / 5).alias("chunk_id")).distinct()
    chunks = stored.save_bucketed(numbers.withColumn("content", F.concat(F.lit("Parent "), F.col("chunk_id").cast("string"))), f"{name}_chunks", "chunk_id", 8)
    hits = vectors.knn(vector_queries(spark, sf_dir), rows.where("chunk_id % 3 = 1"), 20)
    best = joins.parents_of_children(hits, edges, 10)
    return best.join(chunks, best["parent_chunk_id"] == chunks["chunk_id"]).select("query_id", "parent_chunk_id", "similarity", "rank", "content")


HEADERS = f"{STRUCTURE}, headers_ AS (SELECT doc_id, page_number, line_index, bare AS text FROM kinds_ WHERE kind = 'header'), pg_ AS (SELECT DISTINCT doc_id, page_number FROM pages_)"


def headers(spark, sf_dir):
    return structure(spark, sf_dir).where("kind = 'header'").select("doc_id", "page_number", "line_index", "text")


@query("d02_preceding_headers", f"WITH {HEADERS} SELECT p.doc_id, p.page_number, coalesce(string_agg(h.text, '|' ORDER BY h.page_number, h.line_index), '') AS headers FROM pg_ p LEFT JOIN headers_ h ON h.doc_id = p.doc_id AND h.page_number <= p.page_number GROUP BY ALL")
def preceding(spark, sf_dir):
    return joins.preceding_headers(pages(spark, sf_dir), headers(spark, sf_dir)).withColumn("headers", F.array_join("headers", "|"))


@query("d03_section_title", f"""WITH {HEADERS}, own_ AS (SELECT doc_id, page_number, max_by(text, line_index) AS last, min_by(text, line_index) AS first FROM headers_ GROUP BY ALL)
  SELECT p.doc_id, p.page_number, coalesce(o.last, (SELECT min_by(x.first, x.page_number) FROM own_ x WHERE x.doc_id = p.doc_id AND x.page_number <= p.page_number)) AS section_title FROM pg_ p LEFT JOIN own_ o USING (doc_id, page_number)""")
def sections(spark, sf_dir):
    return joins.section_title(pages(spark, sf_dir), headers(spark, sf_dir))


# Orders stand for documents, customers for their owners.
@query("d05_owned", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey < 5)")
def owned(spark, sf_dir):
    owners = read(spark, sf_dir, "customer").where("c_nationkey < 5").select(F.col("c_custkey").alias("o_custkey"))
    return joins.owned(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), owners, "o_custkey")


def conversation_heads(spark, sf_dir):
    """(conv_id, doc_id, last_turn): each conversation with the document that it is about."""
    return read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max("turn").alias("last_turn")).withColumn("doc_id", F.col("conv_id") * 7)


HEADS = "heads_ AS (SELECT conv_id, max(turn) AS last_turn, conv_id * 7 AS doc_id FROM conversations GROUP BY conv_id)"


@query("d06_conversation_list", f"WITH {HEADS} SELECT conv_id, last_turn, h.doc_id, d.lang FROM heads_ h LEFT JOIN documents d ON d.doc_id = h.doc_id ORDER BY last_turn DESC, conv_id DESC")
def conversation_list(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang")
    return joins.conversation_list(conversation_heads(spark, sf_dir), docs)


CASCADE_SQL = f"""WITH {PAGES}, {HEADS}, c_ AS (SELECT doc_id, doc_id * 1000 + page_number AS chunk_id FROM pages_)
  SELECT 'documents' AS tab, doc_id AS key FROM documents WHERE doc_id % 7 <> 0 UNION ALL SELECT 'chunks', chunk_id FROM c_ WHERE doc_id % 7 <> 0 UNION ALL SELECT 'edges', chunk_id FROM c_ WHERE doc_id % 7 <> 0 UNION ALL SELECT 'conversations', conv_id FROM heads_ WHERE (doc_id // 7) % 7 <> 0 UNION ALL SELECT 'messages', conv_id * 100 + turn FROM conversations WHERE conv_id % 7 <> 0"""


def documents_and_all(spark, sf_dir):
    """documents, chunks, edges, conversations and messages, each with its document."""
    docs = read(spark, sf_dir, "documents").select("doc_id")
    chunks = pages(spark, sf_dir).select("doc_id", (F.col("doc_id") * 1000 + F.col("page_number")).alias("chunk_id"))
    edges = chunks.select("doc_id", F.col("chunk_id").alias("parent_chunk_id"), F.col("chunk_id").alias("child_chunk_id"))
    messages = read(spark, sf_dir, "conversations").withColumn("doc_id", F.col("conv_id"))
    return {"documents": docs, "chunks": chunks, "edges": edges, "conversations": messages.select("doc_id", "conv_id").distinct(), "messages": messages}


def keys_of(tables_left):
    key = {"documents": F.col("doc_id"), "chunks": F.col("chunk_id"), "edges": F.col("child_chunk_id"), "conversations": F.col("conv_id"), "messages": F.col("conv_id") * 100 + F.col("turn")}
    return reduce(DataFrame.unionAll, [df.select(F.lit(name).alias("tab"), key[name].cast("long").alias("key")) for name, df in tables_left.items()])


@query("d07_cascade_delete", CASCADE_SQL)
def cascade(spark, sf_dir):
    whole = documents_and_all(spark, sf_dir)
    left = joins.cascade_delete(whole | {"edges": whole["edges"].drop("doc_id")}, whole["documents"].where("doc_id % 7 = 0"))
    return keys_of(left)


@query("d07_cascade_rewrite", CASCADE_SQL)
def cascade_stored(spark, sf_dir):
    """The same on stored tables, of which the touched buckets are rewritten."""
    whole, path = documents_and_all(spark, sf_dir), shared(spark)
    for name, rows in whole.items():
        stored.write_by_document(rows, f"{path}/{name}", buckets=8)
    stored.cascade_delete(spark, {name: f"{path}/{name}" for name in whole}, whole["documents"].where("doc_id % 7 = 0"), buckets=8)
    return keys_of({name: spark.read.parquet(f"{path}/{name}") for name in whole})


@query("d08_is_hierarchical", f"WITH {PAGES} SELECT doc_id, doc_id IN (SELECT doc_id FROM pages_ WHERE page_number = 2) AS is_hierarchical FROM documents")
def levels(spark, sf_dir):
    chunks = pages(spark, sf_dir).withColumn("chunk_level", F.when(F.col("page_number") == 2, "child").otherwise("flat"))
    return joins.is_hierarchical(read(spark, sf_dir, "documents"), chunks)


# Answers: assistant turns with citations added, as the conversations hold none.
ANSWERS = "answers_ AS (SELECT conv_id * 100 + turn AS answer_id, conv_id, turn::INTEGER AS turn, text || ' [Page ' || turn || '] [Page ' || (turn + 1) || '] [Page ' || turn || ']' AS text, text AS plain FROM conversations WHERE role = 'assistant')"


def cited_answers(spark, sf_dir):
    t, one = F.col("turn").cast("string"), (F.col("turn") + 1).cast("string")
    text = F.concat(F.col("text"), F.lit(" [Page "), t, F.lit("] [Page "), one, F.lit("] [Page "), t, F.lit("]"))
    return tables.spread(read(spark, sf_dir, "conversations")).where("role = 'assistant'").select((F.col("conv_id") * 100 + F.col("turn")).alias("answer_id"), "conv_id", F.col("turn").cast("int").alias("turn"), text.alias("text"), F.col("text").alias("plain"))


def retrieved_pages(spark, sf_dir):
    """The pages retrieved for an answer: that of its own turn."""
    return cited_answers(spark, sf_dir).select("answer_id", F.col("turn").alias("page_number"))


CITED = rf"{ANSWERS}, cited_ AS (SELECT answer_id, (i - 1)::INTEGER AS place, p[i]::INTEGER AS page_number FROM (SELECT answer_id, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT answer_id, regexp_extract_all(text, '\[Page{WS}+([0-9]+)\]', 1) AS p FROM answers_)))"


@query("h04_citations", f"WITH {CITED} SELECT * FROM cited_")
def cited(spark, sf_dir):
    return answers.citations(cited_answers(spark, sf_dir))


@query("d09_bad_citations", f"WITH {CITED} SELECT c.answer_id, c.page_number, c.place, 'Citation [Page ' || c.page_number || '] in response does not match available chunks' AS warning FROM cited_ c JOIN answers_ a USING (answer_id) WHERE c.page_number <> a.turn")
def wrong(spark, sf_dir):
    return answers.bad_citations(cited(spark, sf_dir), retrieved_pages(spark, sf_dir))


@query("d10_match_annotation_text", f"""WITH {ANSWERS}, n_ AS (SELECT answer_id AS annotation_id, answer_id, turn AS page_number, plain AS t FROM answers_),
  c_ AS (SELECT answer_id, 0 AS rank, answer_id || ':a' AS chunk_id, 'no such text' AS content FROM answers_ UNION ALL SELECT answer_id, 1, answer_id || ':b', plain FROM answers_ UNION ALL SELECT answer_id, 2, answer_id || ':c', plain FROM answers_)
  SELECT annotation_id, min_by(chunk_id, rank) AS chunk_id FROM n_ JOIN c_ USING (answer_id) WHERE contains(lower(content), lower(t)) GROUP BY annotation_id""")
def text_match(spark, sf_dir):
    a = cited_answers(spark, sf_dir)
    notes = a.select(F.col("answer_id").alias("annotation_id"), "answer_id", F.col("turn").alias("page_number"), F.col("plain").alias("text_to_highlight"))
    part = lambda r, mark, c: a.select("answer_id", F.col("turn").alias("page_number"), F.lit(r).alias("rank"), F.concat(F.col("answer_id").cast("string"), F.lit(f":{mark}")).alias("chunk_id"), c.alias("content"))
    chunks = part(0, "a", F.lit("no such text")).unionAll(part(1, "b", F.col("plain"))).unionAll(part(2, "c", F.col("plain")))
    return joins.match_annotation_text(notes, chunks)


@query("d11_match_annotation_image", "SELECT a.vec_id AS annotation_id, b.vec_id AS image_chunk_id, 'https://store/' || b.label AS url FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id * 2 WHERE b.vec_id % 4 = 0")
def image_match(spark, sf_dir):
    rows = read(spark, sf_dir, "embeddings")
    notes = rows.select(F.col("vec_id").alias("annotation_id"), (F.col("vec_id") * 2).alias("image_chunk_id"))
    chunks = rows.select(F.col("vec_id").alias("chunk_id"), F.when(F.col("vec_id") % 4 == 0, "image").otherwise("text").alias("chunk_type"), F.concat(F.lit("https://store/"), F.col("label").cast("string")).alias("url"))
    return joins.match_annotation_image(notes, chunks)


# The first sentence of a document's first page asks.
@query("d12_highlight_spans", rf"""WITH {qs.SENTENCES}, s_ AS (SELECT doc_id AS item_id, page_number * 10000 + i - 1 AS span_id, lower(l[i]) AS s, trim(l[i], {TRIM}) AS bare FROM (SELECT doc_id, page_number, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, page_number, string_split(content, chr(10)) AS l FROM pages_))),
  q_ AS (SELECT doc_id AS item_id, lower(content) AS q FROM sentences_ WHERE page_number = 1 AND sentence_index = 0), w_ AS (SELECT item_id, q, list_filter(regexp_extract_all(q, '[^\t-\r\x1C-\x20\x85\pZ]+'), lambda x: length(x) > 2) AS w FROM q_),
  m_ AS (SELECT item_id, span_id, len(list_filter(w, lambda x: contains(s, x))) > 0 OR (length(bare) > 3 AND contains(q, lower(bare))) AS hit, coalesce(contains(s, w[1]), FALSE) AS starts FROM s_ JOIN w_ USING (item_id) WHERE bare <> ''),
  a_ AS (SELECT *, bool_or(hit) OVER (PARTITION BY item_id) AS any_hit FROM m_)
  SELECT item_id, span_id FROM a_ WHERE hit OR (NOT any_hit AND starts)""")
def highlights(spark, sf_dir):
    spans = lines(spark, sf_dir).select(F.col("doc_id").alias("item_id"), (F.col("page_number").cast("long") * 10000 + F.col("line_index")).alias("span_id"), F.col("content").alias("span"))
    asked = qs.sentences(spark, sf_dir).where("page_number = 1 AND sentence_index = 0").select(F.col("doc_id").alias("item_id"), F.col("content").alias("query"))
    return joins.highlight_spans(spans.join(asked, "item_id"))


@query("a05_parse_context", """SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 2 END AS n_chunks, CASE WHEN turn % 2 = 0 THEN turn END AS first_page, CASE WHEN turn % 2 = 1 THEN '[' || turn || ']' END AS other FROM conversations""")
def contexts(spark, sf_dir):
    t = F.col("turn").cast("string")
    obj = F.concat(F.lit('{"chunks": [{"id": "a", "content": "x", "pageNumber": '), t, F.lit('}, {"id": "b"}], "annotations": [{"pageNumber": 1}]}'))
    rows = read(spark, sf_dir, "conversations").withColumn("context", F.when(F.col("turn") % 2 == 0, obj).otherwise(F.concat(F.lit("["), t, F.lit("]"))))
    got = tables.parse_context(rows)
    return got.select("conv_id", "turn", F.when(F.col("context_chunks").isNotNull(), F.size("context_chunks")).alias("n_chunks"), F.col("context_chunks")[0]["pageNumber"].cast("long").alias("first_page"), F.col("context_other").alias("other"))


@query("a06_parse_event_lines", "SELECT event_id, CASE event_type WHEN 'view' THEN 'chunk' WHEN 'click' THEN 'step' WHEN 'purchase' THEN 'final' WHEN 'error' THEN 'error' END AS route, event_type AS content FROM events WHERE event_id % 10 < 8")
def event_lines(spark, sf_dir):
    kind = F.when(F.col("event_type") == "view", "chunk").when(F.col("event_type") == "click", "step_complete").when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "error", "error").otherwise("other")
    body = F.to_json(F.struct(kind.alias("type"), F.col("event_type").alias("content")))
    k = F.col("event_id") % 10
    line = F.when(k < 8, F.concat(F.lit("data: "), body)).when(k == 8, F.lit("data: {broken")).otherwise(body)
    got = tables.parse_event_lines(read(spark, sf_dir, "events").withColumn("line", line))
    return got.select("event_id", "route", F.col("event.content").alias("content"))


@query("a07_backfill_defaults", "SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN 'text' ELSE 'image' END AS chunk_type, CASE WHEN vec_id % 2 = 0 THEN 'flat' ELSE 'child' END AS chunk_level FROM embeddings")
def backfilled(spark, sf_dir):
    rows = read(spark, sf_dir, "embeddings").select("vec_id", F.when(F.col("vec_id") % 3 != 0, "image").alias("chunk_type"), F.when(F.col("vec_id") % 2 == 1, "child").alias("chunk_level"))
    return tables.backfill_defaults(rows)


@query("g01_count_tokens", "SELECT doc_id, (length(text) // 4)::BIGINT AS tokens FROM documents")
def tokens(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", budget.count_tokens(F.col("text")).alias("tokens"))


CONTEXT_TOKENS = "ct_ AS (SELECT conv_id, (sum(length(text)) // 4 + 4 * count(*))::BIGINT AS tokens FROM conversations GROUP BY conv_id)"


@query("g02_context_tokens", f"WITH {CONTEXT_TOKENS} SELECT conv_id, tokens FROM ct_")
def conversation_tokens(spark, sf_dir):
    return budget.context_tokens(read(spark, sf_dir, "conversations"))


def truncate_sql(text: str, most: str) -> str:
    cut = f"substr({text}, 1, (({most}) * 4)::INTEGER)"
    ended = rf"rtrim(regexp_extract({cut}, '(?s)^(.*[.!?]){WS}+', 1), {TRIM})"
    word = f"regexp_extract({cut}, '(?s)^(.*) [^ ]*$', 1)"
    return f"CASE WHEN length({text}) // 4 <= {most} OR length({text}) <= ({most}) * 4 THEN {text} WHEN {ended} <> '' THEN {ended} WHEN length({word}) > length({cut}) * 0.5 THEN rtrim({word}, {TRIM}) ELSE {cut} END"


@query("g03_truncate_tokens", f"SELECT doc_id, {truncate_sql('text', '(5 + doc_id % 40)')} AS text FROM documents WHERE text IS NOT NULL")
def truncated(spark, sf_dir):
    return read(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", budget.truncate_tokens(F.col("text"), 5 + F.col("doc_id") % 40).alias("text"))


@query("g04_available_tokens", f"WITH {CONTEXT_TOKENS} SELECT conv_id, greatest(0, 100000 - 500 - 50 - tokens * 100 - 2000 - 20000)::BIGINT AS available FROM ct_")
def available(spark, sf_dir):
    return budget.context_tokens(read(spark, sf_dir, "conversations")).select("conv_id", budget.available_tokens(F.lit(500), F.lit(50), F.col("tokens") * 100, F.lit(2000)).alias("available"))


RANKED = f"{PAGES}, rk_ AS (SELECT doc_id AS query_id, page_number AS rank, page_number, content, (doc_id % 50) * 67 + 60 AS available FROM pages_)"


def ranked_chunks(spark, sf_dir):
    """Every document asks for its own pages, in their order, with a budget that fits some of them."""
    number = F.col("page_number")
    return pages(spark, sf_dir).select(F.col("doc_id").alias("query_id"), number.alias("rank"), number.alias("page_number"), "content", (F.col("doc_id") % 50 * 67 + 60).alias("available"))


_TOK = "(length('[Page ' || page_number || ']: ' || content) // 4)"


@query("g05_select_chunks", f"""WITH {RANKED}, t_ AS (SELECT *, {_TOK} AS tokens FROM rk_), s_ AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY query_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM t_),
  m_ AS (SELECT *, min(CASE WHEN before + tokens > available THEN rank END) OVER (PARTITION BY query_id) AS misfit, (available - before)::BIGINT AS remaining FROM s_),
  k_ AS (SELECT query_id, rank, page_number, misfit IS NOT NULL AND rank >= misfit AS truncated, CASE WHEN misfit IS NULL OR rank < misfit THEN content ELSE {truncate_sql("content", "(remaining - 20)")} END AS content FROM m_ WHERE misfit IS NULL OR rank < misfit OR (rank = misfit AND remaining >= 50))
  SELECT query_id, rank, page_number, content, {_TOK}::BIGINT AS tokens, truncated FROM k_""")
def selected(spark, sf_dir):
    return budget.select_chunks(ranked_chunks(spark, sf_dir))


@query("g06_select_chunks_whole", f"""WITH RECURSIVE {RANKED}, t_ AS (SELECT *, {_TOK}::BIGINT AS tokens, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS i FROM rk_),
  f_ AS (SELECT query_id, i, tokens <= available AS fits, CASE WHEN tokens <= available THEN tokens ELSE 0 END AS used FROM t_ WHERE i = 1
   UNION ALL SELECT t_.query_id, t_.i, f_.used + t_.tokens <= t_.available, f_.used + CASE WHEN f_.used + t_.tokens <= t_.available THEN t_.tokens ELSE 0 END FROM f_ JOIN t_ ON t_.query_id = f_.query_id AND t_.i = f_.i + 1)
  SELECT query_id, rank, page_number, content, tokens, FALSE AS truncated FROM t_ JOIN f_ USING (query_id, i) WHERE fits""")
def selected_whole(spark, sf_dir):
    return budget.select_chunks(ranked_chunks(spark, sf_dir), truncate=False)


OVERLAP = f"len(list_intersect({word_set('content')}, {word_set(chr(39) + qs.QUESTION + chr(39))})) / len({word_set(chr(39) + qs.QUESTION + chr(39))})::DOUBLE"
COMPRESSED = f"""{qs.SENTENCES}, sc_ AS (SELECT doc_id * 1000 + page_number AS chunk_id, sentence_index, content, round({OVERLAP}, 6) AS score FROM sentences_),
  th_ AS (SELECT chunk_id, quantile_cont(score, 0.6) AS t, count(*) AS total FROM sc_ GROUP BY chunk_id),
  cp_ AS (SELECT chunk_id, string_agg(content, ' ' ORDER BY sentence_index) AS content, count(*) AS sentences_kept, any_value(total) AS sentences_total, count(*) / any_value(total)::DOUBLE AS ratio FROM sc_ JOIN th_ USING (chunk_id) WHERE score >= t OR total < 3 GROUP BY chunk_id)"""


def compressed(spark, sf_dir):
    rows = qs.sentences(spark, sf_dir)
    words = lambda t: F.array_distinct(F.regexp_extract_all(F.lower(t), F.lit(r"[\p{L}\p{N}_]+"), 0))
    asked = words(F.lit(qs.QUESTION))
    score = F.round(F.size(F.array_intersect(words(F.col("content")), asked)) / F.size(asked), 6)
    scored = rows.select((F.col("doc_id") * 1000 + F.col("page_number")).alias("chunk_id"), "sentence_index", "content", score.alias("score"))
    return budget.compress_chunks(scored)


query("g07_compress_chunks", f"WITH {COMPRESSED} SELECT * FROM cp_")(compressed)


@query("g08_compression_stats", f"WITH {COMPRESSED} SELECT count(*) AS chunks, sum(sentences_kept)::BIGINT AS kept, sum(sentences_total)::BIGINT AS total, round(avg(ratio), 6) AS avg_ratio FROM cp_")
def compression_stats(spark, sf_dir):
    return compressed(spark, sf_dir).agg(F.count("*").alias("chunks"), F.sum("sentences_kept").alias("kept"), F.sum("sentences_total").alias("total"), F.round(F.avg("ratio"), 6).alias("avg_ratio"))


@query("g09_should_compress", f"WITH {PAGES} SELECT doc_id % 300 AS query_id, count(*) > 10 OR avg(length(content)) > 500 AS compress FROM pages_ GROUP BY 1")
def compress_flag(spark, sf_dir):
    return budget.should_compress(pages(spark, sf_dir).withColumn("query_id", F.col("doc_id") % 300))


@query("g10_estimate_usage", f"WITH {CONTEXT_TOKENS}, a_ AS (SELECT conv_id, sum(length(text) // 4)::BIGINT AS completion_tokens FROM conversations WHERE role = 'assistant' GROUP BY conv_id) SELECT conv_id, tokens AS prompt_tokens, completion_tokens, tokens + completion_tokens AS total_tokens, round((tokens + completion_tokens) / 100000.0::DOUBLE * 100, 4) AS percent FROM ct_ JOIN a_ USING (conv_id)")
def usage(spark, sf_dir):
    messages = read(spark, sf_dir, "conversations")
    prompt = budget.context_tokens(messages).withColumnRenamed("tokens", "prompt_tokens")
    completion = messages.where("role = 'assistant'").groupBy("conv_id").agg(F.sum(budget.count_tokens(F.col("text"))).alias("completion_tokens"))
    return budget.estimate_usage(prompt, completion)


# Annotated answers: by answer_id modulo 5 without a fence, a list, an object with a list, broken JSON, a single object.
_CLEAN = "trim(regexp_replace(plain, '[^A-Za-z ]', '', 'g'))"
NOTED = f"""{ANSWERS}, noted_ AS (SELECT answer_id, turn, plain, {_CLEAN} AS t, answer_id % 5 AS k FROM answers_),
  notes_ AS (SELECT answer_id, turn, plain, 0 AS annotation_id, turn::VARCHAR AS page, 'highlight' AS type, t AS text_to_highlight, NULL AS image_chunk_id, 'why' AS explanation FROM noted_ WHERE k IN (1, 2, 4)
   UNION ALL SELECT answer_id, turn, plain, 1, (turn + 1)::VARCHAR, 'circle', NULL, 'img1', NULL FROM noted_ WHERE k IN (1, 2)
   UNION ALL SELECT answer_id, turn, plain, 2, 'x', 'box', t, NULL, '' FROM noted_ WHERE k IN (1, 2))"""


def noted_answers(spark, sf_dir):
    t = F.trim(F.regexp_replace("plain", "[^A-Za-z ]", ""))
    turn, one = F.col("turn").cast("string"), (F.col("turn") + 1).cast("string")
    first = F.concat(F.lit('{"pageNumber": '), turn, F.lit(', "type": "highlight", "textToHighlight": "'), t, F.lit('", "explanation": "why"}'))
    rest = F.concat(F.lit(', {"pageNumber": '), one, F.lit(', "type": "circle", "bbox": [1, 2, 3, 4], "imageChunkId": "img1"}, {"pageNumber": "x", "type": "box", "textToHighlight": "'), t, F.lit('", "explanation": ""}, {"type": "odd"}'))
    k = F.col("answer_id") % 5
    body = F.when(k == 1, F.concat(F.lit("```json\n["), first, rest, F.lit("]\n```"))).when(k == 2, F.concat(F.lit('```annotations\n{"annotations": ['), first, rest, F.lit("]}\n``` end ```json\n[]\n```")))
    body = body.when(k == 3, F.lit("```json\n{broken\n```")).when(k == 4, F.concat(F.lit("```json"), first, F.lit("```"))).otherwise(F.lit(""))
    return cited_answers(spark, sf_dir).withColumn("text", F.concat(F.col("plain"), F.lit("\n"), body))


def routed(spark, sf_dir):
    return answers.route_annotations(answers.parse_annotations(noted_answers(spark, sf_dir)))


@query("h01_parse_annotations", f"WITH {NOTED} SELECT answer_id, CASE WHEN k = 0 THEN plain || chr(10) WHEN k = 2 THEN trim(plain || chr(10) || ' end ', {TRIM}) ELSE trim(plain, {TRIM}) END AS cleaned, CASE WHEN k IN (1, 2) THEN 4 WHEN k = 4 THEN 1 ELSE 0 END AS n_items FROM noted_")
def parsed(spark, sf_dir):
    return answers.parse_annotations(noted_answers(spark, sf_dir)).select("answer_id", "cleaned", F.size("items").alias("n_items"))


@query("h02_route_annotations", f"WITH {NOTED} SELECT answer_id, annotation_id, page, TRY_CAST(page AS INTEGER) AS page_number, CASE WHEN annotation_id = 1 THEN 'image' ELSE 'text' END AS kind, text_to_highlight, image_chunk_id, nullif(explanation, '') AS label, CASE type WHEN 'circle' THEN 'rgba(33, 150, 243, 0.5)' WHEN 'box' THEN 'rgba(76, 175, 80, 0.3)' ELSE 'rgba(255, 235, 59, 0.4)' END AS colour FROM notes_")
def routes(spark, sf_dir):
    return routed(spark, sf_dir).select("answer_id", "annotation_id", "page", "page_number", "kind", "text_to_highlight", "image_chunk_id", "label", "colour")


@query("h03_annotations_by_page", f"""WITH {NOTED}, g_ AS (SELECT answer_id, TRY_CAST(page AS INTEGER) AS page_number, min(annotation_id) AS first_place, count(*) AS n, min_by(text_to_highlight, annotation_id) FILTER (coalesce(text_to_highlight, '') <> '') AS st, min_by(explanation, annotation_id) FILTER (coalesce(explanation, '') <> '') AS explanation, bool_or(annotation_id = 1) AS has_image FROM notes_ GROUP BY 1, 2)
  SELECT g.answer_id, page_number, first_place, n, coalesce(st, CASE WHEN NOT has_image AND page_number = a.turn THEN substr(a.plain, 1, 200) END) AS source_text, explanation, has_image FROM g_ g JOIN answers_ a USING (answer_id)""")
def by_page(spark, sf_dir):
    chunks = cited_answers(spark, sf_dir).select("answer_id", F.col("turn").alias("page_number"), F.lit(0).alias("rank"), F.col("plain").alias("content"))
    return answers.annotations_by_page(routed(spark, sf_dir), chunks)


@query("h05_annotation_warnings", f"""WITH {NOTED} SELECT answer_id, annotation_id, CASE WHEN page = 'x' THEN 'Annotation #' || (annotation_id + 1) || ' has invalid page number: x' ELSE 'Annotation #' || (annotation_id + 1) || ' page number ' || page || ' does not match available chunks' END AS warning FROM notes_ WHERE page = 'x' OR TRY_CAST(page AS INTEGER) <> turn""")
def warnings(spark, sf_dir):
    return answers.annotation_warnings(routed(spark, sf_dir), retrieved_pages(spark, sf_dir))


@query("h06_uncovered_citations", f"WITH {CITED}, n_ AS (SELECT answer_id, turn AS page_number FROM answers_ WHERE answer_id % 5 IN (1, 2, 4) UNION SELECT answer_id, turn + 1 FROM answers_ WHERE answer_id % 5 IN (1, 2)), l_ AS (SELECT answer_id, page_number FROM cited_ EXCEPT SELECT answer_id, page_number FROM n_) SELECT answer_id, string_agg(page_number::VARCHAR, ',' ORDER BY page_number) AS pages FROM l_ GROUP BY answer_id")
def uncovered(spark, sf_dir):
    return answers.uncovered_citations(cited(spark, sf_dir), routed(spark, sf_dir)).withColumn("pages", F.array_join(F.transform("pages", lambda p: p.cast("string")), ","))


@query("h07_quality_report", "SELECT ['factual', 'analytical', 'comparative'][(doc_id % 3 + 1)::INTEGER] AS query_type, ['simple', 'complex'][(doc_id % 2 + 1)::INTEGER] AS complexity, count(*) AS n, round(avg(quality), 6) AS avg_quality FROM labels GROUP BY ROLLUP (1, 2)")
def quality(spark, sf_dir):
    pick = lambda xs, n: F.element_at(F.array(*[F.lit(x) for x in xs]), (F.col("doc_id") % n + 1).cast("int"))
    rows = read(spark, sf_dir, "labels").select(pick(["factual", "analytical", "comparative"], 3).alias("query_type"), pick(["simple", "complex"], 2).alias("complexity"), "quality")
    return answers.quality_report(rows)

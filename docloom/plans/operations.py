"""Queries on jobs, caches, costs, audit, windows, sorts and sets (inventory I1-I20, J1-J9, L1-L8)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from docloom.operators import analytics, answers
from docloom.plans.context import CITED, HEADS, cited, cited_answers, conversation_heads
from docloom.plans.questions import QUESTION
from docloom.plans.registry import ORACLES, PAGES, QUERIES, query, read, word_set
from docloom.plans.texts import pages

NOW = "2024-01-30"
# Events stand for jobs: purchase is completed, error failed, signup queued, the rest processing.
JOBS = f"""jobs_ AS (SELECT event_id AS document_id, CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'queued' ELSE 'processing' END AS status,
  CASE WHEN event_type = 'error' THEN 'boom' END AS error_message, ts AS processing_started_at, CASE WHEN event_id % 4 <> 0 THEN ts + to_seconds(event_id % 300) END AS processing_completed_at, ts AS updated_at FROM events)"""


def jobs(spark, sf_dir):
    kind = F.col("event_type")
    status = F.when(kind == "purchase", "completed").when(kind == "error", "failed").when(kind == "signup", "queued").otherwise("processing")
    done = F.when(F.col("event_id") % 4 != 0, F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.col("event_id") % 300).cast("decimal(18,6)")))
    return read(spark, sf_dir, "events").select(F.col("event_id").alias("document_id"), status.alias("status"), F.when(kind == "error", "boom").alias("error_message"), F.col("ts").alias("processing_started_at"), done.alias("processing_completed_at"), F.col("ts").alias("updated_at"))


DAY = f"updated_at >= TIMESTAMP '{NOW}' - INTERVAL 24 HOUR"
HOUR = f"updated_at >= TIMESTAMP '{NOW}' - INTERVAL 1 HOUR"
_DONE, _FAILED = "count(*) FILTER (status = 'completed')", "count(*) FILTER (status = 'failed')"
AVG = "coalesce(round(sum(CASE WHEN status = 'completed' THEN epoch_us(processing_completed_at) - epoch_us(processing_started_at) END)::DOUBLE / 1e6 / nullif(count(*) FILTER (status = 'completed' AND processing_completed_at IS NOT NULL), 0), 2), 120.0)"
RATE = f"coalesce(round({_DONE} * 100.0::DOUBLE / nullif({_DONE} + {_FAILED}, 0), 2), 100.0)"

query("i01_jobs_last_hour", f"WITH {JOBS} SELECT {_DONE} AS completed, {_FAILED} AS failed FROM jobs_ WHERE {HOUR}")(lambda s, d: analytics.jobs_last_hour(jobs(s, d), NOW))
query("i02_avg_processing_time", f"WITH {JOBS} SELECT {AVG} AS avg_seconds FROM jobs_ WHERE {DAY}")(lambda s, d: analytics.avg_processing_time(jobs(s, d), NOW))
query("i03_success_rate", f"WITH {JOBS} SELECT {RATE} AS success_rate FROM jobs_ WHERE {DAY}")(lambda s, d: analytics.success_rate(jobs(s, d), NOW))
HEALTH = "CASE WHEN depth > 50 OR rate < 70 OR failed > 10 THEN 'unhealthy' WHEN depth > 20 OR rate < 90 OR failed > 3 THEN 'degraded' ELSE 'healthy' END"


@query("i04_queue_health", f"SELECT user_id, {HEALTH} AS health FROM (SELECT user_id, count(*) FILTER (event_type = 'signup') AS depth, 100.0 - count(*) FILTER (event_type = 'error') AS rate, count(*) FILTER (event_type = 'error') AS failed FROM events GROUP BY user_id)")
def health(spark, sf_dir):
    kind = F.col("event_type")
    rows = read(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(kind == "signup").alias("depth"), F.count_if(kind == "error").alias("failed"))
    return rows.select("user_id", analytics.health(F.col("depth"), 100.0 - F.col("failed"), F.col("failed")).alias("health"))


@query("i05_queue_stats", f"""WITH {JOBS}, d_ AS (SELECT {AVG} AS avg_seconds, {RATE} AS success_rate FROM jobs_ WHERE {DAY}), h_ AS (SELECT {_DONE} AS completed_hour, {_FAILED} AS failed_hour FROM jobs_ WHERE {HOUR}),
  n_ AS (SELECT count(*) FILTER (status = 'queued') AS queued, count(*) FILTER (status = 'processing') AS processing FROM jobs_)
  SELECT queued, processing, completed_hour, failed_hour, avg_seconds, success_rate, least(processing, 4) AS workers_active, CASE WHEN queued > 50 OR success_rate < 70 OR failed_hour > 10 THEN 'unhealthy' WHEN queued > 20 OR success_rate < 90 OR failed_hour > 3 THEN 'degraded' ELSE 'healthy' END AS health FROM n_, d_, h_""")
def stats(spark, sf_dir):
    return analytics.queue_stats(jobs(spark, sf_dir), NOW)


@query("i06_list_jobs", f"WITH {JOBS} SELECT document_id, status FROM jobs_ WHERE status = 'failed' ORDER BY updated_at DESC, document_id LIMIT 50")
def listed(spark, sf_dir):
    return analytics.list_jobs(jobs(spark, sf_dir), "failed", 50).select("document_id", "status")


@query("i07_bulk_transition", f"WITH {JOBS} SELECT 'retry' AS action, document_id, CASE WHEN status = 'failed' THEN 'queued' ELSE status END AS status, NULL AS error_message, status = 'failed' AS changed FROM jobs_ UNION ALL SELECT 'cancel', document_id, CASE WHEN status = 'queued' THEN 'failed' ELSE status END, CASE WHEN status = 'queued' THEN 'Cancelled by admin' ELSE error_message END, status = 'queued' FROM jobs_")
def transitions(spark, sf_dir):
    one = lambda a: analytics.bulk_transition(jobs(spark, sf_dir), a).select(F.lit(a).alias("action"), "document_id", "status", "error_message", "changed")
    return one("retry").unionAll(one("cancel"))


@query("i08_processing_status", f"WITH {PAGES} SELECT d.doc_id, d.status, CASE WHEN status = 'completed' THEN coalesce(n, 0) END AS chunk_count FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'processing' ELSE 'completed' END AS status FROM documents) d LEFT JOIN (SELECT doc_id, count(*) AS n FROM pages_ GROUP BY doc_id) USING (doc_id)")
def status(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, "processing").otherwise("completed").alias("status"))
    return analytics.processing_status(docs, pages(spark, sf_dir))


@query("i09_ingest_summary", f"WITH {PAGES}, c_ AS (SELECT doc_id, CASE WHEN page_number > 1 THEN 'image' ELSE 'text' END AS chunk_type, CASE WHEN doc_id % 2 = 0 THEN 'parent' ELSE 'child' END AS chunk_level FROM pages_) SELECT chunk_type, chunk_level, count(*) AS n, count(DISTINCT doc_id) AS documents FROM c_ GROUP BY CUBE (chunk_type, chunk_level)")
def summary(spark, sf_dir):
    rows = pages(spark, sf_dir).select("doc_id", F.when(F.col("page_number") > 1, "image").otherwise("text").alias("chunk_type"), F.when(F.col("doc_id") % 2 == 0, "parent").otherwise("child").alias("chunk_level"))
    return analytics.ingest_summary(rows)


@query("i10_hit_rates", "SELECT event_type AS kind, count(*) AS n, round(count(*) FILTER (value > 20) * 100.0::DOUBLE / count(*), 4) AS hit_rate FROM events GROUP BY event_type")
def rates(spark, sf_dir):
    return analytics.hit_rates(read(spark, sf_dir, "events").select(F.col("event_type").alias("kind"), (F.col("value") > 20).alias("hit")))


# Each vector is asked at ten-minute steps about the document of its label; every other one has an answer in the cache.
@query("i11_similar_responses", """WITH e_ AS (SELECT vec_id, label, vec_id * 10 AS minute, embedding::DOUBLE[] AS v FROM embeddings),
  s_ AS (SELECT q.vec_id AS query_id, a.vec_id AS answer_id, round(list_inner_product(q.v, a.v) / (sqrt(list_inner_product(q.v, q.v)) * sqrt(list_inner_product(a.v, a.v))), 9) AS similarity FROM e_ q JOIN e_ a ON a.label = q.label AND a.minute < q.minute AND q.minute - a.minute <= 120 WHERE a.vec_id % 2 = 0)
  SELECT query_id, arg_max(answer_id, (similarity, -answer_id)) AS answer_id, max(similarity) AS similarity FROM s_ WHERE similarity >= 0.2 GROUP BY query_id""")
def cached_answers(spark, sf_dir):
    ts = F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(mins=(F.col("vec_id") * 10).cast("int"))
    rows = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("document_id"), ts.alias("ts"), F.col("embedding").alias("vector"))
    return analytics.similar_responses(rows, rows.where("id % 2 = 0"), 0.2)


@query("i12_live_cache", f"""WITH e_ AS (SELECT event_id, user_id AS document_id, ts, CASE event_id % 3 WHEN 0 THEN 'embedding' WHEN 1 THEN 'chunk' ELSE 'answer' END AS kind, event_type FROM events),
  inv_ AS (SELECT document_id, max(ts) AS bad FROM e_ WHERE event_type = 'signup' GROUP BY document_id)
  SELECT event_id, kind, document_id FROM e_ LEFT JOIN inv_ USING (document_id) WHERE event_type <> 'signup' AND epoch_us(TIMESTAMP '{NOW}') - epoch_us(ts) BETWEEN 0 AND (CASE kind WHEN 'embedding' THEN 24 WHEN 'chunk' THEN 72 ELSE 2 END) * 3600000000 AND (bad IS NULL OR bad < ts)""")
def live(spark, sf_dir):
    k = F.col("event_id") % 3
    rows = read(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("document_id"), "ts", F.when(k == 0, "embedding").when(k == 1, "chunk").otherwise("answer").alias("kind"), "event_type")
    return analytics.live_cache(rows.where("event_type <> 'signup'"), rows.where("event_type = 'signup'"), NOW).select("event_id", "kind", "document_id")


STEPS = "steps_ AS (SELECT user_id AS request_id, ['gpt-4o', 'gpt-4o-mini', 'gpt-4', 'else'][(event_id % 4 + 1)::INTEGER] AS model, (event_id % 500)::BIGINT AS prompt_tokens, (event_id % 90)::BIGINT AS completion_tokens, event_id FROM events)"
COST = "(prompt_tokens / 1000.0::DOUBLE * CASE model WHEN 'gpt-4o' THEN 0.0025::DOUBLE WHEN 'gpt-4' THEN 0.03::DOUBLE ELSE 0.00015::DOUBLE END + completion_tokens / 1000.0::DOUBLE * CASE model WHEN 'gpt-4o' THEN 0.01::DOUBLE WHEN 'gpt-4' THEN 0.06::DOUBLE ELSE 0.0006::DOUBLE END)"


def steps(spark, sf_dir):
    model = F.element_at(F.array(*[F.lit(m) for m in ("gpt-4o", "gpt-4o-mini", "gpt-4", "else")]), (F.col("event_id") % 4 + 1).cast("int"))
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("request_id"), model.alias("model"), (F.col("event_id") % 500).alias("prompt_tokens"), (F.col("event_id") % 90).alias("completion_tokens"), "event_id")


@query("i13_token_cost", f"WITH {STEPS} SELECT event_id, round({COST}, 9) AS cost FROM steps_")
def cost(spark, sf_dir):
    from docloom.functions.questions import token_cost

    return steps(spark, sf_dir).select("event_id", F.round(token_cost(F.col("model"), F.col("prompt_tokens"), F.col("completion_tokens")), 9).alias("cost"))


@query("i14_token_totals", f"WITH {STEPS} SELECT request_id, sum(prompt_tokens)::BIGINT AS prompt_tokens, sum(completion_tokens)::BIGINT AS completion_tokens, round(sum({COST}), 9) AS cost FROM steps_ GROUP BY request_id")
def totals(spark, sf_dir):
    return analytics.token_totals(steps(spark, sf_dir))


# Requests are users; their steps are event types, of which each user has other ones.
@query("i14_usage_maps", f"""WITH {STEPS.replace("event_id FROM", "event_type AS step, event_id FROM")}, l_ AS (SELECT request_id, step, max_by(prompt_tokens, event_id) AS prompt_tokens, max_by(completion_tokens, event_id) AS completion_tokens, max_by(model, event_id) AS model FROM steps_ GROUP BY ALL),
  c_ AS (SELECT *, {COST} AS cost FROM l_), e_ AS (SELECT request_id, step, prompt_tokens, completion_tokens, cost FROM c_ UNION ALL SELECT request_id, 'total', sum(prompt_tokens), sum(completion_tokens), sum(cost) FROM c_ GROUP BY request_id HAVING sum(prompt_tokens + completion_tokens) > 0)
  SELECT request_id, string_agg(step || ':' || prompt_tokens || ':' || completion_tokens || ':' || (prompt_tokens + completion_tokens), ',' ORDER BY step) AS token_usage, string_agg(step || ':' || round(cost * 100000000)::BIGINT, ',' ORDER BY step) FILTER (cost > 0 OR step <> 'total') AS costs FROM e_ GROUP BY request_id""")
def usage(spark, sf_dir):
    """Maps as sorted text; costs in units of 1e-8."""
    rows = steps(spark, sf_dir).join(read(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("step")), "event_id")
    text = lambda c, value: F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat_ws(":", e["key"], *value(e["value"]))), ",")
    return analytics.usage_maps(rows).select(
        "request_id",
        text("token_usage", lambda u: [u[x].cast("string") for x in ("prompt_tokens", "completion_tokens", "total_tokens")]).alias("token_usage"),
        text("costs", lambda v: [F.round(v * 100000000).cast("long").cast("string")]).alias("costs"),
    )


@query("i14_merged_maps", "WITH c_ AS (SELECT user_id, event_type AS k, count(*) AS v FROM events GROUP BY ALL) SELECT user_id, string_agg(k || ':' || v, ',' ORDER BY k) AS counts FROM c_ GROUP BY user_id")
def merged_maps(spark, sf_dir):
    """Two kinds of rows with maps of unlike keys, added up by kind and then with each other."""
    one = read(spark, sf_dir, "events").select("user_id", F.create_map("event_type", F.lit(1).cast("long")).alias("counts"), (F.col("event_type").isin("view", "click")).alias("seen"))
    parts = [analytics.summed_maps(one.where(w), "user_id", "counts").withColumnRenamed("counts", n) for w, n in (("seen", "a"), ("NOT seen", "b"))]
    both = parts[0].join(parts[1], "user_id", "full_outer").select("user_id", analytics.added_maps(F.col("a"), F.col("b")).alias("counts"))
    return both.select("user_id", F.array_join(F.transform(F.array_sort(F.map_entries("counts")), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), ",").alias("counts"))


query("i15_audit_page", "SELECT event_id, user_id FROM events WHERE event_type = 'click' ORDER BY ts DESC, event_id DESC LIMIT 100 OFFSET 200")(
    lambda s, d: analytics.audit_page(read(s, d, "events"), 200, 100, event_type="click").select("event_id", "user_id")
)
query("i15_audit_count", "SELECT count(*) AS n FROM events WHERE event_type = 'click' AND user_id = 7")(
    lambda s, d: analytics.audit_filter(read(s, d, "events"), event_type="click", user_id=7).agg(F.count("*").alias("n"))
)
query("i16_first_message_flag", "SELECT conv_id, turn, count(*) OVER (PARTITION BY conv_id) AS n_messages, row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1 AS is_first FROM conversations")(
    lambda s, d: analytics.first_message_flag(read(s, d, "conversations")).select("conv_id", "turn", "n_messages", "is_first")
)


@query("i17_group_by_document", f"WITH {HEADS} SELECT conv_id % 9 AS doc_id, max(last_turn) AS newest, string_agg(conv_id::VARCHAR, ',' ORDER BY last_turn DESC, conv_id DESC) AS conv_ids FROM heads_ GROUP BY 1")
def grouped(spark, sf_dir):
    rows = conversation_heads(spark, sf_dir).withColumn("doc_id", F.col("conv_id") % 9)
    return analytics.group_by_document(rows).withColumn("conv_ids", F.array_join(F.transform("conv_ids", lambda c: c.cast("string")), ","))


query("i18_distinct_parents", "SELECT DISTINCT label, vec_id // 5 AS parent FROM embeddings")(
    lambda s, d: read(s, d, "embeddings").select("label", F.floor(F.col("vec_id") / 5).alias("parent")).distinct()
)
query("i19_grouping_sets", "SELECT event_type, user_id % 10 AS bucket, grouping_id(event_type, user_id % 10) AS gid, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY GROUPING SETS ((1, 2), (1), ())")(
    lambda s, d: read(s, d, "events").withColumn("bucket", F.col("user_id") % 10).groupingSets([["event_type", "bucket"], ["event_type"], []], "event_type", "bucket").agg(F.grouping_id().alias("gid"), F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
)
@query("i20_approx_users", "SELECT event_type, count(DISTINCT user_id) AS exact, TRUE AS within FROM events GROUP BY event_type")
def approximate_users(spark, sf_dir):
    """The sketch beside the exact number; within tells whether it lies within three of its standard errors."""
    events = read(spark, sf_dir, "events")
    exact = events.groupBy("event_type").agg(F.count_distinct("user_id").alias("exact"))
    both = analytics.approx_users(events, "event_type", "user_id").join(exact, "event_type")
    return both.select("event_type", "exact", (F.abs(F.col("users") - F.col("exact")) <= 3 * 0.02 * F.col("exact")).alias("within"))



query("j01_rank_in_list", "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id)::INTEGER AS rank FROM events")(
    lambda s, d: read(s, d, "events").select("event_id", F.row_number().over(Window.partitionBy("user_id").orderBy(F.col("value").desc(), "event_id")).alias("rank"))
)


@query("j02_top_k_per_key", "SELECT user_id, event_id, rank FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id)::INTEGER AS rank FROM events) WHERE rank <= 3")
def top_k(spark, sf_dir):
    from docloom.operators.vectors import top

    return top(read(spark, sf_dir, "events"), ["user_id"], "value", "event_id", 3).select("user_id", "event_id", "rank")


@query("j03_score_by_max", "SELECT event_id, round(value / max(value) OVER (PARTITION BY user_id), 6) AS score FROM events")
def by_max(spark, sf_dir):
    from docloom.operators.keyword import normalised

    rows = normalised(read(spark, sf_dir, "events").withColumn("score", F.col("value")), keys=("user_id",))
    return rows.select("event_id", F.round("score", 6).alias("score"))


query("j04_prefix_tokens", "SELECT conv_id, turn, sum(length(text) // 4) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS tokens FROM conversations")(
    lambda s, d: read(s, d, "conversations").select("conv_id", "turn", F.sum(F.floor(F.length("text") / 4)).over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)).alias("tokens"))
)
query("j05_history", "SELECT conv_id, turn, place FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::INTEGER AS place FROM conversations) WHERE place <= 4")(
    lambda s, d: answers.history(read(s, d, "conversations"), 4).select("conv_id", "turn", "place")
)


@query("j05b_history_without_question", "WITH q_ AS (SELECT conv_id, max_by(text, turn) AS question FROM conversations WHERE role = 'user' GROUP BY conv_id), h_ AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM conversations) SELECT conv_id, turn FROM h_ JOIN q_ USING (conv_id) WHERE place <= 10 AND NOT (role = 'user' AND text = question)")
def without(spark, sf_dir):
    messages = read(spark, sf_dir, "conversations")
    asked = messages.where("role = 'user'").groupBy("conv_id").agg(F.max_by("text", "turn").alias("question"))
    return answers.history_without(messages, asked).select("conv_id", "turn")


query("j09_offered_load", "SELECT event_id, count(*) OVER (PARTITION BY user_id % 3 ORDER BY epoch_us(ts) // 1000000 RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS offered FROM events")(
    lambda s, d: analytics.offered_load(read(s, d, "events").withColumn("client", F.col("user_id") % 3), 3600).select("event_id", "offered")
)
query("l01_order_limit", "SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 40")(lambda s, d: read(s, d, "events").orderBy(F.col("value").desc(), "event_id").limit(40).select("event_id", "value"))
query("l02_newest_per_user", "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC)::INTEGER AS place FROM events")(
    lambda s, d: read(s, d, "events").select("user_id", "event_id", F.row_number().over(Window.partitionBy("user_id").orderBy(F.col("ts").desc(), F.col("event_id").desc())).alias("place"))
)
query("l03_offset_page", "SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 25 OFFSET 50")(lambda s, d: read(s, d, "orders").orderBy(F.col("o_orderdate").desc(), "o_orderkey").offset(50).limit(25).select("o_orderkey"))
query("l04_messages_in_order", "SELECT conv_id, turn, role FROM conversations ORDER BY conv_id, turn")(lambda s, d: read(s, d, "conversations").orderBy("conv_id", "turn").select("conv_id", "turn", "role"))
query("l05_union_ids", "SELECT vec_id AS id FROM embeddings WHERE label < 4 UNION SELECT vec_id FROM embeddings WHERE vec_id % 3 = 0")(
    lambda s, d: read(s, d, "embeddings").where("label < 4").select(F.col("vec_id").alias("id")).union(read(s, d, "embeddings").where("vec_id % 3 = 0").select("vec_id")).distinct()
)
query("l06_except_pages", f"WITH {CITED} SELECT answer_id, page_number FROM cited_ EXCEPT SELECT answer_id, turn FROM answers_")(
    lambda s, d: cited(s, d).select("answer_id", "page_number").subtract(cited_answers(s, d).select("answer_id", "turn"))
)


@query("l07_intersect_terms", f"WITH {PAGES}, t_ AS (SELECT DISTINCT unnest({word_set('content')}) AS term FROM pages_) SELECT term FROM t_ INTERSECT SELECT unnest({word_set(chr(39) + QUESTION + chr(39))})")
def common_terms(spark, sf_dir):
    words = lambda t: F.explode(F.array_distinct(F.regexp_extract_all(F.lower(t), F.lit(r"[\p{L}\p{N}_]+"), 0))).alias("term")
    rows = pages(spark, sf_dir)
    return rows.select(words(F.col("content"))).intersect(spark.range(1).select(words(F.lit(QUESTION))))


query("l08_union_all_kinds", f"WITH {PAGES} SELECT doc_id, 'page' AS kind FROM pages_ UNION ALL SELECT conv_id, 'message' FROM conversations UNION ALL SELECT page_id, 'web' FROM pages")(
    lambda s, d: pages(s, d).select("doc_id", F.lit("page").alias("kind")).unionByName(read(s, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.lit("message").alias("kind"))).unionByName(read(s, d, "pages").select(F.col("page_id").alias("doc_id"), F.lit("web").alias("kind")))
)


# Processing time of documents from orders and their shipments.
@query("i02_order_durations", "SELECT o_orderstatus AS status, count(*) AS n, round(avg(days), 4) AS avg_days FROM (SELECT o_orderkey, o_orderstatus, date_diff('day', o_orderdate::DATE, max(l_shipdate::DATE)) AS days FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderstatus, o_orderdate) GROUP BY 1")
def durations(spark, sf_dir):
    last = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("done"))
    both = read(spark, sf_dir, "orders").join(last, "o_orderkey")
    return both.groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"), F.round(F.avg(F.datediff("done", "o_orderdate")), 4).alias("avg_days"))


# Window functions that other operators are made of, under their own names.
for _name, _source in (("j06_headers_so_far", "d02_preceding_headers"), ("j07_adjacent_distances", "c05_split_semantic"), ("j08_carry_over", "c04_repair_boundaries")):
    query(_name, ORACLES.get(_source))(QUERIES[_source])

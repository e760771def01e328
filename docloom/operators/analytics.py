"""Operational analytics: jobs, caches, costs, audit, conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import questions as fq


def at(now: str) -> Column:
    return F.lit(now).cast("timestamp_ntz")


def seconds(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / 1e6


def recent(jobs: DataFrame, now: str, hours: int) -> DataFrame:
    return jobs.where(F.col("updated_at") >= at(now) - F.expr(f"INTERVAL {hours} HOURS"))


def jobs_last_hour(jobs: DataFrame, now: str) -> DataFrame:
    return recent(jobs, now, 1).agg(F.count_if(F.col("status") == "completed").alias("completed"), F.count_if(F.col("status") == "failed").alias("failed"))


def _mean_seconds() -> Column:
    timed = (F.col("status") == "completed") & F.col("processing_started_at").isNotNull() & F.col("processing_completed_at").isNotNull()
    total = F.sum(F.when(timed, seconds(F.col("processing_completed_at"), F.col("processing_started_at"))))
    return F.coalesce(F.round(total / F.count_if(timed), 2), F.lit(120.0))


def avg_processing_time(jobs: DataFrame, now: str) -> DataFrame:
    """Mean seconds of the last day's completed jobs with both times; 120 without any."""
    return recent(jobs, now, 24).agg(_mean_seconds().alias("avg_seconds"))


def _rate() -> Column:
    done, failed = F.count_if(F.col("status") == "completed"), F.count_if(F.col("status") == "failed")
    return F.coalesce(F.round(F.try_divide(done * 100.0, done + failed), 2), F.lit(100.0))


def success_rate(jobs: DataFrame, now: str) -> DataFrame:
    return recent(jobs, now, 24).agg(_rate().alias("success_rate"))


def health(depth: Column, rate: Column, failed: Column) -> Column:
    return F.when((depth > 50) | (rate < 70) | (failed > 10), "unhealthy").when((depth > 20) | (rate < 90) | (failed > 3), "degraded").otherwise("healthy")


def queue_stats(jobs: DataFrame, now: str) -> DataFrame:
    """The whole snapshot of the queue in one pass."""
    hour, day = F.col("updated_at") >= at(now) - F.expr("INTERVAL 1 HOUR"), F.col("updated_at") >= at(now) - F.expr("INTERVAL 24 HOURS")
    status = F.col("status")
    done, failed = F.count_if(day & (status == "completed")), F.count_if(day & (status == "failed"))
    timed = day & (status == "completed") & F.col("processing_started_at").isNotNull() & F.col("processing_completed_at").isNotNull()
    total = F.sum(F.when(timed, seconds(F.col("processing_completed_at"), F.col("processing_started_at"))))
    out = jobs.agg(
        F.count_if(status == "queued").alias("queued"), F.count_if(status == "processing").alias("processing"),
        F.count_if(hour & (status == "completed")).alias("completed_hour"), F.count_if(hour & (status == "failed")).alias("failed_hour"),
        F.coalesce(F.round(total / F.count_if(timed), 2), F.lit(120.0)).alias("avg_seconds"),
        F.coalesce(F.round(F.try_divide(done * 100.0, done + failed), 2), F.lit(100.0)).alias("success_rate"),
    )
    return out.withColumn("workers_active", F.least("processing", F.lit(4))).withColumn("health", health(F.col("queued"), F.col("success_rate"), F.col("failed_hour")))


def list_jobs(jobs: DataFrame, status: str | None, n: int) -> DataFrame:
    rows = jobs if status is None else jobs.where(F.col("status") == status)
    return rows.orderBy(F.col("updated_at").desc(), "document_id").limit(n)


def bulk_transition(jobs: DataFrame, action: str) -> DataFrame:
    """retry: failed jobs are queued again, without their message. cancel: pending and queued jobs fail with a message. changed tells which."""
    source, target, message = (["failed"], "queued", None) if action == "retry" else (["pending", "queued"], "failed", "Cancelled by admin")
    hit = F.col("status").isin(source)
    return jobs.withColumn("changed", hit).withColumn("error_message", F.when(hit, F.lit(message)).otherwise(F.col("error_message"))).withColumn("status", F.when(hit, target).otherwise(F.col("status")))


def processing_status(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    n = chunks.groupBy("doc_id").agg(F.count("*").alias("n"))
    both = documents.join(n, "doc_id", "left")
    return both.withColumn("chunk_count", F.when(F.col("status") == "completed", F.coalesce("n", F.lit(0)))).drop("n")


def ingest_summary(chunks: DataFrame) -> DataFrame:
    """Chunks by type and level with all subtotals."""
    return chunks.cube("chunk_type", "chunk_level").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("documents"))


def hit_rates(events: DataFrame) -> DataFrame:
    """Cache hit rates in percent by kind."""
    return events.groupBy("kind").agg(F.count("*").alias("n"), F.round(F.coalesce(F.try_divide(F.count_if("hit") * 100.0, F.count("*")), F.lit(0.0)), 4).alias("hit_rate"))


TTL_HOURS = {"embedding": 24, "chunk": 72, "answer": 2}


def live_cache(entries: DataFrame, invalidations: DataFrame, now: str) -> DataFrame:
    """Entries within the time of their kind (24, 72 or 2 hours) that no later re-processing of their document has made void."""
    hours = fq.lookup(F.col("kind"), TTL_HOURS, 0)
    alive = entries.where(seconds(at(now), F.col("ts")).between(0, hours * 3600))
    last = invalidations.groupBy("document_id").agg(F.max("ts").alias("invalid_at"))
    joined = alive.join(last, "document_id", "left")
    return joined.where(F.col("invalid_at").isNull() | (F.col("invalid_at") < F.col("ts"))).drop("invalid_at")


def token_totals(steps: DataFrame) -> DataFrame:
    cost = fq.token_cost(F.col("model"), F.col("prompt_tokens"), F.col("completion_tokens"))
    return steps.withColumn("cost", cost).groupBy("request_id").agg(F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"), F.round(F.sum("cost"), 9).alias("cost"))


def usage_maps(steps: DataFrame) -> DataFrame:
    """(request_id, token_usage, costs) from (request_id, step, model, prompt_tokens, completion_tokens, event_id).

    token_usage is a map from step to struct<prompt_tokens, completion_tokens, total_tokens> and costs one from step to dollars; a
    step that comes again replaces its earlier entry. Both have an entry ``total`` unless it is 0. A map has an entry for
    each kind of step.
    """
    use = F.struct("prompt_tokens", "completion_tokens", (F.col("prompt_tokens") + F.col("completion_tokens")).alias("total_tokens"))
    last = steps.groupBy("request_id", "step").agg(F.max_by(F.struct(use.alias("use"), fq.token_cost(F.col("model"), F.col("prompt_tokens"), F.col("completion_tokens")).alias("cost")), "event_id").alias("last"))
    entries = lambda c: F.map_from_entries(F.array_sort(F.collect_list(F.struct("step", F.col("last")[c]))))
    maps = last.groupBy("request_id").agg(entries("use").alias("token_usage"), entries("cost").alias("costs"))
    added = lambda c: F.aggregate(F.map_values("token_usage"), F.lit(0).cast("long"), lambda s, u: s + u[c])
    total = F.struct(added("prompt_tokens").alias("prompt_tokens"), added("completion_tokens").alias("completion_tokens"), added("total_tokens").alias("total_tokens"))
    dollars = F.aggregate(F.map_values("costs"), F.lit(0.0), lambda s, c: s + c)
    return maps.select(
        "request_id",
        F.when(total["total_tokens"] > 0, F.map_concat("token_usage", F.create_map(F.lit("total"), total))).otherwise(F.col("token_usage")).alias("token_usage"),
        F.when(dollars > 0, F.map_concat("costs", F.create_map(F.lit("total"), dollars))).otherwise(F.col("costs")).alias("costs"),
    )


def added_maps(a: F.Column, b: F.Column) -> F.Column:
    """Two maps of numbers as one, with the sum of what either has for a key; a null map is empty."""
    empty = F.create_map().cast("map<string,bigint>")
    return F.map_zip_with(F.coalesce(a, empty), F.coalesce(b, empty), lambda _, x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0)))


def summed_maps(rows: DataFrame, key: str, column: str) -> DataFrame:
    """(``key``, ``column``): the maps of all rows of a key added up by entry; partial sums come before the exchange."""
    parts = rows.select(key, F.explode(F.map_entries(column)).alias("e")).groupBy(key, F.col("e.key").alias("k")).agg(F.sum("e.value").alias("v"))
    return parts.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias(column))


def audit_filter(log: DataFrame, **equal) -> DataFrame:
    for column, value in equal.items():
        if value is not None:
            log = log.where(F.col(column) == value)
    return log


def audit_page(log: DataFrame, offset: int, limit: int, **equal) -> DataFrame:
    return audit_filter(log, **equal).orderBy(F.col("ts").desc(), F.col("event_id").desc()).offset(offset).limit(limit)


def audit_after(log: DataFrame, ts: str, event_id: int, limit: int, **equal) -> DataFrame:
    """The page after a known row: no offset has to be counted off."""
    older = (F.col("ts") < at(ts)) | ((F.col("ts") == at(ts)) & (F.col("event_id") < event_id))
    return audit_filter(log, **equal).where(older).orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(limit)


def first_message_flag(messages: DataFrame) -> DataFrame:
    n = F.count("*").over(Window.partitionBy("conv_id"))
    return messages.withColumn("n_messages", n).withColumn("is_first", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) == 1)


def group_by_document(conversations: DataFrame) -> DataFrame:
    """(doc_id, newest, conv_ids): the conversations of each document, newest first."""
    item = F.struct(F.col("last_turn"), F.col("conv_id"))
    grouped = conversations.groupBy("doc_id").agg(F.max("last_turn").alias("newest"), F.sort_array(F.collect_list(item), asc=False).alias("items"))
    return grouped.select("doc_id", "newest", F.transform("items", lambda x: x["conv_id"]).alias("conv_ids"))


def similar_responses(questions: DataFrame, earlier: DataFrame, least: float = 0.85, hours: int = 2) -> DataFrame:
    """(query_id, answer_id, similarity): the closest earlier answer of the same document within ``hours``, from (id, document_id, ts, vector) tables.

    Time is cut into slots of ``hours``; a question meets its own slot and the one before in an equi-join, so
    a hot document is spread over its slots.
    """
    from docloom.operators.vectors import cosine

    slot = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(hours * 3_600_000_000))
    asked = questions.select(F.col("id").alias("query_id"), "document_id", F.col("ts").alias("asked_at"), F.col("vector").alias("q"), F.explode(F.array(slot, slot - 1)).alias("slot"))
    known = earlier.select(F.col("id").alias("answer_id"), "document_id", "ts", F.col("vector").alias("v"), slot.alias("slot"))
    met = asked.join(known, ["document_id", "slot"]).where((F.col("ts") < F.col("asked_at")) & (seconds(F.col("asked_at"), F.col("ts")) <= hours * 3600))
    scored = met.withColumn("similarity", F.round(cosine(F.col("q"), F.col("v")), 9)).where(F.col("similarity") >= least)
    best = scored.groupBy("query_id").agg(F.max(F.struct("similarity", (-F.col("answer_id")).alias("n"))).alias("b"))
    return best.select("query_id", (-F.col("b.n")).alias("answer_id"), F.col("b.similarity").alias("similarity"))


def offered_load(requests: DataFrame, span: int = 60) -> DataFrame:
    """Requests of the same client in the ``span`` seconds up to each request."""
    second = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000)
    order = Window.partitionBy("client").orderBy("second").rangeBetween(-span, 0)
    return requests.withColumn("second", second).withColumn("offered", F.count("*").over(order))


def approx_users(rows: DataFrame, key: str, user: str) -> DataFrame:
    return rows.groupBy(key).agg(F.approx_count_distinct(user, 0.02).alias("users"))

"""Token budgets and compression of retrieved chunks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import questions as fq
from docloom.sources.tables import WHITE


def count_tokens(text: Column) -> Column:
    """A quarter of the characters; a tokenizer UDF may take its place."""
    return F.floor(F.length(text) / 4).cast("long")


def context_tokens(messages: DataFrame, key: str = "conv_id", text: str = "text", exact: Callable | None = None) -> DataFrame:
    """Tokens of each conversation: all characters div 4 (or exact counts plus 2), and 4 for each message."""
    n = F.count("*")
    if exact is None:
        tokens = F.floor(F.sum(F.length(text)) / 4) + 4 * n
    else:
        tokens = F.sum(exact(F.col(text))) + 4 * n + 2
    return messages.groupBy(key).agg(tokens.cast("long").alias("tokens"))


def truncate_tokens(text: Column, most: Column) -> Column:
    """A text cut to ``most`` tokens: after its last sentence end, else before its last blank if that is past half, else hard."""
    cut = F.substr(text, F.lit(1), (most * 4).cast("int"))
    sentence = F.regexp_extract(cut, r"(?s)^(.*[.!?])[\t-\r\x1C-\x20\x85\pZ]+", 1)
    word = F.regexp_extract(cut, r"(?s)^(.*) [^ ]*$", 1)
    ended = F.rtrim(sentence, F.lit(WHITE))
    short = F.when(ended != "", ended).when(F.length(word) > F.length(cut) * 0.5, F.rtrim(word, F.lit(WHITE))).otherwise(cut)
    return F.when(count_tokens(text) <= most, text).otherwise(F.when(F.length(text) <= most * 4, text).otherwise(short))


def available_tokens(system: Column, user: Column, history: Column, reserve: Column, context: int = 100_000, buffer: int = 20_000) -> Column:
    return F.greatest(F.lit(0).cast("long"), F.lit(context) - system - user - history - reserve - F.lit(buffer))


def select_chunks(ranked: DataFrame, budget: str = "available", truncate: bool = True) -> DataFrame:
    """The chunks of each query that fit into its budget, in rank order, with tokens, content and truncated.

    ``ranked`` is (query_id, rank, page_number, content, ``budget``). With truncation the first chunk that does
    not fit is cut to the tokens left less 20 if 50 or more are left, and the selection ends; a running
    sum finds it. Without truncation chunks that don't fit are passed over, which is a fold over the
    query's list (retrieval keeps it short).
    """
    sized = ranked.withColumn("tokens", count_tokens(fq.format_chunk(F.col("page_number"), F.col("content"))))
    if not truncate:
        item = F.struct("rank", "page_number", "content", "tokens", budget)
        lists = sized.groupBy("query_id").agg(F.sort_array(F.collect_list(item)).alias("items"))
        zero = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<int>").alias("ranks"))
        step = lambda s, x: F.when(s["used"] + x["tokens"] <= x[budget], F.struct((s["used"] + x["tokens"]).alias("used"), F.array_append(s["ranks"], x["rank"].cast("int")).alias("ranks"))).otherwise(s)
        picked = lists.withColumn("ranks", F.aggregate("items", zero, step)["ranks"])
        kept = picked.select("query_id", F.explode(F.filter("items", lambda x: F.array_contains("ranks", x["rank"].cast("int")))).alias("x"))
        return kept.select("query_id", "x.rank", "x.page_number", "x.content", "x.tokens", F.lit(False).alias("truncated"))
    order = Window.partitionBy("query_id").orderBy("rank")
    summed = sized.withColumn("before", F.coalesce(F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    misfit = F.min(F.when(F.col("before") + F.col("tokens") > F.col(budget), F.col("rank"))).over(Window.partitionBy("query_id"))
    marked = summed.withColumn("misfit", misfit).withColumn("left", F.col(budget) - F.col("before"))
    whole = F.col("misfit").isNull() | (F.col("rank") < F.col("misfit"))
    cut = (F.col("rank") == F.col("misfit")) & (F.col("left") >= 50)
    shown = marked.where(whole | cut).withColumn("truncated", ~whole)
    shown = shown.withColumn("content", F.when(whole, F.col("content")).otherwise(truncate_tokens(F.col("content"), F.col("left") - 20)))
    shown = shown.withColumn("tokens", count_tokens(fq.format_chunk(F.col("page_number"), F.col("content"))))
    return shown.select("query_id", "rank", "page_number", "content", "tokens", "truncated")


def compress_chunks(scored: DataFrame, keep: float = 0.4, least: int = 3) -> DataFrame:
    """(chunk_id, content, sentences_kept, sentences_total, ratio) from scored sentences (chunk_id, sentence_index, content, score).

    Sentences at or above the percentile (1 - keep) stay, in order; chunks with fewer than ``least`` stay whole.
    """
    each = Window.partitionBy("chunk_id")
    marked = scored.withColumn("threshold", F.percentile("score", F.lit(1 - keep)).over(each)).withColumn("total", F.count("*").over(each))
    kept = marked.where((F.col("score") >= F.col("threshold")) | (F.col("total") < least))
    parts = F.sort_array(F.collect_list(F.struct("sentence_index", "content")))
    text = F.array_join(F.transform(parts, lambda x: x["content"]), " ")
    out = kept.groupBy("chunk_id").agg(text.alias("content"), F.count("*").alias("sentences_kept"), F.first("total").alias("sentences_total"))
    return out.withColumn("ratio", F.col("sentences_kept") / F.col("sentences_total"))


def should_compress(chunks: DataFrame, key: str = "query_id") -> DataFrame:
    """More than 10 chunks, or more than 500 characters each on average."""
    return chunks.groupBy(key).agg(((F.count("*") > 10) | (F.avg(F.length("content")) > 500)).alias("compress"))


def estimate_usage(history: DataFrame, answers: DataFrame, limit: int = 100_000) -> DataFrame:
    """prompt, completion, total and percent of the context limit, where no usage is reported."""
    both = history.join(answers, "conv_id")
    total = F.col("prompt_tokens") + F.col("completion_tokens")
    return both.withColumn("total_tokens", total).withColumn("percent", F.round(F.col("total_tokens") / limit * 100, 4))

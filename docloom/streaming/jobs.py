"""Structured Streaming jobs and their batch twins: ingestion, queue windows, sessions, repeats; batch forms of those in ``state``."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from docloom.operators import chunking
from docloom.sources.tables import pages_of, stable_id


def stream_chunks(source: DataFrame, size: int = 1000, overlap: int = 200) -> DataFrame:
    """Chunks of each arriving document's pages with stable ids; works on a stream or a table alike."""
    chunks = chunking.split_flat(pages_of(source), size, overlap)
    return chunks.withColumn("chunk_id", stable_id("doc_id", F.lit("flat"), "page_number", "chunk_index"))


def ingest_stream(spark: SparkSession, path: str, out: str, checkpoint: str, schema, size: int = 1000, overlap: int = 200):
    """Starts the ingestion of the Parquet files that arrive at ``path`` into ``out``; ends when all present are done."""
    chunks = stream_chunks(spark.readStream.schema(schema).parquet(path), size, overlap)
    return chunks.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def watermarked(events: DataFrame, column: str, late: str) -> DataFrame:
    """Watermarks hang on timestamps of the session's zone; zoneless ones are cast."""
    return events.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, late)


def queue_windows(events: DataFrame, late: str | None = "10 minutes") -> DataFrame:
    """Completed and failed jobs by hour; on a stream, events later than ``late`` are left out."""
    rows = watermarked(events, "ts", late) if late and events.isStreaming else events
    counted = rows.groupBy(F.window("ts", "1 hour").alias("w")).agg(F.count_if(F.col("event_type") == "purchase").alias("completed"), F.count_if(F.col("event_type") == "error").alias("failed"))
    return counted.select(F.col("w.start").alias("start"), "completed", "failed")


def success_windows(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Success rate over the last 24 hours, sliding by the hour: events are counted by the hour, and only the counts meet their 24 windows.

    On a stream the hourly counts go on into the second aggregation when the watermark has closed their hour; a window comes
    out, in append mode, when its last hour has.
    """
    done, failed = F.col("event_type") == "purchase", F.col("event_type") == "error"
    rows = watermarked(events, "ts", late) if events.isStreaming else events
    hours = rows.groupBy(F.window("ts", "1 hour").alias("w")).agg(F.count_if(done).alias("done"), F.count_if(failed).alias("failed"))
    rate = F.coalesce(F.round(F.try_divide(F.sum("done") * 100.0, F.sum("done") + F.sum("failed")), 4), F.lit(100.0))
    day = F.window(F.window_time("w"), "24 hours", "1 hour").alias("d")
    return hours.groupBy(day).agg(rate.alias("success_rate")).select(F.col("d.start").alias("start"), "success_rate")


def admitted(times: Iterable[float], held: Iterable[float], limit: int, span: float) -> tuple[list[bool], list[float]]:
    """Which requests, in order, a sliding log admits; entries of ``span`` or more ago leave it, rejected requests never enter it."""
    out, log = [], deque(held)
    for t in times:
        while log and log[0] <= t - span:
            log.popleft()
        out.append(len(log) < limit)
        if out[-1]:
            log.append(t)
    return out, list(log)


def rate_limit(requests: DataFrame, limit: int = 60, span: float = 60.0) -> DataFrame:
    """(client, request_id, ts, admitted) in batch; each decision hangs on those before.

    Rows sorted by client and time are folded batch by batch; only the log of a client's admitted requests is
    carried on, at most ``limit`` times, so a hot client does not stand in memory.
    """

    rows = requests.select("client", "request_id", "ts")
    kinds = dict(rows.dtypes)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client, held, begun = None, [], False
        for batch in batches:
            codes, names = pd.factorize(batch["client"], use_na_sentinel=False)
            times, ok = batch["ts"].astype("datetime64[us]").astype("int64").to_numpy(), []
            cuts = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), len(batch)]
            for low, high in zip(cuts, cuts[1:], strict=False):  # the runs of one client
                own = None if pd.isna(names[codes[low]]) else names[codes[low]]
                held = held if begun and own == client else []
                client, begun = own, True
                some, held = admitted(times[low:high].tolist(), held, limit, span * 1e6)
                ok += some
            yield batch.assign(admitted=ok)

    dealt = rows.repartition("client").sortWithinPartitions("client", "ts", "request_id")
    return dealt.mapInPandas(fold, f"client {kinds['client']}, request_id {kinds['request_id']}, ts {kinds['ts']}, admitted boolean")


def assembled(deltas: list[tuple[int, str, str | None]]) -> tuple[str, str | None]:
    """(content, kind of the first end) of a message's (seq, type, content)."""
    rows = sorted(deltas, key=lambda r: r[:2])
    end = next((i for i, r in enumerate(rows) if r[1] in ("done", "error")), None)
    return "".join(c or "" for _, k, c in rows[:end] if k == "chunk"), rows[end][1] if end is not None else None


def assemble_answers(deltas: DataFrame) -> DataFrame:
    """(message_id, content, ended): the chunks of each message joined in order, up to its first done or error."""
    last = F.min(F.when(F.col("type").isin("done", "error"), F.col("seq")))
    ended = F.min_by("type", F.when(F.col("type").isin("done", "error"), F.col("seq")))
    grouped = deltas.groupBy("message_id").agg(last.alias("last"), ended.alias("ended"), F.sort_array(F.collect_list(F.when(F.col("type") == "chunk", F.struct("seq", "content")))).alias("parts"))
    kept = F.filter("parts", lambda p: F.col("last").isNull() | (p["seq"] < F.col("last")))
    return grouped.select("message_id", F.array_join(F.transform(kept, lambda p: p["content"]), "").alias("content"), "ended")


def user_sessions(events: DataFrame, gap: str = "2 hours") -> DataFrame:
    """Sessions of a user's activity that end after ``gap`` without any."""
    grouped = events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return grouped.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def cached_hits(lookups: DataFrame, inserts: DataFrame, hours: int = 2, late: str = "10 minutes") -> DataFrame:
    """(lookup_id, insert_id): cache entries of the same key inserted within ``hours`` before a lookup; a join with a time bound, on streams or tables."""
    a = lookups.select(F.col("id").alias("lookup_id"), "key", F.col("ts").alias("asked_at"))
    b = inserts.select(F.col("id").alias("insert_id"), F.col("key").alias("insert_key"), F.col("ts").alias("inserted_at"))
    if lookups.isStreaming:
        a, b = watermarked(a, "asked_at", late), watermarked(b, "inserted_at", late)
    near = F.expr(f"key = insert_key AND inserted_at < asked_at AND inserted_at >= asked_at - INTERVAL {hours} HOURS")
    return a.join(b, near).select("lookup_id", "insert_id")


class AnswerCache:
    """Live entries of one key in the order of time; vectors stand in one array that doubles when it is full."""

    def __init__(self, least: float, span: float, entries: Iterable[tuple[float, int, np.ndarray]] = ()):
        self.least, self.span, self.times, self.ids, self.first, self.rows = least, span, [], [], 0, None
        for entry in entries:
            self.put(*entry)

    def put(self, t: float, i: int, vector: np.ndarray) -> None:
        n = len(self.ids)
        if self.rows is None or n == len(self.rows):
            live, self.times, self.ids = slice(self.first, n), self.times[self.first :], self.ids[self.first :]
            grown = np.zeros((max(16, 2 * (n - self.first)), len(vector)))
            norms = np.zeros(len(grown))
            if self.rows is not None:
                grown[: n - self.first], norms[: n - self.first] = self.rows[live], self.norms[live]
            self.rows, self.norms, self.first, n = grown, norms, 0, n - self.first
        self.rows[n], self.norms[n] = vector, np.linalg.norm(vector)
        self.times.append(t)
        self.ids.append(int(i))

    def ask(self, t: float, i: int, v) -> tuple[int | None, float | None]:
        """(entry id, similarity) of the most similar live entry, the older of equals; without one of ``least`` the question's own goes in."""
        while self.first < len(self.ids) and self.times[self.first] <= t - self.span:
            self.first += 1
        if v is None:
            return None, None
        vector, live = np.asarray(v, dtype=np.float64), slice(self.first, len(self.ids))
        if self.first < len(self.ids):
            norms = self.norms[live] * np.linalg.norm(vector)
            near = np.round(np.divide(self.rows[live] @ vector, norms, out=np.zeros(len(norms)), where=norms > 0), 9)
            best = int(near.argmax())
            if near[best] >= self.least:
                return self.ids[self.first + best], float(near[best])
        self.put(t, i, vector)
        return None, None


def semantic_cache(questions: DataFrame, least: float = 0.85, span: float = 7200.0) -> DataFrame:
    """(key, id, ts, entry_id, similarity) of every question (key, id, ts, vector): the cached answer it is given, in time order.

    A question is compared by cosine with the live entries of its key, no older than ``span`` seconds; without a hit its
    own answer is put in after the lookup, so entry_id is null. Rows sorted by key and time are folded batch by batch; only
    live entries are carried on. Rows with a null vector hit nothing and are not put in.
    """
    rows = questions.select("key", "id", "ts", "vector")
    kinds = dict(rows.dtypes)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, cache = None, None
        for batch in batches:
            hits, times = [], batch["ts"].astype("datetime64[us]").astype("int64")
            for k, i, t, v in zip(batch["key"], batch["id"], times, batch["vector"], strict=True):
                k = None if pd.isna(k) else k
                if cache is None or k != key:
                    key, cache = k, AnswerCache(least, span * 1e6)
                hits.append(cache.ask(t, i, v))
            yield batch[["key", "id", "ts"]].assign(entry_id=pd.array([h[0] for h in hits], dtype="Int64"), similarity=[h[1] for h in hits])

    dealt = rows.repartition("key").sortWithinPartitions("key", "ts", "id")
    return dealt.mapInPandas(fold, f"key {kinds['key']}, id long, ts {kinds['ts']}, entry_id long, similarity double")


class Progress(StreamingQueryListener):
    """What the streams that observe their rows have done so far, by name of the observation: running sums of each micro-batch's counts."""

    def __init__(self) -> None:
        self.totals: dict[str, dict[str, int]] = {}

    def onQueryProgress(self, event) -> None:
        for name, row in event.progress.observedMetrics.items():
            held = self.totals.setdefault(name, {})
            for k, v in row.asDict().items():
                held[k] = held.get(k, 0) + int(v or 0)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def ingest_levels_stream(spark: SparkSession, path: str, chunks: str, edges: str, progress: str, checkpoint: str, schema, files: int | None = None):
    """Ingests the Parquet files that arrive at ``path`` as parents, children and edges, and keeps count.

    Counts are taken by ``observe`` where the rows pass: ``read`` (documents, texts) and ``split`` (pages, chunks, edges) are in every
    progress report of the query, so a ``Progress`` listener follows a running stream; ``progress`` keeps a row for each batch.
    A micro-batch (``files`` files at most) writes its own folder of each table and its counts last: one that failed half way is
    run again after a restart and overwrites what it had left.
    """
    first = F.col("child_index") == 0
    counts = {"pages": F.count_if(first & (F.col("parent_index") == 0)), "chunks": F.count_if(first) + F.count(F.lit(1)), "edges": F.count(F.lit(1))}

    def write(batch: DataFrame, number: int) -> None:
        seen = Observation()
        levels = batch.persist()
        both = chunking.parents(levels).unionByName(chunking.children(levels))
        both.write.mode("overwrite").parquet(f"{chunks}/batch={number}")
        told = levels.observe(seen, *[v.alias(k) for k, v in counts.items()])
        chunking.edges(told).write.mode("overwrite").parquet(f"{edges}/batch={number}")
        row = [(int(seen.get[k] or 0)) for k in counts]
        spark.createDataFrame([row], ", ".join(f"{k} long" for k in counts)).coalesce(1).write.mode("overwrite").parquet(f"{progress}/batch={number}")
        levels.unpersist()

    reader = spark.readStream.schema(schema)
    source = (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(path)
    source = source.observe("read", F.count(F.lit(1)).alias("documents"), F.count("text").alias("texts"))
    levels = chunking.split_hierarchical(pages_of(source)).observe("split", *[v.alias(k) for k, v in counts.items()])
    return levels.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def without_repeats(events: DataFrame, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """Events once each; on a stream the keys are remembered within the watermark."""
    if events.isStreaming:
        return watermarked(events, "ts", late).dropDuplicatesWithinWatermark(keys)
    return events.dropDuplicates(keys)

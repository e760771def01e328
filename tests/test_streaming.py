"""Streams give what their batch twins give."""

import pytest
from pyspark.sql import functions as F

from docloom.plans.registry import read
from docloom.streaming import jobs, state


def run(stream, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return q.sparkSession.table(name) if hasattr(q, "sparkSession") else None


def test_windows_in_a_stream(spark, sf):
    events = spark.readStream.schema(read(spark, sf, "events").schema).parquet(f"{sf}/events.parque?")
    run(jobs.queue_windows(events), "windows", "complete")
    batch = jobs.queue_windows(read(spark, sf, "events"))
    assert sorted(map(tuple, spark.table("windows").collect())) == sorted(map(tuple, batch.collect()))


def test_chained_windows_in_a_stream(spark, sf, tmp_path):
    table = read(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    late = table.agg(F.max("ts").alias("ts")).select((F.col("ts") + F.expr("INTERVAL 9 DAYS")).alias("ts"), F.lit("view").alias("event_type"))
    for i, part in enumerate((table.orderBy("ts").limit(600), table.orderBy(F.col("ts").desc()).limit(table.count() - 600), late, late.select(F.col("ts") + F.expr("INTERVAL 9 DAYS"), "event_type").toDF("ts", "event_type"))):
        part.coalesce(1).write.parquet(f"{tmp_path}/in/part{i}")
    events = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    stream = jobs.success_windows(events)
    run(stream, "days")
    got = sorted(map(tuple, spark.table("days").where(F.col("start") <= table.agg(F.max("ts")).first()[0]).collect()))
    assert got == sorted(map(tuple, jobs.success_windows(table).collect()))


def test_rate_limit_folds():
    ok, held = jobs.admitted([0, 1, 2, 59, 60, 61, 62], [], 3, 60)
    assert ok == [True, True, True, False, True, True, True]
    assert held == [60, 61, 62]


def test_rate_limit_stream_equals_batch(spark, sf):
    pick = lambda e: e.select((F.col("user_id") % 3).alias("client"), F.col("event_id").alias("request_id"), "ts")
    events = spark.readStream.schema(read(spark, sf, "events").schema).parquet(f"{sf}/events.parque?")
    run(state.rate_limit_stream(pick(events), 2, 3600.0), "limits", "append")
    batch = jobs.rate_limit(pick(read(spark, sf, "events")), 2, 3600.0)
    assert sorted(map(tuple, spark.table("limits").collect())) == sorted(map(tuple, batch.collect()))


def test_every_user_is_a_client(spark, sf):
    from docloom.plans import catalogue

    events = read(spark, sf, "events")
    got = catalogue.queries()["k03_rate_limit"](spark, sf).collect()
    assert len(got) == events.count()
    assert {r.client for r in got} == {r.user_id for r in events.select("user_id").collect()}
    want = {}
    for user in {r.client for r in got}:
        mine = sorted((r.ts, r.request_id) for r in got if r.client == user)
        ok, _ = jobs.admitted([t.timestamp() for t, _ in mine], [], 4, 3600.0)
        want |= {request: a for (_, request), a in zip(mine, ok, strict=True)}
    assert {r.request_id: r.admitted for r in got} == want


def test_answers_stop_at_the_first_end(spark):
    rows = [(1, 0, "chunk", "a"), (1, 2, "done", None), (1, 1, "chunk", "b"), (1, 3, "chunk", "late"), (2, 0, "chunk", "x")]
    got = jobs.assemble_answers(spark.createDataFrame(rows, "message_id int, seq int, type string, content string"))
    assert {r.message_id: (r.content, r.ended) for r in got.collect()} == {1: ("ab", "done"), 2: ("x", None)}


def batches_of(spark, rows, schema, folder):
    """A stream that reads the given lists of rows one micro-batch after the other."""
    for i, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{folder}/part{i}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(folder))


def at(minute):
    from datetime import datetime, timedelta

    return datetime(2024, 1, 1) + timedelta(minutes=minute)


def test_answer_stream_equals_batch(spark, tmp_path):
    rows = [
        [(1, 0, "chunk", "a", at(0)), (2, 1, "chunk", "y", at(1))],
        [(1, 2, "done", None, at(2)), (1, 1, "chunk", "b", at(1)), (2, 0, "chunk", "x", at(0)), (1, 3, "chunk", "late", at(3))],
        [(9, 0, "chunk", "push", at(600))],
        [(9, 1, "error", "push", at(1200))],
    ]
    schema = "message_id long, seq long, type string, content string, ts timestamp"
    run(state.assemble_answers_stream(batches_of(spark, rows, schema, tmp_path)), "answers")
    batch = jobs.assemble_answers(spark.createDataFrame([r for part in rows for r in part], schema))
    want = {tuple(r) for r in batch.where("message_id < 9").collect()}
    got = {tuple(r) for r in spark.table("answers").collect() if r.message_id < 9}
    assert got == want == {(1, "ab", "done"), (2, "xy", None)}


def cache_rows(n=60):
    import random

    rng = random.Random(3)
    base = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(4)]
    out = []
    for i in range(n):
        near = base[rng.randrange(4)]
        out.append((i % 2, i, at(7 * i), [x + rng.gauss(0, 0.2) for x in near] if i % 11 else (None if i % 2 else [0.0] * 8)))
    return out


def brute_cache(rows, least, span):
    import numpy as np

    out = []
    for key in {r[0] for r in rows}:
        held = []
        for _, i, t, v in sorted((r for r in rows if r[0] == key), key=lambda r: (r[2], r[1])):
            best = None
            for h, then, w in held:
                if v is not None and (t - then).total_seconds() < span and np.linalg.norm(v) * np.linalg.norm(w) > 0:
                    near = round(float(np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w)), 9)
                    if near >= least and (best is None or near > best[1]):
                        best = (h, near)
            out.append((key, i, best[0] if best else None))
            if best is None and v is not None:
                held.append((i, t, v))
    return sorted(out, key=repr)


def test_semantic_cache_equals_brute_force_in_batch_and_stream(spark, tmp_path):
    rows, schema = cache_rows(), "key long, id long, ts timestamp, vector array<double>"
    want = brute_cache(rows, 0.85, 7200)
    assert sum(h is not None for _, _, h in want) > 10
    got = jobs.semantic_cache(spark.createDataFrame(rows, schema)).collect()
    assert sorted(((r.key, r.id, r.entry_id) for r in got), key=repr) == want
    run(state.semantic_cache_stream(batches_of(spark, [rows[i : i + 20] for i in (0, 20, 40)], schema, tmp_path)), "cache")
    assert sorted(((r.key, r.id, r.entry_id) for r in spark.table("cache").collect()), key=repr) == want


def left(spark, checkpoint, *names):
    """Entries that a stream's state still holds."""
    return sum(spark.read.format("statestore").option("stateVarName", n).load(str(checkpoint)).count() for n in names)


def kept_run(stream, name, checkpoint):
    q = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", str(checkpoint)).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()


def test_rate_limit_state_goes(spark, tmp_path):
    schema = "client long, request_id long, ts timestamp"
    rows = [[(1, i, at(0)) for i in range(3)], [(2, 9, at(300))], [(2, 10, at(301))]]
    kept_run(state.rate_limit_stream(batches_of(spark, rows, schema, tmp_path / "in"), 2, 60.0), "expiring", tmp_path / "state")
    got = {(r.client, r.request_id): r.admitted for r in spark.table("expiring").collect()}
    assert got == {(1, 0): True, (1, 1): True, (1, 2): False, (2, 9): True, (2, 10): True}
    held = spark.read.format("statestore").option("stateVarName", "log").load(str(tmp_path / "state"))
    assert {r.key[0] for r in held.select("key").collect()} == {2}  # client 1 is forgotten


def test_the_log_of_a_busy_client_stays_small(spark, tmp_path):
    schema = "client long, request_id long, ts timestamp"
    rows = [[(1, 100 * b + i, at(2 * b + i / 50)) for i in range(100)] for b in range(8)]
    kept_run(state.rate_limit_stream(batches_of(spark, rows, schema, tmp_path / "in"), 5, 60.0), "busy", tmp_path / "state")
    batch = jobs.rate_limit(spark.createDataFrame([r for b in rows for r in b], schema), 5, 60.0)
    assert sorted(map(tuple, spark.table("busy").collect())) == sorted(map(tuple, batch.collect()))
    held = spark.read.format("statestore").option("stateVarName", "log").load(str(tmp_path / "state"))
    assert held.count() <= 20  # of 80 admitted


def test_a_long_answer_comes_at_its_end_and_leaves_no_state(spark, tmp_path):
    n, parts = 100_000, 5
    schema, size = "message_id long, seq long, type string, content string, ts timestamp", n // parts
    for p in range(parts):
        end = F.col("seq") == n - 1
        part = spark.range(p * size, (p + 1) * size, 1, 1).select(F.lit(1).cast("long").alias("message_id"), F.col("id").alias("seq"))
        part = part.select("*", F.when(end, "done").otherwise("chunk").alias("type"), F.when(~end, F.col("seq").cast("string")).alias("content"), F.timestamp_seconds(F.lit(1_700_000_000 + p)).alias("ts"))
        part.write.parquet(f"{tmp_path}/in/part{p}")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    kept_run(state.assemble_answers_stream(source), "long", tmp_path / "state")
    assert [tuple(r) for r in spark.table("long").collect()] == [(1, "".join(map(str, range(n - 1))), "done")]  # though the watermark stands at its deltas
    assert left(spark, tmp_path / "state", "log") == 0


def test_answer_state_goes_with_the_watermark(spark, tmp_path):
    schema = "message_id long, seq long, type string, content string, ts timestamp"
    rows = [[(1, 1, "chunk", "b", at(0)), (2, 0, "chunk", "x", at(0)), (2, 1, "error", None, at(0))], [(1, 2, "done", None, at(1)), (2, 2, "chunk", "late", at(1))], [(9, 0, "chunk", "push", at(600))], [(9, 1, "chunk", "push", at(1200))]]
    kept_run(state.assemble_answers_stream(batches_of(spark, rows, schema, tmp_path / "in")), "gaps", tmp_path / "state")
    assert sorted(map(tuple, spark.table("gaps").where("message_id < 9").collect())) == [(1, "b", "done"), (2, "x", "error")]
    held = spark.read.format("statestore").option("stateVarName", "seen").load(str(tmp_path / "state"))
    assert {r.key[0] for r in held.select("key").collect()} <= {9}


def test_cache_state_goes(spark, tmp_path):
    schema = "key long, id long, ts timestamp, vector array<double>"
    rows = [[(1, 1, at(0), [1.0, 0.0]), (1, 2, at(1), [1.0, 0.1])], [(1, 3, at(2), [0.0, 1.0]), (2, 4, at(900), [1.0, 0.0])], [(2, 5, at(901), [1.0, 0.0])]]
    kept_run(state.semantic_cache_stream(batches_of(spark, rows, schema, tmp_path / "in")), "cached", tmp_path / "state")
    assert {r.id: r.entry_id for r in spark.table("cached").collect()} == {1: None, 2: 1, 3: None, 4: None, 5: 4}
    held = spark.read.format("statestore").option("stateVarName", "log").load(str(tmp_path / "state"))
    assert {r.key[0] for r in held.select("key").collect()} == {2}


def test_sessions_and_repeats_in_a_stream(spark, sf, tmp_path):
    table = read(spark, sf, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_id")
    path = f"{tmp_path}/events"
    table.coalesce(1).write.parquet(path)
    events = spark.readStream.schema(table.schema).parquet(path)
    run(jobs.user_sessions(events.withWatermark("ts", "1 hour")), "sessions", "append")
    batch = {tuple(r) for r in jobs.user_sessions(table).collect()}
    got = {tuple(r) for r in spark.table("sessions").collect()}
    assert got and got <= batch
    twice = spark.readStream.schema(table.schema).parquet(path).union(spark.readStream.schema(table.schema).parquet(path))
    run(jobs.without_repeats(twice, ["event_id"]), "once", "append")
    assert spark.table("once").count() == table.select("event_id").distinct().count()


def test_levels_are_ingested_with_their_edges(spark, sf, tmp_path):
    docs = read(spark, sf, "documents")
    names = [f"{tmp_path}/{x}" for x in ("chunks", "edges", "progress", "checkpoint")]
    jobs.ingest_levels_stream(spark, f"{sf}/documents.parque?", *names, docs.schema).awaitTermination()
    from docloom.operators import chunking
    from docloom.sources.tables import pages_of

    levels = chunking.split_hierarchical(pages_of(docs))
    edges = {tuple(r) for r in spark.read.parquet(names[1]).select("parent_chunk_id", "child_chunk_id", "child_index").collect()}
    assert edges == {tuple(r) for r in chunking.edges(levels).collect()}
    total = spark.read.parquet(names[2]).agg(F.sum("pages"), F.sum("edges")).first()
    assert tuple(total) == (levels.select("doc_id", "page_number").distinct().count(), len(edges))
    assert spark.read.parquet(names[0]).count() == chunking.parents(levels).count() + chunking.children(levels).count()


def test_ingestion_tells_its_progress_and_goes_on_after_a_failure(spark, sf, tmp_path, monkeypatch):
    import time

    from docloom.operators import chunking

    docs = read(spark, sf, "documents")
    docs.repartition(3).write.parquet(f"{tmp_path}/in")
    names = [f"{tmp_path}/{x}" for x in ("chunks", "edges", "progress", "checkpoint")]
    told = jobs.Progress()
    spark.streams.addListener(told)
    start = lambda: jobs.ingest_levels_stream(spark, f"{tmp_path}/in", *names, docs.schema, files=1)
    whole, calls = chunking.edges, []

    def failing(levels):
        calls.append(1)
        if len(calls) == 2:
            raise OSError("half way")
        return whole(levels)

    monkeypatch.setattr(chunking, "edges", failing)
    with pytest.raises(Exception, match="half way"):
        start().awaitTermination()
    assert spark.read.parquet(names[0]).select("batch").distinct().count() == 2  # the second has chunks, but no edges and no count
    assert spark.read.parquet(names[2]).count() == 1
    start().awaitTermination()
    chunks, edges, progress = (spark.read.parquet(n) for n in names[:3])
    total = progress.agg(F.sum("chunks"), F.sum("edges"), F.sum("pages")).first()
    assert (total[0], total[1]) == (chunks.count(), edges.count())
    assert chunks.select("chunk_id").distinct().count() == chunks.count()
    deadline = time.time() + 20
    while time.time() < deadline and told.totals.get("split", {}).get("edges", 0) < total[1]:
        time.sleep(0.2)
    spark.streams.removeListener(told)
    assert told.totals["split"] == {"pages": total[2], "chunks": total[0], "edges": total[1]}
    assert told.totals["read"]["documents"] == docs.count()

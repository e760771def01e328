"""Streams with state of their own by key: rate limits, answers and answer caches, on Spark's state store.

The state of a key is a list to which a micro-batch adds only its new entries; what has expired leaves when it is
most of the list, so the work is in proportion to the entries. One event-time timer for each key clears it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from docloom.streaming.jobs import AnswerCache, admitted, assembled, watermarked

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def micros(times: pd.Series) -> list[int]:
    return times.astype("datetime64[us]").astype("int64").tolist()


class ExpiringLog(StatefulProcessor):
    """A list of entries that begin with their time in microseconds, forgotten ``span`` seconds after the newest."""

    schema: str
    span: float

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.log = handle, handle.getListState("log", self.schema)

    def entries(self) -> list[tuple]:
        return list(self.log.get()) if self.log.exists() else []

    def add(self, live: list[tuple], stale: int, new: list[tuple]) -> None:
        if stale > len(live):
            self.log.put(live + new)
        elif new:
            self.log.appendList(new)

    def wake(self, newest: int, watermark: int) -> None:
        """See to it that the key is looked at when its newest entry (microseconds) has expired."""
        if next(iter(self.handle.listTimers()), None) is None:
            self.handle.registerTimer(max(newest // 1000 + int(self.span * 1000) + 1, watermark + 1))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        newest, watermark = max((e[0] for e in self.entries()), default=None), timerValues.getCurrentWatermarkInMs()
        if newest is not None and newest // 1000 + int(self.span * 1000) >= watermark:
            self.handle.registerTimer(newest // 1000 + int(self.span * 1000) + 1)
        else:
            self.log.clear()
        return iter(())

    def close(self) -> None:
        pass


def _stateful(rows: DataFrame, key: str, processor: StatefulProcessor, schema: str) -> DataFrame:
    """The store with several states for a key is the only one that can run these; it is set for the session's next queries."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return rows.groupBy(key).transformWithStateInPandas(processor, schema, "Append", "EventTime")


class _Limiter(ExpiringLog):
    schema = "at long"

    def __init__(self, limit: int, span: float):
        self.limit, self.span = limit, span

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        group = pd.concat(list(rows)).sort_values(["ts", "request_id"])
        times, before = micros(group["ts"]), sorted(e[0] for e in self.entries())
        live = [t for t in before if t > times[0] - self.span * 1e6]
        ok, _ = admitted(times, live, self.limit, self.span * 1e6)
        new = [t for t, a in zip(times, ok, strict=True) if a]
        self.add([(t,) for t in live], len(before) - len(live), [(t,) for t in new])
        self.wake(max([*live, *new]), timerValues.getCurrentWatermarkInMs())
        yield group.assign(client=key[0], admitted=ok)[["client", "request_id", "ts", "admitted"]]


def rate_limit_stream(requests: DataFrame, limit: int = 60, span: float = 60.0, late: str = "10 minutes") -> DataFrame:
    """``jobs.rate_limit`` over a stream: a client's state is the times of its admitted requests.

    Requests of a micro-batch are decided in the order of their time. The state goes when the watermark is ``span``
    seconds past the last admitted request.
    """
    rows = watermarked(requests.select("client", "request_id", "ts"), "ts", late)
    kinds = dict(rows.dtypes)
    return _stateful(rows, "client", _Limiter(limit, span), f"client {kinds['client']}, request_id {kinds['request_id']}, ts {kinds['ts']}, admitted boolean")


class _Assembler(ExpiringLog):
    schema, span = "at long, seq long, type string, content string", 0.0

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.seen = handle.getValueState("seen", "n long, highest long, ends long, newest long, told boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        n, highest, ends, newest, told = self.seen.get() if self.seen.exists() else (0, -1, 0, 0, False)
        for b in rows:
            times = micros(b["ts"])
            newest = max(newest, *times)
            if not told:
                new = [(t, int(s), k, None if pd.isna(c) else c) for t, s, k, c in zip(times, b["seq"], b["type"], b["content"], strict=True)]
                self.log.appendList(new)
                n, highest, ends = n + len(new), max(highest, *(r[1] for r in new)), ends + sum(r[2] in ("done", "error") for r in new)
        if not told and ends and n == highest + 1:  # as many as there can be without a gap
            found = self.entries()
            if len({r[1] for r in found}) == n and min(r[1] for r in found) == 0:
                yield self.told(key, found)
                told = True
                self.log.clear()
        self.seen.update((n, highest, ends, newest, told))
        self.wake(newest, timerValues.getCurrentWatermarkInMs())

    def told(self, key, found: list[tuple]) -> pd.DataFrame:
        content, ended = assembled([r[1:] for r in found])
        return pd.DataFrame({"message_id": [key[0]], "content": [content], "ended": [ended]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        _, _, _, newest, told = self.seen.get()
        if newest // 1000 >= timerValues.getCurrentWatermarkInMs():
            self.handle.registerTimer(newest // 1000 + 1)
            return
        if not told:
            yield self.told(key, self.entries())
        self.log.clear()
        self.seen.clear()


def assemble_answers_stream(deltas: DataFrame, late: str = "10 minutes") -> DataFrame:
    """``jobs.assemble_answers`` over a stream of (message_id, seq, type, content, ts); deltas come in any order.

    A message is put out as soon as it has an end and all numbers from 0 to the highest seen, else when the watermark has
    passed its newest delta. Its deltas leave the state then; what comes for it later, within ``late``, changes
    nothing. A micro-batch writes only its own deltas.
    """
    rows = watermarked(deltas.select("message_id", "seq", "type", "content", "ts"), "ts", late)
    return _stateful(rows, "message_id", _Assembler(), f"message_id {dict(rows.dtypes)['message_id']}, content string, ended string")


class _Cache(ExpiringLog):
    schema = "at long, id long, vector array<double>"

    def __init__(self, least: float, span: float):
        self.least, self.span = least, span

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        group = pd.concat(list(rows)).sort_values(["ts", "id"])
        times, before = micros(group["ts"]), sorted(self.entries(), key=lambda e: e[:2])
        live = [e for e in before if e[0] > times[0] - self.span * 1e6]
        cache = AnswerCache(self.least, self.span * 1e6, [(t, i, np.asarray(v)) for t, i, v in live])
        hits = [cache.ask(t, i, v) for t, i, v in zip(times, group["id"], group["vector"], strict=True)]
        new = [(t, int(i), [float(x) for x in v]) for t, i, v, h in zip(times, group["id"], group["vector"], hits, strict=True) if h[0] is None and v is not None]
        self.add(live, len(before) - len(live), new)
        self.wake(max((e[0] for e in [*live, *new]), default=times[-1]), timerValues.getCurrentWatermarkInMs())
        hit = pd.array([h[0] for h in hits], dtype="Int64")
        yield group[["id", "ts"]].assign(key=key[0], entry_id=hit, similarity=[h[1] for h in hits])[["key", "id", "ts", "entry_id", "similarity"]]


def semantic_cache_stream(questions: DataFrame, least: float = 0.85, span: float = 7200.0, late: str = "10 minutes") -> DataFrame:
    """``jobs.semantic_cache`` over a stream; the entries of a key go when the watermark has passed the life of the last one."""
    rows = watermarked(questions.select("key", "id", "ts", "vector"), "ts", late)
    return _stateful(rows, "key", _Cache(least, span), f"key {dict(rows.dtypes)['key']}, id long, ts timestamp, entry_id long, similarity double")

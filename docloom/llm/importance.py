"""Resampling towards a target distribution: hashed n-grams from running CRCs, weights, and a Gumbel draw."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import accumulate, islice
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import discard, materialize, numbered, small_batches, table, utf8
from docloom.llm.decontaminate import FOLD

BUCKETS, LONGEST = 10_000, 3
LEAST_WORDS, SHARE, SEED = 20, 5, 42
#: Longer texts are split piece by piece, and so many words go through numpy at a time; neither changes a result.
PIECE_BYTES, BLOCK_WORDS = 1 << 20, 1 << 17
_POLYNOMIAL = 0xEDB88320
_SHORT = 256


@cache
def _byte_step() -> np.ndarray:
    """What one zero byte makes of each low byte of a CRC."""
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, (out >> 1) ^ np.uint32(_POLYNOMIAL), out >> 1)
    return out


@cache
def _short_shifts() -> np.ndarray:
    """[length, byte of the CRC, value]: the CRC's share after so many zero bytes, for all lengths below 256; flat."""
    rows = [(np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None])]
    for _ in range(_SHORT - 1):
        rows.append(_byte_step()[rows[-1] & 255] ^ (rows[-1] >> 8))
    return np.concatenate([r.ravel() for r in rows])


@cache
def _doubled(power: int) -> np.ndarray:
    """[byte of the CRC, value], flat: the same for 256 * 2^power zero bytes."""
    start = _short_shifts()[-1024:] if power == 0 else _doubled(power - 1)
    if power == 0:
        return _byte_step()[start & 255] ^ (start >> 8)
    return _apply(start, np.int64(0), start)


def _apply(shifts: np.ndarray, base: np.ndarray | np.int64, crc: np.ndarray) -> np.ndarray:
    """XOR of what ``shifts`` holds from ``base`` on for the four bytes of each CRC."""
    parts = np.ascontiguousarray(crc, "<u4").view(np.uint8).reshape(-1, 4)
    out = shifts.take(parts[:, 0] + base)
    for k in (1, 2, 3):
        out ^= shifts.take(parts[:, k] + (base + 256 * k))
    return out


def shifted(crc: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Each CRC times x^(8 * length) over GF(2): what it adds to the CRC of a text that goes on for so many bytes."""
    out = _apply(_short_shifts(), (length & (_SHORT - 1)) << 10, crc)
    high, power = length >> 8, 0
    while high.any():
        odd = np.flatnonzero(high & 1)
        out[odd] = _apply(_doubled(power), np.int64(0), out[odd])
        high, power = high >> 1, power + 1
    return out


def prefixes(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(CRC after every word, bytes of every word) of the text's words, lower-cased and joined by one blank.

    Every byte is scanned once. Long texts are split piece by piece, between words.
    """
    folded, at, crc, crcs, sizes = utf8(text).translate(FOLD), 0, 0, [], []
    while at < len(folded):
        stop = folded.find(b" ", at + PIECE_BYTES)
        stop = len(folded) if stop < 0 else stop
        if words := folded[at:stop].split():
            sizes += map(len, words)
            led = b"\n ".join(words).split(b"\n")  # every word but the first with the blank before it
            led[0] = b" " + led[0] if crcs else led[0]
            crcs += islice(accumulate(led, lambda c, w: crc32(w, c), initial=crc), 1, None)
            crc = crcs[-1]
        at = stop
    return np.array(crcs, np.uint32), np.array(sizes, np.uint32)


def scanned(rows: DataFrame, id_col: str | None = "doc_id", text_col: str = "text", label: str = "importance-prefixes") -> DataFrame:
    """The written table (id, n_words, crcs, sizes) of running CRCs: 4 bytes a word, and 1 for its length (4 in texts with a word of 256 bytes).

    Any run of any number of words can be hashed from it; the text isn't read again.
    """
    small_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            both = [prefixes(t) for t in b.column(1).to_pylist()]
            sizes = [(s.astype(np.uint8) if s.max(initial=0) < 256 else s).tobytes() for _, s in both]
            yield table({"id": b.column(0), "n_words": pa.array([len(c) for c, _ in both], pa.int64()), "crcs": pa.array([c.tobytes() for c, _ in both], pa.binary()), "sizes": pa.array(sizes, pa.binary())})

    cut = rows.select((F.lit(None).cast("string") if id_col is None else F.col(id_col)).alias("id"), F.col(text_col).cast("string").alias("text"))
    return materialize(cut.mapInArrow(run, f"id {dict(cut.dtypes)['id']}, n_words long, crcs binary, sizes binary"), label)


def runs(batch: pa.RecordBatch, longest: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, bucket) of all runs of 1 to ``longest`` words of the scanned rows of a batch, in blocks of words.

    The CRC of a run is that after its last word, less that before its first word shifted by the length of the run.
    """
    n_words = batch.column(1).to_numpy(zero_copy_only=False)
    crcs = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint32)
    sizes = [np.frombuffer(s, np.uint8 if len(s) == n else np.uint32) for s, n in zip(batch.column(3).to_pylist(), n_words, strict=True)]
    sizes = np.concatenate([*sizes, np.zeros(0, np.uint8)])
    edges = np.concatenate([[0], np.cumsum(n_words)])
    for at in range(0, len(crcs), BLOCK_WORDS):
        low, high = max(0, at - longest + 1), min(len(crcs), at + BLOCK_WORDS)
        place = np.arange(low, high)
        owner = np.searchsorted(edges, place, "right") - 1
        inside = place - edges[owner]  # words of the text before this one
        after = crcs[low:high]
        ends = np.cumsum(sizes[low:high].astype(np.int64) + 1)
        starts = ends - sizes[low:high]
        inner = ~np.concatenate([crcs[low - 1 : low] if low else crcs[:1], after[:-1]])  # the CRC's inner state is the complement
        before = ~(_byte_step().take((inner ^ 32) & 255) ^ (inner >> 8))  # a blank further on
        before[inside == 0] = 0  # nothing stands before the first word
        for n in range(1, min(longest, high - low) + 1):
            many = high - low - n + 1
            kept = (inside[n - 1 :] >= n - 1) & (place[n - 1 :] >= at)
            crc = after[n - 1 :] ^ shifted(before[:many], ends[n - 1 :] - starts[:many])
            yield owner[n - 1 :][kept], (crc % np.uint32(buckets))[kept]


def bucket_counts(prefix_table: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): how many features of all scanned texts fall into each bucket; a task sends one row a bucket at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for _, found in runs(b, longest, buckets):
                total += np.bincount(found, minlength=buckets)
        used = np.flatnonzero(total)
        yield table({"bucket": pa.array(used, pa.int64()), "n": pa.array(total[used], pa.int64())})

    return prefix_table.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> np.ndarray:
    """floor(1000 * ln((t + 1) * (S + buckets) / ((s + 1) * (T + buckets)))) of each bucket, from two scanned tables.

    ``buckets`` bounds what is fetched.
    """
    source = bucket_counts(docs, longest, buckets).select("bucket", F.col("n").alias("s"))
    wanted = bucket_counts(target, longest, buckets).select("bucket", F.col("n").alias("t"))
    every = docs.sparkSession.range(buckets).withColumnRenamed("id", "bucket")
    both = materialize(every.join(source, "bucket", "left").join(wanted, "bucket", "left").fillna(0), "importance-buckets")
    all_s, all_t = both.agg(F.sum("s"), F.sum("t")).first()
    real = lambda c, more: F.col(c).cast("double") + F.lit(float(more))
    ratio = real("t", 1) * F.lit(float(all_s + buckets)) / (real("s", 1) * F.lit(float(all_t + buckets)))
    out = np.zeros(buckets, np.int64)
    for bucket, gain in both.select("bucket", F.floor(F.log(ratio) * 1000)).collect():
        out[bucket] = gain
    return out


def weighed(docs: DataFrame, gain: np.ndarray, longest: int = LONGEST) -> DataFrame:
    """(id, n_words, n_features, weight) of a scanned table: the sum of the gains of all features of each row."""
    sent, buckets = docs.sparkSession.sparkContext.broadcast(gain), len(gain)  # 8 bytes a bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            features, weight = np.zeros(n, np.int64), np.zeros(n, np.int64)
            for owner, found in runs(b, longest, buckets):
                features += np.bincount(owner, minlength=n)
                weight += np.bincount(owner, weights=sent.value[found], minlength=n).astype(np.int64)  # exact below 2^53
            yield table({"id": b.column(0), "n_words": b.column(1), "n_features": pa.array(features), "weight": pa.array(weight)})

    return docs.mapInArrow(run, f"id {dict(docs.dtypes)['id']}, n_words long, n_features long, weight long")


def gumbel(seed: int | str, key: F.Column) -> F.Column:
    """floor(1000 * a draw from the standard Gumbel law), the same for a key in every run; a null key draws as an empty one."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.log(-F.log((h.cast("double") + 0.5) / 4294967296.0)) * -1000)


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", share: int = SHARE, least_words: int = LEAST_WORDS, seed: int | str = SEED, longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """(id, n_words, n_features, weight, score, rank) of every row; rank (from 1) of the drawn rows, else null.

    The weight of a text is its log ratio of target to source under hashed n-grams. Adding a Gumbel draw and taking
    the highest scores samples without replacement by weight. Of the N texts with ``least_words`` words or more,
    floor(share * N / 100) are drawn; ties go to the smaller id, and null ids come last. Texts are scanned once; counts
    and weights come from the written CRCs, and what is sorted for the draw has neither.

    Null and empty texts have no features and a weight of 0. Repeated rows are judged and drawn one by one. An empty
    target makes all texts unlike it alike by counts; an empty table gives no rows. Other columns play no part.
    """
    source = scanned(docs, id_col, text_col)
    wanted = scanned(target, None, target_text, "importance-target")
    scored = weighed(source, gains(source, wanted, longest, buckets), longest).withColumn("score", F.col("weight") + gumbel(seed, F.col("id")))
    scored = materialize(scored, "importance-scored")
    discard(source, wanted)
    drawn = scored.where(F.col("n_words") >= least_words).count() * share // 100
    listed = numbered(scored.withColumn("short", F.col("n_words") < least_words), [F.col("short"), F.col("score").desc(), F.col("id").asc_nulls_last()], "importance-ranked")
    rank = F.when(F.col("place") < drawn, F.col("place") + 1)
    return listed.select("id", "n_words", "n_features", "weight", "score", rank.alias("rank"))


def drawn(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """The rows whose id was drawn, with all their columns; ids are joined, texts are not exchanged for it if they are few."""
    taken = resample(docs, target, id_col, **how).where("rank is not null").select(F.col("id").alias("drawn_id"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("own_id"))
    return rows.join(taken, F.col("own_id").eqNullSafe(F.col("drawn_id")), "left_semi").select("row.*")

"""Fuzzy line deduplication: MinHash bands, exact Jaccard verification, distributed union-find."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import BATCH_ROWS, discard, materialize, release, small_batches, table, utf8
from docloom.llm.components import connected_components
from docloom.llm.verify import verified, with_texts

SHINGLE = 5
THRESHOLD = 0.8
#: By formula 12 bands of 7 rows meet in 94 of 100 pairs at similarity 0.8, in 99 at 0.85 and in 29 at 0.6.
BANDS, ROWS = 12, 7
#: Shingles handled at once, so that arrays stay in a core's cache.
CHUNK = 1 << 16
#: Lines that a task remembers in order not to sign a repeated line twice.
SEEN_LINES = 500_000
#: Lines whose band keys a task folds before it sends them on.
FOLD_LINES = 150_000
#: Key ranges in which they are sent, as a power of two, and the keys that a task looks through at once.
RANGE_BITS, FULL = 14, 1 << 20
#: The key of a line that occurs several times. Band keys end in the number of their band.
REPEATED, BAND_BITS = 15, 4
#: Up to so many nodes around a hub are compared pair by pair, over so many shingles at once.
FEW, COLUMNS = 8, 1 << 14
#: Most bits of the filter that keeps lines without candidates away from the text exchange.
FILTER_BITS = 1 << 26
_ASCII_SPACES = "\t\x0b\x0c\r\x1c\x1d\x1e\x1f"
#: All white space but the blank and the line feed.
_SPACES = _ASCII_SPACES + "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_rng = np.random.default_rng(20_240_229)
_MULTIPLIERS = (_rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint64) | 1).astype(np.uint32)
_PLACES = (_rng.integers(0, 1 << 32, SHINGLE, dtype=np.uint64) | 1).astype(np.uint32)
#: Marks, in the Bloom filter, the lines that have a bucket.
_NEAR = np.uint64(0x6A09E667F3BCC909)
_MIXERS = _rng.integers(0, 1 << 63, ROWS, dtype=np.uint64) | np.uint64(1)


def normal(line: str) -> str:
    """Lines are compared in lower case, with runs of white space as one blank."""
    line = line.lower()
    if line.isprintable() and "  " not in line and line[:1] != " " != line[-1:]:
        return line  # no white space but single blanks inside
    return " ".join(line.split())


def normal_lines(text: str) -> list[str]:
    """``normal`` of each line of a text; most texts have no white space but single blanks and line feeds."""
    low = text.lower()
    if "  " not in low and not any(x in low for x in (_ASCII_SPACES if low.isascii() else _SPACES)):
        return [line if line[:1] != " " != line[-1:] else line.strip(" ") for line in low.split("\n")]
    return [normal(line) for line in text.split("\n")]


def shingles(line: str) -> set[str]:
    """Distinct character shingles; a shorter line is its own shingle."""
    return {line[i : i + SHINGLE] for i in range(max(1, len(line) - SHINGLE + 1))}


def digest(line: str) -> bytes:
    return xxhash.xxh128_digest(utf8(line))


def shingle_hashes(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """32-bit hashes of the shingles of all lines, one after the other, and the number of places by line.

    A line has SHINGLE - 1 places more than characters; those after its last shingle repeat its first.
    """
    pad = "\n" * (SHINGLE - 1)
    codes = np.frombuffer((pad.join(lines) + pad + pad).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    sizes = np.fromiter((len(x) for x in lines), dtype=np.int64, count=len(lines))
    places = sizes + SHINGLE - 1
    n = int(places.sum())
    hashed = codes[:n] * _PLACES[0]
    for k in range(1, SHINGLE):
        hashed += codes[k : k + n] * _PLACES[k]
    starts = np.cumsum(places) - places
    spare = places - np.maximum(1, sizes - SHINGLE + 1)
    after = np.repeat(starts + places - np.cumsum(spare), spare) + np.arange(spare.sum())
    hashed[after] = np.repeat(hashed[starts], spare)
    return hashed, places


def band_keys(lines: list[str]) -> np.ndarray:
    """[line, band] 64-bit keys from MinHash signatures of normalised, non-empty lines."""
    out = np.empty((len(lines), BANDS), dtype=np.int64)
    at = 0
    while at < len(lines):
        end, total = at, 0
        while end < len(lines) and (end == at or total + len(lines[end]) <= CHUNK):
            total += len(lines[end])
            end += 1
        hashed, places = shingle_hashes(lines[at:end])
        hashed = (hashed ^ (hashed >> np.uint32(15))) * np.uint32(0x85EBCA6B)
        hashed ^= hashed >> np.uint32(13)
        firsts = np.cumsum(places) - places
        least = np.empty((BANDS * ROWS, end - at), dtype=np.uint32)
        product = np.empty_like(hashed)
        for k, multiplier in enumerate(_MULTIPLIERS):
            np.minimum.reduceat(np.multiply(hashed, multiplier, out=product), firsts, out=least[k])
        band = np.arange(BANDS, dtype=np.uint64)[:, None]
        key = np.repeat(band * np.uint64(0x2545F491) + np.uint64(1), end - at, axis=1)
        for r in range(ROWS):
            key = (key ^ (least[r::ROWS].astype(np.uint64) * _MIXERS[r])) * np.uint64(0x94D049BB133111EB)
            key ^= key >> np.uint64(29)
        key = key >> np.uint64(BAND_BITS) << np.uint64(BAND_BITS) | band
        out[at:end] = key.view(np.int64).T
        at = end
    return out


def short(line: str) -> int:
    """64-bit number of a line among the candidates; lines that should share one are told apart by their digests."""
    return xxhash.xxh3_64_intdigest(utf8(line))


def _runs(keys: np.ndarray) -> np.ndarray:
    """Where the runs of equal keys begin, and the number of keys at the end."""
    return np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])


def _packed(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """The bytes of values[bounds[i] : bounds[i + 1]] as one item each."""
    offsets = ((bounds - bounds[0]) * 8).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values[bounds[0] : bounds[-1]]))])


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, shared, keys, ids): band keys and lines, those of one key range together.

    Lines that share a bucket within a task are told at once (shared), in pieces, and so are those that occur
    twice there (key ``REPEATED``). One line of each bucket of a task is sent to the key's range, so a range has
    a line for each task however many lines share the key.
    """
    seen: set[int] = set()
    again: set[int] = set()
    keys: list[np.ndarray] = []
    ids: list[np.ndarray] = []

    def fold() -> Iterator[pa.RecordBatch]:
        key = np.concatenate([np.empty((0, BANDS), dtype=np.int64), *keys]).ravel()
        line = np.repeat(np.concatenate([np.empty(0, dtype=np.int64), *ids]), BANDS)
        twice = np.array(list(again), dtype=np.uint64).view(np.int64)
        keys.clear()
        ids.clear()
        again.clear()
        order = np.argsort(key)
        key, line = key[order], line[order]
        begin = _runs(key)
        several = np.repeat(np.diff(begin) > 1, np.diff(begin))
        begin = begin[:-1] if len(key) else begin[:0]
        told = np.append(key[several], np.full(len(twice), REPEATED)), np.append(line[several], twice)
        for shared, key, line in ((False, key[begin], line[begin]), (True, *told)):
            if not len(key):
                continue
            bounds = np.append(np.arange(0, len(key), CHUNK // 8), len(key)) if shared else _runs(key >> (64 - RANGE_BITS))
            part = (line if shared else key)[bounds[:-1]] >> (64 - RANGE_BITS)
            for lo in range(0, len(part), BATCH_ROWS):
                some = bounds[lo : lo + BATCH_ROWS + 1]
                n = len(some) - 1
                yield table({"part": pa.array(part[lo : lo + n].astype(np.int32)), "shared": pa.array(np.full(n, shared)), "keys": _packed(key, some), "ids": _packed(line, some)})

    for b in batches:
        lines = {}
        for text in b.column(2).to_pylist():
            for line in normal_lines(text) if text else ():
                if not line:
                    continue
                if (node := short(line)) in seen:
                    again.add(node)
                else:
                    seen.add(node)
                    lines[node] = line
        if lines:
            keys.append(band_keys(list(lines.values())))
            ids.append(np.array(list(lines), dtype=np.uint64).view(np.int64))
        if sum(map(len, ids)) > FOLD_LINES or len(seen) > SEEN_LINES:
            yield from fold()
        if len(seen) > SEEN_LINES:
            seen.clear()
    if ids or again:
        yield from fold()


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, id) of the keys with several lines, from rows of ``_banded`` in order of their ranges.

    A line that several tasks have and that shares no bucket in any of them meets itself here; it is told
    once, by its first band, under the key ``REPEATED``.
    """
    keys: list[bytes] = []
    ids: list[bytes] = []
    last, size = None, 0

    def pairs(key: np.ndarray, line: np.ndarray) -> pa.RecordBatch:
        return table({"key": pa.array(key), "id": pa.array(line)})

    def meet() -> Iterator[pa.RecordBatch]:
        key, line = (np.frombuffer(b"".join(x), dtype=np.int64) for x in (keys, ids))
        order = np.argsort(key)
        key, line = key[order], line[order]
        sizes = np.diff(_runs(key))
        many = np.repeat(sizes > 1, sizes)
        key, line = key[many], line[many]
        order = np.lexsort((line, key))
        key, line = key[order], line[order]
        begin = _runs(key)
        sizes = np.diff(begin)
        apart = np.repeat(line[begin[:-1]] != line[begin[1:] - 1], sizes) if len(key) else many[:0]
        yield pairs(key[apart], line[apart])
        own = np.flatnonzero((key[1:] == key[:-1]) & (line[1:] == line[:-1]) & (key[1:] % (1 << BAND_BITS) == 0))
        own = np.unique(line[1:][own])
        yield pairs(np.full(len(own), REPEATED), own)

    for b in batches:
        for part, shared, key, line in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if shared:
                yield pairs(np.frombuffer(key, dtype=np.int64), np.frombuffer(line, dtype=np.int64))
                continue
            if part != last and size > 8 * FULL:
                yield from meet()
                keys.clear()
                ids.clear()
                size = 0
            last = part
            keys.append(key)
            ids.append(line)
            size += len(key)
    if keys:
        yield from meet()


def line_buckets(rows: DataFrame) -> DataFrame:
    """(key, id) of the band buckets with two lines or more, and of the lines that occur twice or more.

    The latter have the key ``REPEATED``. It may be missing for a line that is in a bucket.
    """
    bands = rows.mapInArrow(_banded, "part int, shared boolean, keys binary, ids binary")
    return bands.repartition("part").sortWithinPartitions("part").mapInArrow(_met, "key long, id long").distinct()


def candidate_buckets(rows: DataFrame) -> DataFrame:
    """(key, id) of the band buckets with two lines or more."""
    return line_buckets(rows).where(F.col("key") != REPEATED)


def _bits(ids: np.ndarray, bits: int) -> np.ndarray:
    mixed = ids * np.uint64(0x9E3779B97F4A7C15)
    return np.stack([ids, mixed ^ (mixed >> np.uint64(29)), ids ^ (mixed >> np.uint64(7))]) % np.uint64(bits)


def line_finds(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, digest, text, doc, version, pos): where the wanted lines (id, near) stand, by one more scan.

    A Bloom filter of at most ``FILTER_BITS`` bits goes to the tasks, so that few other lines are told. With far more
    lines than the filter can tell apart, others are told as well, which occur once and have no bucket. The text stands
    where a task first meets a line that may be near another.
    """
    spark = rows.sparkSession
    bits = int(min(FILTER_BITS, 64 * max(1, wanted.count() * 24 // 64)))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                ids = b.column(0).to_numpy().view(np.uint64)
                near = ids[b.column(1).to_numpy(zero_copy_only=False)] ^ _NEAR
                at = np.unique(_bits(np.concatenate([ids, near]), bits).ravel())
                yield table({"word": pa.array((at // 64).astype(np.int64)), "mask": pa.array((np.uint64(1) << (at % np.uint64(64))).view(np.int64))})

    marked = wanted.select("id", "near").mapInArrow(mark, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toPandas()
    words = np.zeros(bits // 64, dtype=np.uint64)
    words[marked["word"].to_numpy()] = marked["mask"].to_numpy().astype(np.int64).view(np.uint64)
    sent = spark.sparkContext.broadcast(words)  # at most 8 MB

    def held(ids: np.ndarray) -> list[bool]:
        at = _bits(ids, bits)
        return ((sent.value[(at // np.uint64(64)).astype(np.int64)] >> (at % np.uint64(64))) & np.uint64(1)).all(axis=0)

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for b in batches:
            lines, owner, pos = [], [], []
            for i, text in enumerate(b.column(2).to_pylist()):
                for k, line in enumerate(normal_lines(text) if text else ()):
                    if line:
                        lines.append(line)
                        owner.append(i)
                        pos.append(k)
            if not lines:
                continue
            ids = np.array([short(x) for x in lines], dtype=np.uint64)
            hit = np.flatnonzero(held(ids))
            ids = ids[hit]
            digests, texts = [], []
            for at, near in zip(hit.tolist(), held(ids ^ _NEAR).tolist(), strict=True):
                line = lines[at]
                digests.append(d := digest(line))
                texts.append(line if near and d not in seen else None)
                if near:
                    seen.add(d)
            owner = pa.array(np.array(owner, dtype=np.int64)[hit])
            yield table({
                "id": pa.array(ids.view(np.int64)), "digest": pa.array(digests, pa.binary()), "text": pa.array(texts, pa.string()),
                "doc": b.column(0).take(owner), "version": b.column(1).take(owner), "pos": pa.array(np.array(pos, dtype=np.int32)[hit]),
            })
            if len(seen) > SEEN_LINES:
                seen.clear()

    return rows.mapInArrow(fetch, f"id long, digest binary, text string, doc {dict(rows.dtypes)['doc']}, version long, pos int")


def numbered_shingles(line: str) -> tuple[np.ndarray, np.ndarray] | None:
    """The distinct shingles in order, each as one number of 60 bits, and a place of each; None if a character needs over 12 bits."""
    n = len(line) - SHINGLE + 1
    codes = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    if n < 1 or codes.max() >= 1 << 12:
        return None
    codes = codes.astype(np.uint64)
    number = codes[:n].copy()
    for k in range(1, SHINGLE):
        number <<= np.uint64(12)
        number |= codes[k : k + n]
    place = np.argsort(number)
    number = number[place]
    new = np.concatenate([[True], number[1:] != number[:-1]])
    return number[new], place[new]


def _absent(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the numbers a are not among b, both in order."""
    return b[np.minimum(np.searchsorted(b, a), len(b) - 1)] != a


def difference(hub: str, line: str, base: tuple[np.ndarray, np.ndarray] | None) -> tuple[list[str], list[str], int]:
    """The shingles that a line has besides its hub's, those that it lacks, and the number of its shingles.

    ``base`` is ``numbered_shingles(hub)``; where it is None, or would be for the line, the sets of texts are compared.
    """
    if base is None or (own := numbered_shingles(line)) is None:
        ours, theirs = shingles(line), shingles(hub)
        return list(ours - theirs), list(theirs - ours), len(ours)
    extra = own[1][_absent(own[0], base[0])].tolist()
    lack = base[1][_absent(base[0], own[0])].tolist()
    return [line[i : i + SHINGLE] for i in extra], [hub[i : i + SHINGLE] for i in lack], len(own[0])


def _shingle_number(shingle: str) -> int:
    """As in ``numbered_shingles``; a shingle that has no such number gets a hash below zero."""
    if len(shingle) == SHINGLE and max(shingle) < "\u1000":
        return sum(ord(c) << 12 * k for k, c in enumerate(reversed(shingle)))
    return (xxhash.xxh3_64_intdigest(utf8(shingle)) >> 1) - (1 << 63)


def numbered_difference(hub: str, line: str, base: tuple[np.ndarray, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray, int]:
    """As ``difference``, with numbers for the shingles."""
    if base is None or (own := numbered_shingles(line)) is None:
        more, less, size = difference(hub, line, None)
        return *(np.array([_shingle_number(x) for x in part], dtype=np.int64) for part in (more, less)), size
    return own[0][_absent(own[0], base[0])].view(np.int64), base[0][_absent(base[0], own[0])].view(np.int64), len(own[0])


def _compared(batches: Iterator[pa.RecordBatch], differ: Callable, lists: Callable) -> Iterator[pa.RecordBatch]:
    last, base = None, None
    for b in batches:
        near, sizes, more, less = [], [], [], []
        for hub, text in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
            if hub != last:
                last, base = hub, numbered_shingles(hub)
            extra, lack, size = differ(hub, text, base)
            near.append((size - len(extra)) / (size + len(lack)) >= THRESHOLD)  # the Jaccard similarity
            sizes.append(size)
            more.append(extra)
            less.append(lack)
        yield table({"hub": b.column(0), "node": b.column(1), "near": pa.array(near, pa.bool_()), "size": pa.array(sizes, pa.int32()), "more": lists(more), "less": lists(less)})


def _deltas(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compares (hub, node, text of hub, text of node) and keeps what the node has besides its hub, and what it lacks."""
    yield from _compared(batches, difference, lambda x: pa.array(x, pa.list_(pa.string())))


def _number_lists(lists: list[np.ndarray]) -> pa.Array:
    offsets = np.cumsum([0, *map(len, lists)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.empty(0, dtype=np.int64), *lists])))


def _numbered_deltas(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """As ``_deltas``, with numbers for the shingles."""
    yield from _compared(batches, numbered_difference, _number_lists)


def _few_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, node2): similar nodes of different roots around one hub, from (hub, node, root, size, delta) in order of the hub.

    The shingles in which two nodes differ are those in one delta only, be they extra or lacking. A hub has ``FEW`` nodes at most.
    """
    slack = (1 - THRESHOLD) / (1 + THRESHOLD)
    kept: list[tuple] = []

    def pairs() -> tuple[np.ndarray, np.ndarray]:
        node, root, size = (np.array([r[k] for r in kept]) for k in (1, 2, 3))
        count = np.array([len(r[4]) for r in kept])
        token, inverse, times = np.unique(np.concatenate([r[4] for r in kept]), return_inverse=True, return_counts=True)
        common = np.zeros((len(kept), len(kept)))
        column = np.where(times > 1, np.cumsum(times > 1) - 1, -1)[inverse]
        row = np.repeat(np.arange(len(kept)), count)
        for lo in range(0, int((times > 1).sum()), COLUMNS):
            here = (column >= lo) & (column < lo + COLUMNS)
            has = np.zeros((len(kept), min(COLUMNS, int(column.max()) + 1 - lo)), dtype=np.float32)
            has[row[here], column[here] - lo] = 1
            common += has @ has.T
        fits = count[:, None] + count - 2 * common <= slack * (size[:, None] + size) + 1e-6
        a, b = np.nonzero(fits & (root[:, None] != root) & (node[:, None] < node))
        return node[a], node[b]

    def made(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        none = np.empty(0, dtype=np.int64)
        return table({name: pa.array(np.concatenate([none, *(p[k] for p in parts)])) for k, name in enumerate(("node", "node2"))})

    for b in batches:
        found = []
        delta = b.column(4)
        values, offsets = delta.values.to_numpy(), delta.offsets.to_numpy()
        for i, r in enumerate(zip(*(b.column(k).to_pylist() for k in range(4)), strict=True)):
            if kept and r[0] != kept[0][0]:
                found.append(pairs())
                kept.clear()
            kept.append((*r, values[offsets[i] : offsets[i + 1]]))
        yield made(found)
    if kept:
        yield made([pairs()])


def open_pairs(stars: DataFrame, roots: DataFrame) -> DataFrame:
    """(u, v): the pairs around one hub, in different components so far, that may be as similar as ``THRESHOLD``.

    Let a node have E shingles besides its hub's and lack M of them. Two nodes of sizes a and b are similar
    if they differ in at most T = (1 - t) / (1 + t) * (a + b) shingles. They differ in at least
    E1 + E2 - 2 * (extras shared) + abs(M1 - M2), and likewise with M and E exchanged. So they share so many
    extras, or else so many lacking shingles, or else (both numbers being zero) are close to the hub themselves.
    A shared shingle is looked for by equi-join, rarest ones first: if what follows it in both nodes
    can't make up the number, the pair has shared a rarer one or isn't similar. Independent changes of one line share
    nothing but what is common to all, so a large group of near copies makes few pairs. No similar pair is missed.
    Around a hub with up to ``FEW`` nodes the numbers are simply counted for each pair.
    ``more`` and ``less`` hold the shingles or numbers that stand for them.
    """
    slack = (1 - THRESHOLD) / (1 + THRESHOLD)
    rooted = stars.select("hub", "node", "size").join(roots, "node", "left").withColumn("root", F.coalesce("component", "node"))
    mixed = rooted.groupBy("hub").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.max("size").alias("most"), F.count("*").alias("members")).where("low <> high")
    placed = rooted.join(mixed, "hub").select("hub", "node", "root", "most", "members")
    if "string" in dict(stars.dtypes)["more"]:
        stars = stars.withColumns({c: F.transform(c, lambda x: F.xxhash64(x)) for c in ("more", "less")})
    around = stars.join(placed, ["hub", "node"]).withColumn("e", F.size("more")).withColumn("m", F.size("less"))  # the shingles move once
    around = materialize(around.select("hub", "node", "near", "root", "size", "most", "members", "e", "m", "more", "less"), "lines-around")
    whole = around

    bare = ["hub", "node", "root", "size", "e", "m"]
    other = lambda df: df.toDF(*[c if c in ("hub", "kind", "token") else f"{c}2" for c in df.columns])
    both = lambda f, c: f(F.col(c), F.col(f"{c}2"))
    apart = lambda c: F.abs(F.col(c) - F.col(f"{c}2"))
    limit = slack * (F.col("size") + F.col("size2")) + 1e-6
    distinct = F.col("root") != F.col("root2")

    # a few nodes: their pairs are compared by the shingles themselves
    few = around.where(F.col("members") <= FEW).select("hub", "node", "root", "size", F.concat("more", "less").alias("delta"))
    alike = few.repartition("hub").sortWithinPartitions("hub").mapInArrow(_few_pairs, "node long, node2 long")

    around = around.where(F.col("members") > FEW)
    # lacking shingles only count where extras are few enough not to be shared
    lacking = around.where(F.col("e") <= slack * F.col("size") * (1 + 1 / THRESHOLD) + 1e-6)
    kinds = [df.select("hub", "node", F.lit(i).alias("kind"), F.explode(c).alias("token")) for i, (df, c) in enumerate(((around, "more"), (lacking, "less")))]
    tokens = kinds[0].union(kinds[1])
    often = tokens.groupBy("hub", "kind", "token").agg(F.count("*").alias("n")).where("n > 1")
    counted = tokens.join(often, ["hub", "kind", "token"]).join(around.select(*bare), ["hub", "node"])
    own = Window.partitionBy("hub", "kind", "node")
    # those that no other node has come first, and are not there any more
    alone = F.when(F.col("kind") == 0, F.col("e")).otherwise(F.col("m")) - F.count("*").over(own)
    placed = materialize(counted.withColumn("at", alone + F.row_number().over(own.orderBy("n", "token"))).drop("n"), "lines-tokens")

    def shared(a: str, b: str) -> Column:
        return F.col(a) + F.col(f"{a}2") + apart(b) - limit  # twice the number that must be shared

    def enough(a: str, b: str) -> Column:
        return 2 * (1 + F.least(F.col(a) - F.col("at"), F.col(f"{a}2") - F.col("at2"))) >= shared(a, b)

    fits = (apart("e") + apart("m") <= limit) & F.when(F.col("kind") == 0, enough("e", "m")).otherwise((shared("e", "m") <= 0) & enough("m", "e"))
    found = placed.join(other(placed), ["hub", "kind", "token"]).where((F.col("node") < F.col("node2")) & distinct & fits).select("node", "node2")

    # of two nodes this close to their hub, one at least isn't similar to it and so lies in a narrow ring
    tight = around.where(F.col("e") + F.col("m") <= slack * F.col("size") * (1 + 1 / THRESHOLD) + 1e-6)
    outer = tight.where(~F.col("near") & (F.col("e") + F.col("m") <= slack * (F.col("size") + F.col("most")) + 1e-6)).select(*bare)
    close = outer.join(other(tight.select(*bare)), "hub").where(distinct & (both(F.greatest, "e") + both(F.greatest, "m") <= limit) & (F.col("node") != F.col("node2")))
    close = close.select(both(F.least, "node").alias("node"), both(F.greatest, "node").alias("node2"))
    pairs = materialize(alike.union(found).union(close).toDF("u", "v").distinct(), "lines-pairs")
    discard(whole, placed)
    return pairs


def line_components(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, component) of the lines with a near duplicate, and (node, doc, version, pos) of all lines that may repeat.

    A node is the digest of a line, components have numbers. Lines that occur once and are near none may be missing among the latter.

    Every bucket has a hub, its line with the most company. All its lines are compared with the hub first, which
    folds large groups of near copies at a cost linear in their size. Of the pairs of a bucket that lie in
    different components after that, those that what is known of both against the hub does not rule out
    are verified one by one (``open_pairs``). So every banded pair is verified, ruled out or already united.
    """
    spark = rows.sparkSession
    both = materialize(line_buckets(rows), "lines-buckets")
    release(spark)
    banded = both.where(F.col("key") != REPEATED)
    wanted = materialize(both.groupBy("id").agg(F.max(F.col("key") != REPEATED).alias("near")), "lines-candidates")
    finds = materialize(line_finds(rows, wanted), "lines-occurrences")
    # short numbers stand for the candidate lines from here on
    texts = finds.where("text is not null").select("id", "digest", "text").join(wanted.where("near").select("id"), "id", "left_semi")
    texts = texts.groupBy("digest").agg(F.min("id").alias("id"), F.min("text").alias("text"))
    texts = materialize(texts.select(F.monotonically_increasing_id().alias("node"), "id", "digest", "text"), "lines-texts")
    members = materialize(banded.join(texts.select("id", "node"), "id").select("key", "node"), "lines-members")
    release(spark)
    discard(both, wanted)
    company = members.join(members.groupBy("key").agg(F.count("*").alias("n")), "key").groupBy("node").agg(F.sum("n").alias("company"))
    ranked = materialize(members.join(company, "node"), "lines-ranked")
    hubs = ranked.groupBy("key").agg(F.max(F.struct("company", "node")).alias("top")).select("key", F.col("top.node").alias("hub"))
    spokes = ranked.join(hubs, "key").where("node <> hub").select("hub", "node").distinct()
    kind = "hub long, node long, near boolean, size int, more array<long>, less array<long>"
    stars = materialize(with_texts(spokes, texts).mapInArrow(_numbered_deltas, kind), "lines-stars")
    release(spark)
    discard(members, ranked)
    links = stars.where("near").select(F.col("hub").alias("u"), F.col("node").alias("v"))
    first = connected_components(links, "lines-dense")
    pairs = open_pairs(stars.select("hub", "node", "near", "size", "more", "less"), first)
    more = materialize(verified(pairs, texts, shingles, THRESHOLD), "lines-more")
    release(spark)
    united = connected_components(links.union(more), "lines-links")
    found = materialize(united.join(texts.select("node", "digest"), "node").select(F.col("digest").alias("node"), "component"), "lines-components")
    discard(texts, stars, pairs, more, first, united)
    return found, finds


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", drop_emptied: bool = False) -> DataFrame:
    """The documents with one line kept of each component of near-duplicate lines, all columns in place.

    Lines (parted by line feeds) are compared in lower case with runs of white space as one blank, and
    link at a Jaccard similarity of 0.8 or more of their character 5-shingles. The line that stays is the first by document
    id, then by place; all others go. Blank lines stay. Null and empty texts stay as they are. Rows
    that repeat id and text count as one document and are all returned alike; a null id comes first.
    With ``drop_emptied`` documents go that lost all their lines. Adds no column.
    """
    found = deduplicated(docs, id_col, text_col)
    if drop_emptied:
        found = found.where((F.col("lines_dropped") == 0) | F.col(text_col).rlike(r"\S"))
    return found.drop("lines_dropped")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As dedup_lines, with the number of lines_dropped added (a column of that name is replaced)."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc"), F.xxhash64(F.col(text_col)).alias("version"), F.col(text_col).alias("text"))
    components, finds = line_components(rows)
    occurrences = finds.select(F.col("digest").alias("node"), "doc", "version", "pos")
    kept = occurrences.groupBy("node").agg(F.min(F.struct("doc", "version", "pos")).alias("first"), F.count("*").alias("n"))
    named = materialize(kept.join(components, "node", "left").where("n > 1 or component is not null"), "lines-named")
    alike = named.where("component is not null")
    firsts = alike.groupBy("component").agg(F.min("first").alias("keep"))
    losers = alike.join(firsts, "component").select("node", "keep").union(named.where("component is null").select("node", "first"))
    gone = occurrences.join(losers, "node").where(~F.struct("doc", "version", "pos").eqNullSafe(F.col("keep")))
    gone = materialize(gone.groupBy("doc", "version").agg(F.collect_set("pos").alias("gone_lines")), "lines-gone")
    release(docs.sparkSession)
    discard(components, finds, named)

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, dropped = [], []
            for text, lost in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if lost:
                    lost = set(lost)
                    text = "\n".join([line for i, line in enumerate(text.split("\n")) if i not in lost])
                texts.append(text)
                dropped.append(len(lost or ()))
            yield table({"row": b.column(0), "text": pa.array(texts, pa.string()), "lines_dropped": pa.array(dropped, pa.int64())})

    columns = [c for c in docs.columns if c != "lines_dropped"]
    base = docs.select(F.struct(*[c for c in columns if c != text_col]).alias("row"), F.col(id_col).alias("own_id"), F.xxhash64(F.col(text_col)).alias("own_version"), F.col(text_col).alias("text"))
    joined = base.join(gone.hint("shuffle_hash"), base["own_id"].eqNullSafe(gone["doc"]) & (base["own_version"] == gone["version"]), "left")
    packed = joined.select("row", "text", "gone_lines")
    made = packed.mapInArrow(rebuild, f"row {dict(packed.dtypes)['row']}, text string, lines_dropped long")
    return made.select(*[F.col("text").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in columns], "lines_dropped")

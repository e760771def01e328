"""SimHash near-duplicates by the generalised pigeonhole principle."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache, reduce
from itertools import combinations
from math import ceil, comb, log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import discard, materialize, release, small_batches, table, utf8
from docloom.llm.components import connected_components
from docloom.llm.verify import verified

BITS = 64
SEED = 42
#: Shuffling and sorting one probe costs about as much as verifying so many candidates: some 2.5 microseconds and 5 nanoseconds.
PROBE_COST = 500
#: Probes that are exchanged at once, about, or else so many times the rows that they look through.
PROBES, PROBES_SHARE = 1 << 27, 4
#: Bits of a key: the place in its group, the group and, from here on, the class of sizes.
CLASS_BITS = 44
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def simhash(text: str | None, width: int = 4) -> int:
    """64-bit fingerprint of word shingles (repeats included); 0 for a text without words."""
    words = utf8(text).lower().split()
    if not words:
        return 0
    flat = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    ends = ends.tolist()[width - 1 :] or [len(flat)]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(flat[i:j], SEED) for i, j in zip(starts, ends, strict=False)], dtype=np.uint64)
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    """The 64 bits that are set in over half the hashes."""
    octets = hashes.view(np.uint8).reshape(-1, 8)
    if len(hashes) < 256:
        counts = np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    else:
        counts = np.concatenate([np.bincount(octets[:, k], minlength=256) @ _BYTE_BITS for k in range(8)])
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """(id, fp bigint) of every row, by one scan of the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([simhash(t, width) for t in b.column(1).to_pylist()], dtype=np.uint64)
            yield table({"id": b.column(0), "fp": pa.array(fps.view(np.int64))})

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, fp long")


def bit_groups(distinct: DataFrame, parts: int) -> list[list[int]]:
    """Deal the 64 bits to ``parts`` groups so that correlated bits share a group."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BITS + 1, BITS + 1))
        for b in batches:
            x = np.ones((b.num_rows, BITS + 1), dtype=np.float64)
            x[:, :BITS] = np.unpackbits(b.column(0).to_numpy().view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            total += x.T @ x
        yield table({"k": pa.array(np.arange(total.size)), "v": pa.array(total.ravel())})

    sums = np.zeros((BITS + 1) ** 2)
    for k, v in distinct.select("fp").mapInArrow(moments, "k long, v double").groupBy("k").agg(F.sum("v")).collect():
        sums[k] = v
    m = sums.reshape(BITS + 1, BITS + 1)
    n = max(m[BITS, BITS], 1.0)
    mean = m[BITS, :BITS] / n
    cov = m[:BITS, :BITS] / n - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    corr = np.abs(cov / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    left, groups = list(range(BITS)), []
    for i in range(parts):
        size = len(left) // (parts - i)
        group = [max(left, key=lambda b: (corr[b, left].sum(), -b))]
        while len(group) < size:
            group.append(max((b for b in left if b not in group), key=lambda b: (corr[b, group].sum(), -b)))
        left = [b for b in left if b not in group]
        groups.append(sorted(group))
    return groups


def probes_of(parts: int, limit: int) -> int:
    """The probes of a fingerprint whose thresholds are shared out evenly over the groups."""
    share = [(limit + 1 + i) // parts - 1 for i in range(parts)]
    return sum(sum(comb(BITS // parts, d) for d in range(t + 1)) for t in share)


def choose_parts(n: int, limit: int) -> int:
    """The number of groups with the least probing plus verifying for n evenly spread fingerprints."""
    return min(range(2, max(4, (limit + 1) // 2) + 1), key=lambda parts: probes_of(parts, limit) * (PROBE_COST + n / 2 ** (BITS // parts)))


def slices_of(n: int, parts: int, limit: int, rows: int) -> int:
    """In how many turns the probes of n nodes are exchanged, each of which exchanges ``rows`` rows to look through as well."""
    return max(1, ceil(n * probes_of(parts, limit) / max(PROBES, PROBES_SHARE * rows)))


def size_class(size: Column, similarity: float) -> Column:
    """Classes of set sizes; sets of a Jaccard similarity of ``similarity`` or more lie in one class or in neighbouring ones.

    Their sizes have at least that ratio, and a class is a little wider, so that rounding does no harm.
    """
    return F.floor(F.log(F.greatest(size, F.lit(1)).cast("double")) / log(1 / (min(similarity, 0.95) - 1e-6))).cast("long")


def take_bits(fps: np.ndarray, bits: list[int]) -> np.ndarray:
    u = fps.view(np.uint64)
    out = np.zeros(len(u), dtype=np.int64)
    for j, b in enumerate(bits):
        out |= ((u >> np.uint64(b)) & np.uint64(1)).astype(np.int64) << j
    return out


def spheres(histogram: np.ndarray, width: int, limit: int) -> np.ndarray:
    """[d, x]: how many fingerprints have a key at distance d from x, for d up to limit."""
    out = np.zeros((limit + 1, len(histogram)))
    out[0] = histogram
    keys = np.arange(len(histogram))
    for b in range(width):
        flipped = out[:, keys ^ (1 << b)]
        out[1:] += flipped[:-1]
    return out


class Allocation:
    """Candidate estimates and the dynamic programme that gives each query its thresholds."""

    def __init__(self, distinct: DataFrame, groups: list[list[int]], n: int, limit: int):
        """n is the number of nodes, all of which a probe may meet unless ``thresholds`` is told better."""
        self.groups, self.n, self.limit = groups, n, limit
        # keys of over 16 bits are estimated from halves, taken as independent
        self.halves = [[g] if len(g) <= 16 else [g[: len(g) // 2], g[len(g) // 2 :]] for g in groups]
        flat = [h for hs in self.halves for h in hs]

        def histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                fps = b.column(0).to_numpy()
                for i, h in enumerate(flat):
                    k, c = np.unique(take_bits(fps, h), return_counts=True)
                    yield table({"h": pa.array(np.full(len(k), i)), "k": pa.array(k), "c": pa.array(c.astype(np.int64))})

        tables = [np.zeros(1 << len(h)) for h in flat]
        counted = distinct.select("fp").mapInArrow(histogram, "h long, k long, c long").groupBy("h", "k").agg(F.sum("c").alias("c"))
        for h, rows in counted.toPandas().groupby("h"):  # at most 2^16 rows for each of 4 tables
            tables[h][rows["k"].to_numpy()] = rows["c"].to_numpy()
        shares = iter([(spheres(t, len(h), limit) / max(n, 1)).astype(np.float32) for t, h in zip(tables, flat, strict=True)])
        self.shares = [[next(shares) for _ in hs] for hs in self.halves]

    def thresholds(self, fps: np.ndarray, met: np.ndarray | None = None) -> np.ndarray:
        """For each fingerprint and group the threshold, -1 to leave a group out; they add up to limit + 1 - groups.

        met: for each fingerprint the number of nodes among which it is looked for.
        """
        units, size = self.limit + 1, len(fps)
        best, choice = np.full((units + 1, size), np.inf), []
        best[0] = 0
        for g, hs, shares in zip(self.groups, self.halves, self.shares, strict=True):
            near = shares[0][:, take_bits(fps, hs[0])]
            if len(hs) > 1:
                other = shares[1][:, take_bits(fps, hs[1])]
                near = np.stack([sum(near[d] * other[e - d] for d in range(e + 1)) for e in range(units)])
            found = np.cumsum(near, axis=0) * (self.n if met is None else met)
            keys = np.cumsum([comb(len(g), d) for d in range(units)])
            cost = np.concatenate([np.zeros((1, size)), found + PROBE_COST * keys[:, None]])
            step, pick = np.full((units + 1, size), np.inf), np.zeros((units + 1, size), dtype=np.int8)
            for s in range(units + 1):
                for t in range(s + 1):
                    new = best[s - t] + cost[t]
                    better = new < step[s]
                    step[s][better], pick[s][better] = new[better], t
            best = step
            choice.append(pick)
        out, s, at = np.zeros((len(self.groups), size), dtype=np.int64), np.full(size, units), np.arange(size)
        for i in range(len(self.groups) - 1, -1, -1):
            out[i] = choice[i][s, at]
            s = s - out[i]
        return out - 1


@lru_cache
def flips(width: int, distance: int) -> np.ndarray:
    """All keys with ``distance`` of ``width`` bits set."""
    return np.array([sum(1 << b for b in c) for c in combinations(range(width), distance)], dtype=np.int64)


def near_components(nodes: DataFrame, limit: int = 4, check: Callable[[DataFrame], DataFrame] | None = None, label: str = "simhash") -> DataFrame:
    """(node, root) of every row of nodes (node, fp); root is the smallest node that links of at most ``limit`` bits reach.

    1. Bits are grouped by correlation, and keys of all groups are counted.
    2. Nodes with equal keys are compared with the smallest of their bucket, which folds dense
       groups of near copies into components at a cost linear in their size.
    3. Every node probes the keys within its own thresholds, and candidates of other components
       are verified on the whole 64 bits inside an equi-join, whose hot keys Spark splits.
       Nodes take turns, so that about ``PROBES`` probes are exchanged at once, however many there are.
    No pair within the limit is missed: its larger node probes, and by the generalised
    pigeonhole principle at least one group lies within its threshold. Nodes are distinct and may share a fingerprint.
    ``check`` may take candidate pairs (u, v) and return those that are links; without it all are. A column
    root of ``nodes`` tells what is known to be linked already. With a column class (whole numbers from 0) only pairs of one class
    or of neighbouring ones are links: a bucket then holds the nodes of a class and of the one below, in which
    those of the class probe, so a node meets no others.
    """
    spark = nodes.sparkSession
    classed = "class" in nodes.columns
    known = nodes.select("node", "fp", "root" if "root" in nodes.columns else F.col("node").alias("root"), (F.col("class") if classed else F.lit(0)).cast("long").alias("class"))
    sizes = {r["class"]: r["count"] for r in known.groupBy("class").count().collect()}  # a row for each class
    n = sum(sizes.values())
    met = np.array([sizes.get(c, 0) + sizes.get(c - 1, 0) for c in range(max(sizes, default=0) + 1)])
    parts = choose_parts(sum(k * int(met[c]) for c, k in sizes.items()) // max(n, 1), limit)
    groups = bit_groups(nodes, parts)
    plan = spark.sparkContext.broadcast(Allocation(nodes, groups, n, limit).__dict__ | {"met": met})  # at most 4 tables of 2^16 x 5 floats

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps, own = b.column(1).to_numpy(), b.column(3).to_numpy()
            for i, g in enumerate(groups):
                for up in (0, 1) if classed else (0,):
                    key = take_bits(fps, g) | (i << 40) | (own + up << CLASS_BITS)
                    yield table({"key": pa.array(key), "x": b.column(0), "x_fp": b.column(1), "x_root": b.column(2), "below": pa.array(np.full(len(fps), up == 1))})

    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        allocation = Allocation.__new__(Allocation)
        allocation.__dict__.update(plan.value)
        for b in batches:
            fps, own = b.column(1).to_numpy(), b.column(3).to_numpy()
            taken = allocation.thresholds(fps, allocation.met[own])
            for i, g in enumerate(groups):
                keys = take_bits(fps, g) | (own << CLASS_BITS)
                for d in range(limit + 1):
                    use = np.flatnonzero(taken[i] >= d)
                    if len(use):
                        m = flips(len(g), d)
                        for lo in range(0, len(m), 64):
                            part = m[lo : lo + 64]
                            probe = (keys[use][:, None] ^ part[None, :]) | (i << 40)
                            at = pa.array(np.repeat(use, len(part)))
                            yield table({"key": pa.array(probe.ravel()), "q": b.column(0).take(at), "q_fp": b.column(1).take(at), "q_root": b.column(2).take(at)})

    columns = "key long, {0} long, {0}_fp long, {0}_root long"
    looked_through = columns.format("x") + ", below boolean"
    near = lambda a, b: F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= limit
    index = known.mapInArrow(keyed, looked_through)
    pivots = index.groupBy("key").agg(F.min(F.struct("x", "x_fp", "x_root")).alias("pivot"))
    close = index.join(pivots, "key").where((F.col("x_root") != F.col("pivot.x_root")) & near("x_fp", "pivot.x_fp")).select(F.col("x").alias("u"), F.col("pivot.x").alias("v"))
    close = check(close) if check else close
    first = connected_components(close.union(known.where("node <> root").select("node", "root")), f"{label}-dense")
    rooted = known.select("node", "fp", "class").join(first, "node", "left")
    rooted = materialize(rooted.select("node", "fp", F.coalesce("component", "node").alias("root"), "class"), f"{label}-rooted")
    turns = slices_of(n, parts, limit, n * parts * (1 + classed))

    def found(turn: int) -> DataFrame:
        mine = rooted.where(F.pmod(F.xxhash64("node"), F.lit(turns)) == turn) if turns > 1 else rooted
        pairs = mine.mapInArrow(probes, columns.format("q")).join(rooted.mapInArrow(keyed, looked_through), "key")
        pairs = pairs.where((F.col("below") | (F.col("q") > F.col("x"))) & (F.col("q_root") != F.col("x_root")) & near("q_fp", "x_fp"))
        return pairs.select(F.col("q").alias("u"), F.col("x").alias("v")) if check else pairs.select("q_root", "x_root")

    written = []
    if turns > 1:
        for turn in range(turns):
            written.append(materialize(found(turn).distinct(), f"{label}-found"))
            release(spark)
    pairs = reduce(DataFrame.union, written) if written else found(0)
    if check:
        links = check(pairs)
        second = connected_components(links.union(rooted.where("node <> root").select("node", "root")), f"{label}-links")
        discard(*written)
        return rooted.select("node").join(second, "node", "left").select("node", F.coalesce("component", "node").alias("root"))
    second = connected_components(pairs, f"{label}-links")
    discard(*written)
    joined = rooted.join(second.withColumnRenamed("node", "root"), "root", "left")
    return joined.select("node", F.coalesce("component", "root").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, limit: int = 4) -> DataFrame:
    """(id, fp, component_id) of every row: texts whose fingerprints differ in at most ``limit`` bits link.

    component_id is the smallest id that links reach. Null and wordless texts have fingerprint 0 and
    link like any other. Equal ids and repeated rows are kept. A null id is kept and never names a
    component unless all ids of it are null. An empty table gives an empty result. Other columns are
    not read.
    """
    small_batches(docs.sparkSession)
    rows = materialize(fingerprints(docs, id_col, text_col, width), "simhash-fingerprints")
    classes = materialize(rows.groupBy("fp").agg(F.min("id").alias("least")), "simhash-classes")
    roots = near_components(classes.select(F.col("fp").alias("node"), "fp"), limit).withColumnRenamed("node", "fp")
    roots = materialize(roots, "simhash-roots").join(classes, "fp")
    named = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(roots.select("fp", "root").join(named, "root").select("fp", "component_id"), "fp").select("id", "fp", "component_id")


def word_shingles(text: str | None, width: int = 5) -> set[bytes]:
    """Distinct word shingles in lower case (A-Z); a shorter text is one shingle, a wordless one has none."""
    words = utf8(text).lower().split()
    return {b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def set_prints(text: str | None, width: int = 5) -> tuple[int, int, int]:
    """(fingerprint, second fingerprint, number) of the distinct word shingles; all zero without words.

    Repeats do not count here, so that distances follow the Jaccard similarity of the shingle sets and
    one frequent shingle doesn't decide the fingerprint.
    """
    made = word_shingles(text, width)
    if not made:
        return 0, 0, 0
    first = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in made), dtype=np.uint64, count=len(made))
    second = first * np.uint64(0x9E3779B97F4A7C15)
    second = (second ^ (second >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return majority(first), majority(second ^ (second >> np.uint64(32))), len(made)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, limit: int = 13, similarity: float = 0.8) -> DataFrame:
    """The row with the smallest id of each group of near duplicates, with all its columns.

    Texts link at a Jaccard similarity of ``similarity`` or more of their word shingles; groups are what
    links reach. Two fingerprints of the distinct shingles are searched one after the other, and texts at most
    ``limit`` bits apart in one of them make candidates: of pairs at exactly 0.8 that is 99 in 100, at 0.85 nearly all.
    Sets that similar have sizes in a ratio of ``similarity`` at least, so fingerprints meet within a class of sizes or its neighbour only.
    Candidates that two looser bounds rule out, on the numbers of shingles and on the other
    fingerprint, are not fetched; the others are compared on their shingles. Every distinct
    text is a node of its own, so texts that share a fingerprint without being alike are judged like any others.

    Null and wordless texts count as equal. Of rows alike in id and text one stays. Rows with a null id
    are all kept and take no part, as nothing tells them apart.
    """
    small_batches(docs.sparkSession)
    version = F.xxhash64(F.col(text_col))
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(2).to_pylist()
            prints = [set_prints(t, width) for t in texts]
            fp, fp2 = (pa.array(np.array([p[i] for p in prints], dtype=np.uint64).view(np.int64)) for i in (0, 1))
            words = [xxhash.xxh64_intdigest(b" ".join(utf8(t).lower().split())) for t in texts]
            yield table({"id": b.column(0), "version": b.column(1), "fp": fp, "fp2": fp2, "n": pa.array([p[2] for p in prints], pa.int64()), "words": pa.array(np.array(words, dtype=np.uint64).view(np.int64))})

    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), version.alias("version"), F.col(text_col).alias("text"))
    signed = materialize(rows.mapInArrow(run, f"id {kind}, version long, fp long, fp2 long, n long, words long"), "keep-signed")
    # exact copies by words first: one node for all of them
    texts = signed.groupBy("fp", "fp2", "n", "words").agg(F.min(F.struct("id", "version")).alias("least"))
    texts = materialize(texts.select(F.monotonically_increasing_id().alias("node"), "*", size_class(F.col("n"), similarity).alias("class")), "keep-texts")
    sides = [texts.select(F.col("node").alias(c), F.col("fp").alias(f"{c}_fp"), F.col("fp2").alias(f"{c}_fp2"), F.col("n").alias(f"{c}_n")) for c in "uv"]
    bits = lambda c: F.bit_count(F.col(f"u_{c}").bitwiseXOR(F.col(f"v_{c}")))

    def check(pairs: DataFrame) -> DataFrame:
        both = pairs.distinct().join(sides[0], "u").join(sides[1], "v")
        sized = F.least("u_n", "v_n") >= similarity * F.greatest("u_n", "v_n") - 1e-9
        # by chance a pair at 0.8 lies further apart than this once in 10,000 times
        near = F.greatest(bits("fp"), bits("fp2")) <= limit + 7
        both = materialize(both.where(sized & near).select("u", "v"), "keep-candidates")
        wanted = both.select(F.col("u").alias("node")).union(both.select("v")).distinct().join(texts, "node")
        wanted = wanted.select("node", "least.id", "least.version")
        known = rows.join(wanted, ["id", "version"]).groupBy("node").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
        known = materialize(known, "keep-fetched")
        links = materialize(verified(both, known, lambda t: word_shingles(t, width), similarity), "keep-verified")
        discard(both, known)
        return links

    roots = materialize(near_components(texts.select("node", "fp", "class"), limit, check, "keep-one"), "keep-roots-one")
    release(docs.sparkSession)
    known = texts.select("node", F.col("fp2").alias("fp"), "class").join(roots, "node")
    both, roots = roots, materialize(near_components(known, limit, check, "keep-two"), "keep-roots")
    discard(both)
    release(docs.sparkSession)
    grouped = texts.join(roots, "node").select("root", "fp", "fp2", "n", "words", "least")
    grouped = grouped.join(grouped.groupBy("root").agg(F.min("least").alias("first")), "root").drop("root", "least")
    copies = signed.groupBy("id", "version", "fp", "fp2", "n", "words").agg(F.count("*").alias("rows"))
    judged = copies.join(grouped, ["fp", "fp2", "n", "words"]).withColumn("stays", F.struct("id", "version") == F.col("first"))
    apart = materialize(judged.where("NOT stays OR rows > 1").select("id", "version", "stays"), "keep-apart")
    discard(signed, texts, roots)
    # only the rows that go, and those that stand more than once, are looked for among the documents
    based = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("id"), version.alias("version"))
    lone = based.join(apart.select("id", "version"), ["id", "version"], "left_anti").select("row.*")
    often = apart.where("stays").select("id", "version")
    if often.isEmpty():
        return lone
    repeated = based.join(often, ["id", "version"], "left_semi")
    return lone.union(repeated.dropDuplicates(["id", "version"]).select("row.*"))

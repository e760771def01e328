"""Importance resampling, sharding and the divergence audit against plain versions and at the edges."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docloom.llm import divergence, importance, sharding
from docloom.llm.decontaminate import words

LONG = "the Quick brown fox, jumps over the lazy dog. " * 3_000
ROWS = [
    (1, "some words in a first text that stands here", "en", "a"), (1, "some words in a first text that stands here", "en", "a"), (2, None, "en", "a"), (3, "", "de", None),
    (None, "quelques mots dans un texte à lire", "fr", "b"), (None, None, None, None), (4, LONG, "en", "b"), (5, "漢" * 40_000, None, "b"), (6, "\n \t\n", "de", "a"), (7, "einige Wörter im Text", "de", ""), (8, "x" * 300 + " y", "de", "c"),
]
SCHEMA = "doc_id long, text string, lang string, source string"
CLASHING = ["id", "row", "n", "docs", "term", "place", "part", "at", "shift", "size", "shard", "virtual_slot", "version", "p", "q", "value", "rank", "item", "score", "weight", "crcs", "sizes", "n_words"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).select("*", *[F.lit(f"other {c}").alias(c) for c in CLASHING])


def random_texts(n, seed=1, letters="abcXYZ 0-9é漢.\n "):
    rng = random.Random(seed)
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(400))) for _ in range(n)]


def scanned_batch(texts):
    both = [importance.prefixes(t) for t in texts]
    sizes = [(s.astype(np.uint8) if s.max(initial=0) < 256 else s).tobytes() for _, s in both]
    columns = [pa.array([0] * len(texts)), pa.array([len(c) for c, _ in both], pa.int64()), pa.array([c.tobytes() for c, _ in both], pa.binary()), pa.array(sizes, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["id", "n_words", "crcs", "sizes"])


@pytest.mark.parametrize(("piece", "block"), [(1 << 20, 1 << 17), (10, 50), (40, 7), (5, 1)])
def test_crc_of_every_run(monkeypatch, piece, block):
    monkeypatch.setattr(importance, "PIECE_BYTES", piece)
    monkeypatch.setattr(importance, "BLOCK_WORDS", block)
    texts = [None, "", "a", "A b", "x " * 3, "q" * 70_000 + " z " + "r" * 300 + " " + "é" * 999, *random_texts(60)]
    got = [[] for _ in texts]
    for owner, found in importance.runs(scanned_batch(texts), 4, 10_000):
        for o, b in zip(owner, found, strict=True):
            got[o].append(int(b))
    for t, g in zip(texts, got, strict=True):
        w = words(t)
        assert sorted(g) == sorted(zlib.crc32(b" ".join(w[i : i + n])) % 10_000 for n in range(1, 5) for i in range(len(w) - n + 1))


def test_shifts_are_those_of_zero_bytes():
    rng = random.Random(2)
    for n in (0, 1, 2, 255, 256, 257, 511, 512, 70_000, 1_000_003):
        head, tail = rng.randbytes(9), bytes(n)
        crc = importance.shifted(np.array([zlib.crc32(head)], np.uint32), np.array([n]))[0]
        assert int(crc) ^ zlib.crc32(tail) == zlib.crc32(head + tail)


def features(text):
    w = words(text)
    return [zlib.crc32(b" ".join(w[i : i + n])) % 10_000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def plain_draw(rows, items, share, least):
    s, t = Counter(f for _, x in rows for f in features(x)), Counter(f for x in items for f in features(x))
    all_s, all_t = s.total(), t.total()
    gain = [math.floor(1000 * math.log(float(t[b] + 1) * float(all_s + 10_000) / (float(s[b] + 1) * float(all_t + 10_000)))) for b in range(10_000)]
    out = []
    for i, x in rows:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[f] for f in features(x))
        out.append((i, len(words(x)), len(features(x)), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    order = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    return out, order[: share * len(order) // 100]


def test_resampling_equals_a_plain_version(spark, docs):
    items = ["the lazy dog jumps", None, "", "quick brown mots"]
    target = spark.createDataFrame([(x,) for x in items], "text string")
    got = importance.resample(docs, target, share=50, least_words=4).collect()
    want, order = plain_draw([(r[0], r[1]) for r in ROWS], items, 50, 4)
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(((r.id, r.n_words, r.n_features, r.weight, r.score) for r in got), key=key) == sorted(want, key=key)
    drawn = sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])
    assert [r["rank"] for r in drawn] == list(range(1, len(order) + 1))
    assert [(r.id, r.score) for r in drawn] == [(r[0], r[4]) for r in order]
    kept = importance.drawn(docs, target, share=50, least_words=4)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r[0] for r in order}
    assert importance.resample(docs.limit(0), target).count() == 0
    unlike = importance.resample(docs, target.limit(0), least_words=4).collect()
    assert len(unlike) == len(ROWS)


def test_numbering_spreads_ties(spark):
    from docloom.llm.common import numbered

    rows = spark.range(0, 5_000, 1, 7).select((F.col("id") % 3).cast("int").alias("k"), F.lit(1).alias("same"), "id")
    got = numbered(rows, [F.col("same")], "places", ("k",)).select("k", "place").collect()
    for k in range(3):
        assert sorted(r.place for r in got if r.k == k) == list(range(sum(r.k == k for r in got)))
    assert sorted(r.place for r in numbered(rows, [F.col("id").desc()], "all").collect()) == list(range(5_000))


def test_rebalancing_edits_and_growth_only_gives_to_the_new_shard():
    rng = random.Random(4)
    weights = [rng.choice([0, rng.randrange(1, 100), rng.randrange(1, 2_000)]) for _ in range(4_096)]
    first = sharding.even(4_096, 24)
    second = sharding.rebalanced(first, weights, 24)
    loads = lambda m, n: [sum(w for w, s in zip(weights, m, strict=True) if s == x) for x in range(n)]
    assert max(loads(second, 24)) - min(loads(second, 24)) < 10  # of 59,821 each; the lightest slots come last
    moved = sum(a != b for a, b in zip(first, second, strict=True))
    assert 0 < moved < 1_000  # an edit, no new map
    assert sharding.rebalanced(second, weights, 24) != [0] * 4_096
    third = sharding.grown(second, weights, 24)
    assert all(b in (a, 24) for a, b in zip(second, third, strict=True))
    spread = loads(third, 25)
    assert abs(spread[24] - sum(weights) / 25) < 2_000
    assert max(spread[:24]) - min(spread[:24]) < 4_000
    assert sharding.rebalanced(first, [0] * 4_096, 24) == first


def test_shards_at_the_edges(spark, docs, tmp_path):
    path = f"file://{tmp_path}/map"
    got = sharding.assign(docs, shards=3, slots=64, path=path).collect()
    assert sorted((repr(r.id), r.size, r.text_crc32) for r in got) == sorted((repr(i), len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, _, _ in ROWS)
    for shard in {r.shard for r in got}:
        assert sorted(r.place for r in got if r.shard == shard) == list(range(sum(r.shard == shard for r in got)))
    first, second = (r for r in got if r.id == 1)
    assert first.shard == second.shard
    assert sharding.assign(docs.limit(0), shards=3, slots=64).count() == 0
    assert {r.map_version for r in got} == {1}
    assert {r.map_version for r in sharding.assign(docs, shards=3, slots=64, path=path).collect()} == {2}
    assert [r.version for r in sharding.load_map(spark, path).select("version").distinct().collect()] == [2]
    assert sharding.load_map(spark, path, 0).count() == 64
    newest = sharding.load_map(spark, path, 1)
    sharding.write_shards(docs.drop("shard", "virtual_slot"), newest, f"file://{tmp_path}/out", slots=64, files=2)
    back = spark.read.parquet(f"file://{tmp_path}/out")
    assert sorted((repr(r.doc_id), r.shard) for r in back.collect()) == sorted((repr(r.id), r.shard) for r in got)


def test_a_hot_null_id_is_spread(spark):
    rows = spark.range(3_000).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    sizes = sharding.assign(rows).groupBy("shard").agg(F.sum("size").alias("s")).collect()
    assert len(sizes) == 24 and max(r.s for r in sizes) - min(r.s for r in sizes) <= 20


def plain_audit(rows, least, top):
    rows = [((t or ""), (a or ""), (s or "")) for _, t, a, s in rows]
    terms = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    out = set()
    for lang in {a for _, a, _ in rows}:
        own = [(terms(t), s) for t, a, s in rows if a == lang]
        spread = Counter(w for ws, _ in own for w in set(ws))
        kept = sorted(w for w, n in spread.items() if n >= least)
        n_of = {s: Counter(w for ws, x in own if x == s for w in ws if spread[w] >= least) for _, s in own}
        whole = sum(n_of.values(), Counter())
        p_of = lambda c: {w: 1 + 1_000_000_000 * (c[w] + 5) // (c.total() + 5 * len(kept)) for w in kept}  # noqa: E731,B023
        shares, all_of = {s: p_of(c) for s, c in n_of.items()}, p_of(whole)
        for s, p in shares.items():
            parts = {"pair": [(sum(abs(p[w] - q[w]) for w in kept), o) for o, q in shares.items() if o != s], "term": [(p[w] - all_of[w], w) for w in kept if n_of[s][w] and p[w] > all_of[w]]}
            for part, found in parts.items():
                for rank, (v, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode())), 1):
                    if part == "pair" or rank <= top:
                        out.add((lang, s, part, item, v, rank))
    return out


@pytest.mark.parametrize(("held", "cells"), [(400_000, 1 << 22), (10, 1)])
def test_audit_equals_a_plain_version(spark, docs, monkeypatch, held, cells):
    monkeypatch.setattr(divergence, "HELD_TERMS", held)
    monkeypatch.setattr(divergence, "HELD_CELLS", cells)
    monkeypatch.setattr(divergence, "BLOCK_CELLS", cells if cells == 1 else 1 << 19)
    rng = random.Random(6)
    more = [(100 + i, " ".join(rng.choice(["Alpha", "beta", "gamma3delta", "é", "zeta", "漢字", "eta"]) for _ in range(rng.randrange(12))), rng.choice(["en", "de", "xx", None]), rng.choice(["a", "b", "c", None])) for i in range(120)]
    frame = docs.unionByName(spark.createDataFrame(more, SCHEMA), allowMissingColumns=True)
    got = divergence.audit(frame, least=3, top=2).collect()
    assert len(got) == len(set(map(tuple, got)))
    assert set(map(tuple, got)) == plain_audit(ROWS + more, 3, 2)
    assert divergence.audit(docs.limit(0)).count() == 0

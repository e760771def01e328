"""Mixing, language-model scores, exact search and the pipeline on small cases."""

import glob
import math
import os
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from docloom.llm import maxent_lm as lm
from docloom.llm import mixing, mtree, queries


def cell(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql_twins(spark, sf, name):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    df = queries.QUERIES[name](spark, sf)
    want = con.sql(queries.ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    got = sorted((tuple(cell(r[c]) for c in want.columns) for r in df.collect()), key=repr)
    assert got == sorted((tuple(map(cell, r)) for r in want.fetchall()), key=repr)


def water(sizes, weights, most):
    """Targets by resharing the excess until none is above its cap."""
    target, capped = {}, set()
    while True:
        rest = sum(sizes.values()) - sum(most * sizes[s] for s in capped)
        total = sum(weights[s] for s in sizes if s not in capped)
        target = {s: most * sizes[s] if s in capped else rest * weights[s] / total for s in sizes}
        over = {s for s in sizes if s not in capped and target[s] > most * sizes[s]}
        if not over:
            return target
        capped |= over


def test_targets(spark):
    sizes = {"a": 1000, "b": 10, "c": 20, "d": 3000, None: 5, "e": 0}
    rows = spark.createDataFrame([(k, v) for k, v in sizes.items()], "source string, size long")
    order = sorted([s for s in sizes if s is not None]) + [None]
    want = water(sizes, {s: i % 3 + 1 for i, s in enumerate(order)}, 3)
    got = {r.source: r.target for r in mixing.source_targets(rows).collect()}
    assert got == pytest.approx(want)


def test_mix_edges(spark):
    rows = [(i, "w " * (i % 7), "s1" if i % 3 else None) for i in range(300)] + [(None, "x y", "s2"), (7, None, "s2"), (7, None, "s2"), (8, "a b c", "s2")]
    docs = spark.createDataFrame([(i, t, s, 1) for i, t, s in rows], "doc_id long, text string, source string, copies int")
    mixed = mixing.mix(docs).collect()
    assert len(mixed) == len(rows)
    assert all(0 <= r.copies <= 3 for r in mixed)
    for source in ("s1", None):
        mine = [r for r in mixed if r.source == source]
        assert abs(sum(r["copies"] * r["size"] for r in mine) - mine[0].target) <= 6
    key = lambda rs: sorted(((r.id, r.copies) for r in rs), key=repr)
    assert key(mixing.mix(docs.repartition(5)).collect()) == key(mixed)
    assert mixing.sample(docs).count() == sum(r.copies for r in mixed)
    assert mixing.sample(docs).columns == [*docs.columns, "copy_number"]
    assert mixing.mix(docs.limit(0)).count() == 0


def test_scores(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = lm.score(docs, head_words=200).collect()  # most words go through the join
    counts, ends = Counter(), 0
    for i, t in texts.items():
        if zlib.crc32(str(i).encode()) % 5 != 1:
            counts.update(lm.lower_words(t))
            ends += 1
    n, v = sum(counts.values()) + ends, len(counts) + 1
    for r in got:
        words = lm.lower_words(texts[r.id])
        base = sum(math.log10((c + 0.5) / (n + 0.5 * (v + 1))) for c in [ends, *(counts[w] for w in words)])
        assert r.base_score == pytest.approx(base)
        assert (r.train_tokens, r.n_tokens, r.n_known) == (n, len(words) + 1, 1 + sum(counts[w] > 0 for w in words))
        assert r.held_out == (zlib.crc32(str(r.id).encode()) % 5 == 1)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_model_keeps_its_size():
    rows, classes, _ = lm.encoded([" ".join(f"{i:x}" for i in range(40_000))], lm.Coder())
    assert all(len(np.unique(rows[:, k])) > 8000 for k in range(3))  # of 8192 rows for each feature kind of words
    assert len(np.unique(classes)) > 40  # of 49


def test_class_probabilities_add_up():
    rng = np.random.default_rng(1)
    w = lm.Weights(rng.standard_normal(lm.CLASSES).astype(np.float32), rng.standard_normal((lm.KINDS * lm.BUCKETS, lm.CLASSES)).astype(np.float32))
    rows, _, _ = lm.encoded(["some words of a text"], lm.Coder())
    total = sum(10 ** w.log10(rows, np.full(len(rows), c)) for c in range(lm.CLASSES))
    assert total == pytest.approx(np.ones(len(rows)), rel=1e-4)


def test_words_are_taken_from_a_text_once():
    texts = ["Some words of A text", None, "", "x y x"]
    for got, want in zip(lm.encoded_words([lm.lower_words(t) for t in texts], lm.Coder()), lm.encoded(texts, lm.Coder()), strict=True):
        assert (got == want).all()


def test_sums_of_groups():
    rng = np.random.default_rng(5)
    z, keys = rng.normal(size=(900, 7)).astype(np.float32), rng.geometric(0.02, 900)
    order = np.argsort(keys, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], np.diff(keys[order]) > 0]))
    got = lm.group_sums(z, order, first, np.diff(np.append(first, 900)))
    assert np.allclose(got, np.add.reduceat(z[order], first, axis=0), atol=1e-4)


def test_sums_of_long_and_short_groups_are_added_in_order():
    rng = np.random.default_rng(21)
    keys = np.minimum(rng.geometric(0.02, 3000) - 1, 200).astype(np.uint16)
    z = rng.normal(size=(3000, lm.CLASSES)).astype(np.float32)
    order = np.argsort(keys, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], np.diff(keys[order].astype(int)) > 0]))
    sizes = np.diff(np.append(first, 3000))
    assert sizes.max() > lm.ROUNDS > sizes.min()
    want = np.zeros((len(first), lm.CLASSES), dtype=np.float32)
    for i, (f, n) in enumerate(zip(first, sizes, strict=True)):
        for row in order[f : f + n]:
            want[i] += z[row]
    assert (lm.group_sums(z, order, first, sizes) == want).all()


def test_row_sums_equal_indexing():
    rng = np.random.default_rng(22)
    table = rng.normal(size=(lm.KINDS * lm.BUCKETS + 1, lm.CLASSES)).astype(np.float32)
    rows = rng.integers(0, lm.KINDS * lm.BUCKETS, (50, lm.KINDS))
    assert (lm.row_sums(table, rows) == table[rows[:, 0]] + table[rows[:, 1]] + table[rows[:, 2]] + table[rows[:, 3]]).all()


def test_score_edges(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([None, "", "a b", "a a a", "zz " * 3000, "a b"])] + [(None, "a"), (2, "a b")], "doc_id long, text string")
    got = lm.score(docs).collect()
    assert len(got) == 8
    assert {r.n_tokens for r in got if r.id in (0, 1)} == {1}
    assert all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in got)
    assert lm.score(docs.limit(0)).count() == 0


def test_boundaries_of_very_large_sources(spark):
    rng = np.random.default_rng(12)
    cases = [(int(r), int(u), int(o)) for r in [0, 1, 10**9, 2**40, 2**50 + 12345] for u in [0, 1, 2**32 - 1, 2**32, 3 * 2**32, *rng.integers(0, 3 * 2**32, 5)] for o in [0, 2**32 - 1]]
    frame = spark.createDataFrame(cases, "r long, u long, o long")
    got = frame.select("*", mixing.boundaries(F.col("r"), F.col("u"), F.col("o")).alias("n")).collect()
    assert all(x.n == (x.r * x.u + x.o) >> 32 for x in got)


def brute_top(rows, k):
    x = [(i, [int(c) for c in np.floor(64 * np.asarray(v, dtype=np.float32).astype(np.float64))]) for i, v in rows]
    out = []
    for q, v in sorted({(i, tuple(v)) for i, v in x if i % 20 == 0}):
        best = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in x if i != q and len(w) == len(v))[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return out


def test_search_is_exact_with_ties(spark, monkeypatch):
    monkeypatch.setattr(mtree, "TREE", 100)
    rng = np.random.default_rng(9)
    rows = [(i, (rng.standard_normal(6) * (0.2 + i % 3)).tolist()) for i in range(700)]
    rows += [(i, rows[3][1]) for i in range(700, 1000)]  # one hot vector
    rows += [rows[0], rows[3], rows[3], (1020, [1.0, 2.0]), (1021, [3.0, 1.0])]  # repeated rows are rows of their own
    bad = [(1001, None), (1002, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (1003, [float("nan")] * 6), (1004, [float("inf")] * 6), (None, [0.0] * 6)]
    frame = spark.createDataFrame([*rows, *bad], "vec_id long, embedding array<float>")
    got = sorted(tuple(r) for r in mtree.top_k(frame, F.col("id") % 20 == 0).collect())
    assert got == sorted(brute_top(rows, 20))
    assert mtree.top_k(frame.limit(0), F.col("id") % 20 == 0).count() == 0


def test_search_with_large_components(spark):
    rng = np.random.default_rng(10)
    rows = [(i, (rng.standard_normal(3) * (2e7 if i % 2 else 1.0)).tolist()) for i in range(300)]
    frame = spark.createDataFrame([(i, v, "x", "y") for i, v in rows], "vec_id long, embedding array<float>, id string, v string")
    got = sorted(tuple(r) for r in mtree.top_k(frame, F.col("id") % 20 == 0, k=5).collect())
    assert got == sorted(brute_top(rows, 5))


def test_stored_distances_avoid_computations():
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((20, 8)) * 300
    x = (centres[np.arange(2000) % 20] + rng.standard_normal((2000, 8)) * 3).astype(np.int32).astype(np.float64)
    metric = mtree.Metric(float((x**2).sum(axis=1).max()))
    tree = mtree.build_tree(np.arange(2000), x, metric, 50)
    pages = len(np.frombuffer(tree["begins"], dtype=np.int64))
    assert pages >= 20
    counts = {}
    hits = mtree.search(tree, np.arange(100), x[:100], np.full(100, -np.inf), 5, metric, counts)
    for i, ids, scores in hits:
        full = x @ x[i]
        full[i] = -np.inf
        want = np.lexsort((np.arange(2000), -full))[:5]
        assert sorted(ids) == sorted(want)
        assert sorted(scores) == sorted(full[want])
    assert counts["entries"] < 0.35 * 100 * 2000  # of all products
    floors = np.array([sorted(x @ x[i])[-6] for i in range(100)])
    again = {}
    mtree.search(tree, np.arange(100), x[:100], floors, 5, metric, again)
    assert again["pages"] < 0.9 * 100 * pages  # of all distances to pages
    assert again["entries"] <= counts["entries"]


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, rows, done = docs.columns, docs, {}
    for name, stage in corpus_pipeline.STAGES:
        rows = corpus_pipeline.materialize(stage(spark, rows, sf), name)
        done[name] = rows
        assert rows.columns == (columns if name != "source_mixing" else [*columns, "copy_number"])
        assert rows.count() > 0
    ids = lambda d: {r.doc_id for r in d.select("doc_id").collect()}
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert all(ids(done[b]) <= ids(done[a]) for a, b in zip(names, names[1:], strict=False))
    whole = corpus_pipeline.run(spark, sf)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, rows.collect()))

"""Vector search against brute force, fusion and budget rules."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.operators import ann, budget, fusion, keyword, postings, rerank, vectors
from docloom.plans import catalogue


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(5)
    x = rng.standard_normal((200, 8))
    x[17] = x[3]
    x[40] = 0
    return x


def frames(spark, x):
    chunks = spark.createDataFrame([(i, i % 3, v.tolist()) for i, v in enumerate(x)], "chunk_id long, document_id int, embedding array<float>")
    return chunks.where("chunk_id % 20 = 3").select(F.col("chunk_id").alias("query_id"), "document_id", F.col("embedding").alias("query_vector")), chunks


@pytest.mark.parametrize("block", [3, 4096])
def test_knn_is_exact(spark, data, block):
    q, c = frames(spark, data)
    got = {(r.query_id, r.rank): r.chunk_id for r in vectors.knn(q, c, 5, block=block).collect()}
    x = data.astype(np.float32).astype(np.float64)
    n = np.maximum(np.linalg.norm(x, axis=1), 1e-300)
    for i in range(3, 200, 20):
        mine = [j for j in range(200) if j % 3 == i % 3]
        s = {j: round(float(x[i] @ x[j] / n[i] / n[j]), 9) for j in mine}
        best = sorted(mine, key=lambda j: (-s[j], j))[:5]
        assert [got[i, k + 1] for k in range(5)] == best


def pairs(hits):
    return {(r.query_id, r.chunk_id) for r in hits.collect()}


@pytest.mark.parametrize("block", [4096, 20])
def test_ann_with_all_lists_and_scores_is_exact(spark, data, block):
    q, c = frames(spark, data)
    book = ann.fit(c, lists=6, parts=4, codes=16)
    got = ann.ann(q, c, 5, book=book, probes=6, share=1.0, most=1000, block=block)
    key = lambda rows: sorted((r.query_id, r["rank"], r.chunk_id, r.similarity) for r in rows.collect())
    assert key(got) == key(vectors.knn(q, c, 5))
    assert ann.build_index(c, book).count() == c.count()


def test_ann_on_clusters_reads_few_lists_and_survives_a_large_list(spark, tmp_path):
    rng = np.random.default_rng(9)
    centres = rng.standard_normal((20, 16)) * 3
    x = centres[rng.integers(0, 20, 3000)] + rng.standard_normal((3000, 16))
    x[:900] = x[0]  # one list holds a third of all
    chunks = spark.createDataFrame([(i, 0, v.tolist()) for i, v in enumerate(x)], "chunk_id long, document_id int, embedding array<float>")
    queries = chunks.where("chunk_id >= 900 and chunk_id % 50 = 0").select(F.col("chunk_id").alias("query_id"), "document_id", F.col("embedding").alias("query_vector"))
    book = ann.fit(chunks, lists=24, parts=8)
    for block in (1 << 14, 200):
        near = ann.ann(queries, chunks, 10, book=book, probes=4, block=block)
        exact = pairs(vectors.knn(queries, chunks, 10))
        assert len(exact & pairs(near)) / len(exact) >= 0.9
        assert near.agg(F.max("n_scored")).first()[0] <= 0.2 * len(x)
    ann.save_index(ann.build_index(chunks, book), book, f"file://{tmp_path}/index")
    index, kept = ann.load_index(spark, f"file://{tmp_path}/index")
    assert np.array_equal(kept.codes, book.codes) and np.array_equal(kept.centroids, book.centroids)
    assert pairs(ann.search(queries, index, kept, 10, probes=4)) == pairs(ann.ann(queries, chunks, 10, book=book, probes=4))


def test_ann_edges(spark):
    rows = [(1, 0, [1.0, 0.0]), (2, 0, None), (3, 0, [float("nan"), 1.0]), (4, 0, [0.0, 0.0]), (5, None, [1.0, 0.0]), (6, 0, [1.0, 0.0])]
    chunks = spark.createDataFrame(rows, "chunk_id long, document_id int, embedding array<float>")
    queries = chunks.select(F.col("chunk_id").alias("query_id"), "document_id", F.col("embedding").alias("query_vector"))
    got = sorted((r.query_id, r["rank"], r.chunk_id, r.similarity) for r in ann.ann(queries, chunks, 2).collect())
    assert got == [(1, 1, 1, 1.0), (1, 2, 6, 1.0), (4, 1, 1, 0.0), (4, 2, 4, 0.0), (6, 1, 1, 1.0), (6, 2, 6, 1.0)]
    assert ann.ann(queries, chunks.limit(0), 2).count() == ann.ann(queries.limit(0), chunks, 2).count() == 0


def test_registered_ann(spark, sf):
    exact, near = catalogue.queries()["e02_knn"](spark, sf), catalogue.queries()["e06_ann"](spark, sf)
    assert exact.count() == near.count()
    assert len(pairs(exact) & pairs(near)) / exact.count() >= 0.9


def test_ann_moves_each_vector_once(spark, sf):
    near = catalogue.queries()["e06_ann"](spark, sf)
    plan = near._jdf.queryExecution().executedPlan().toString().split("\n")
    assert sum("Exchange hashpartitioning" in line and "document_id" in line for line in plan) == 2  # chunks and queries
    assert sum("Exchange" in line for line in plan) == 3  # and the merge of hits


def test_one_set_keeps_raw_scores(spark):
    rows = spark.createDataFrame([(1, 0, 7, 1, 0.9), (2, 0, 7, 1, 0.8), (2, 1, 7, 2, 0.1)], "query_id int, set_id int, chunk_id int, rank int, score double")
    got = {r.query_id: r.score for r in fusion.rrf(rows).collect()}
    assert got == {1: 0.9, 2: pytest.approx(1 / 61 + 1 / 62)}


def test_fusion_without_keyword_hits(spark):
    s = spark.createDataFrame([(1, 1, 0.5), (2, 1, 0.5)], "query_id int, chunk_id int, score double")
    k = spark.createDataFrame([(1, 2, 1.0)], "query_id int, chunk_id int, score double")
    got = {(r.query_id, r.chunk_id): r.score for r in fusion.hybrid_fuse(s, k).collect()}
    assert got == {(1, 1): 0.35, (1, 2): 0.3, (2, 1): 0.5}


def test_cover_density():
    assert keyword.cover_density([np.array([1, 5])]) == pytest.approx(0.2)
    assert keyword.cover_density([np.array([0]), np.array([1])]) == pytest.approx(0.1)
    assert keyword.cover_density([np.array([0, 9]), np.array([3])]) == pytest.approx(0.1 / 3 + 0.1 / 6)


def selected(spark, contents, available, truncate=True):
    rows = spark.createDataFrame([(1, i + 1, 1, c, available) for i, c in enumerate(contents)], "query_id int, rank int, page_number int, content string, available long")
    return {r["rank"]: (r["truncated"], r["tokens"]) for r in budget.select_chunks(rows, truncate=truncate).collect()}


def test_budget_edges(spark):
    full = "x" * (400 - len("[Page 1]: "))  # 100 tokens as shown
    assert selected(spark, [full, full, full], 200) == {1: (False, 100), 2: (False, 100)}
    assert selected(spark, [full, full], 149) == {1: (False, 100)}
    assert selected(spark, [full, full], 150) == {1: (False, 100), 2: (True, 32)}
    assert selected(spark, [full], 0) == {}
    assert selected(spark, [full, "y" * 790, "z"], 110, truncate=False) == {1: (False, 100), 3: (False, 2)}


def test_merge_prefers_the_higher_score(spark):
    c = spark.createDataFrame([(1, 1, "Same text ", 0.5)], "query_id int, item_id int, content string, score double")
    s = spark.createDataFrame([(1, 2, "same TEXT", 0.45), (1, 3, "other", 0.1)], "query_id int, item_id int, content string, score double")
    assert [r.item_id for r in fusion.merge_sentences(c, s).orderBy("rank").collect()] == [2, 3]


def keyword_corpus(spark, chunks=400, docs=4, seed=2):
    rng = np.random.default_rng(seed)
    words = np.array(["alpha", "beta", "gamma", "delta", "the", *[f"w{i}" for i in range(200)]])
    weights = np.array([30, 20, 10, 5, 40, *[1] * 200], float)
    rows = [(i, i % docs if i % 7 else 0, " ".join(rng.choice(words, rng.integers(1, 40), p=weights / weights.sum()))) for i in range(chunks)]
    rows += [(chunks, 1, None), (chunks + 1, 1, "")]
    return spark.createDataFrame(rows, "chunk_id long, doc_id long, content string")


def keyword_asked(spark):
    rows = [(1, 0, "alpha beta"), (2, 1, "Gamma the"), (3, 2, "delta w7"), (4, 0, "the of"), (5, 3, ""), (6, None, "alpha"), (7, 99, "alpha"), (8, 0, "alpha beta gamma")]
    return spark.createDataFrame(rows, "query_id long, doc_id long, query string")


@pytest.mark.parametrize(("block", "first"), [(128, 1), (5, 1), (5, 3)])
def test_postings_give_what_a_scan_gives(spark, tmp_path, block, first):
    chunks, asked = keyword_corpus(spark), keyword_asked(spark)
    path = f"file://{tmp_path}/postings"
    postings.save_postings(postings.build_postings(chunks, block=block), path)
    index = postings.open_postings(spark, path)
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(postings.match(asked, index)) == rows(keyword.keyword_match(asked, chunks))
    for k in (1, 3, 500):
        assert rows(postings.top_matches(asked, index, k, first=first)) == rows(keyword.keyword_rank(asked, chunks, k))
        assert rows(postings.top_matches(asked, index, k, density=False, first=first)) == rows(keyword.occurrence_rank(asked, chunks, k))
    assert postings.top_matches(asked.limit(0), index).count() == postings.match(asked, index.limit(0)).count() == 0


def scanned_rows(df):
    """Rows that the scans of a collected frame gave."""
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.finalPhysicalPlan() if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else plan
    leaves, total = plan.collectLeaves(), 0
    for i in range(leaves.size()):
        rows = leaves.apply(i).metrics().get("numOutputRows")
        total += rows.get().value() if rows.isDefined() else 0
    return total


def test_a_search_reads_the_pages_it_asks_for(spark, tmp_path):
    chunks = keyword_corpus(spark, 3_000, docs=60)
    path = f"file://{tmp_path}/postings"
    postings.save_postings(postings.build_postings(chunks), path, page_rows=50)
    index = postings.open_postings(spark, path)
    asked = postings.asked_terms(spark.createDataFrame([(1, 17, "alpha w7"), (2, 40, "beta")], "query_id long, doc_id long, query string"))
    mine = postings.only_asked(index, asked)
    assert {(r.doc_id, r.term) for r in mine.collect()} <= {(d, t) for d in (17, 40) for t in ("alpha", "beta", "w7")}
    assert scanned_rows(mine) < index.count() / 10
    skipped = [b for b in postings.build_postings(chunks, block=5).groupBy("doc_id").agg(F.max("block").alias("b")).collect() if b.b > 0]
    assert skipped  # several blocks of a document occur


def test_an_index_exchanges_chunks_and_not_their_words(spark, tmp_path):
    chunks = keyword_corpus(spark, 2_000, docs=900)
    path = f"file://{tmp_path}/postings"
    plan = postings.build_postings(chunks)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange rangepartitioning") == 1 and "Generate" not in plan
    postings.save_postings(postings.build_postings(chunks), path)
    index = postings.open_postings(spark, path)
    # more documents than go into the scan as filters
    asked = chunks.select("doc_id").distinct().where("doc_id IS NOT NULL AND doc_id < 300").select(F.col("doc_id").alias("query_id"), "doc_id", F.lit("alpha beta").alias("query"))
    assert asked.count() > postings.PUSHED
    rows = lambda df: sorted(map(tuple, df.collect()))
    want = rows(keyword.keyword_match(asked, chunks))
    assert want and rows(postings.match(asked, index)) == want
    # the rest of the index is read, but neither exchanged nor sorted
    plan = postings.only_asked(index, postings.asked_terms(asked))._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi, BuildRight" in plan and "SortMergeJoin" not in plan
    assert rows(postings.top_matches(asked, index, 3)) == rows(keyword.keyword_rank(asked, chunks, 3))


def plain_interaction(query, text):
    import re
    import zlib

    def vector(w):
        out = {}
        for i in range(len(w)):
            place = zlib.crc32(f"^{w}$"[i : i + 3].encode()) % 256
            out[place] = out.get(place, 0) + 1
        return out

    words = lambda t: list(dict.fromkeys(re.findall(r"\w+", (t or "").lower())))
    cos = lambda a, b: sum(n * b.get(p, 0) for p, n in a.items()) / (sum(n * n for n in a.values()) * sum(n * n for n in b.values())) ** 0.5
    q, t = [vector(w) for w in words(query)], [vector(w) for w in words(text)]
    return round(sum(max(cos(a, b) for b in t) for a in q) / len(q), 9) if q and t else 0.0


def test_reranking_by_texts(spark):
    rows = [(1, 1, "solar panel", "Panels of solar cells"), (1, 2, "solar panel", "wind"), (1, 3, "solar panel", None), (1, 4, "solar panel", "wind"), (2, 5, None, "wind"), (2, 6, "", "x"), (3, 7, "Éa éa", "éa")]
    frame = spark.createDataFrame(rows, "query_id int, chunk_id int, query string, content string").withColumn("similarity", F.lit(0.5))
    got = {(r.query_id, r.chunk_id): (r.similarity, r["rank"], r.original_similarity) for r in rerank.rerank_texts(frame).collect()}
    assert {k: v[0] for k, v in got.items()} == {(q, c): pytest.approx(plain_interaction(a, b), abs=1e-9) for q, c, a, b in rows}
    assert [got[1, c][1] for c in (1, 2, 3, 4)] == [1, 2, 3, 4] and got[1, 1][2] == 0.5
    assert rerank.rerank_texts(frame, 1).count() == 3
    assert rerank.rerank_texts(frame.limit(0)).count() == 0


def test_a_pair_model_is_made_once_for_a_task_and_asked_in_batches():
    import pandas as pd

    made, asked = [], []

    def make():
        made.append(1)
        return lambda q, t: asked.append(len(q)) or np.array([len(x) for x in t], float)

    score = rerank.pair_scorer(make, batch=2).func
    out = list(score(iter([(pd.Series(["a"] * 3), pd.Series(["x", None, "xyz"])), (pd.Series(["a"]), pd.Series(["xx"]))])))
    assert [s.tolist() for s in out] == [[1.0, 0.0, 3.0], [2.0]]
    assert (made, asked) == ([1], [2, 1, 1])


def test_compression_takes_text_scores(spark):
    rows = [(1, i, "solar panel", t) for i, t in enumerate(["Solar panels work.", "Cats sleep.", "A panel is flat.", "Rain falls.", "Solar power."])]
    frame = spark.createDataFrame(rows, "chunk_id int, sentence_index int, query string, content string")
    (got,) = budget.compress_chunks(rerank.sentence_scores(frame)).collect()
    assert got.content == "Solar panels work. A panel is flat. Solar power." and got.sentences_total == 5

"""The pipeline against a plain version of each stage, and on rows at the edges."""

import zlib

import duckdb
import numpy as np
from test_near_duplicates import brute_lines, components

import corpus_pipeline
from docloom.llm import decontaminate as dc
from docloom.llm import hd_langid as hd
from docloom.llm import queries
from docloom.llm import simhash as sh
from docloom.llm.verify import jaccard


def languages(rows):
    by = {}
    for r in rows:
        if r["lang"] is not None and r["text"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2:
            by.setdefault(r["lang"], []).append(hd.profile(r["text"]).astype(float))
    prototypes = np.stack([sum(v) / np.linalg.norm(sum(v)) for _, v in sorted(by.items())])
    out = []
    for r in rows:
        if r["text"] is not None and (v := hd.profile(r["text"])).any():
            least = 0.2 if len(r["text"]) >= 1000 else 0.05
            out += [r] if (prototypes @ (v / np.linalg.norm(v))).max() >= least else []
    return out


def distinct_lines(rows):
    made = brute_lines([(r["doc_id"], r["text"]) for r in sorted(rows, key=lambda r: r["doc_id"])])
    new = [r | {"text": made[r["doc_id"]]} for r in rows]
    return [n for n, r in zip(new, rows, strict=True) if n["text"] == r["text"] or n["text"].strip()]


def distinct_texts(rows):
    rows = sorted(rows, key=lambda r: r["doc_id"])
    sets = [sh.word_shingles(r["text"]) for r in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if jaccard(sets[i], sets[j]) >= 0.8]
    return [rows[i] for i, c in enumerate(components(len(rows), links)) if c == i]


def clean(rows, items):
    windows = set()
    for text in items:
        words = dc.words(text)
        windows |= {tuple(words[i : i + 10]) for i in range(max(1, len(words) - 9) if words else 0)}
    sizes = {len(w) for w in windows}
    held = lambda words: any(tuple(words[i : i + n]) in windows for n in sizes for i in range(len(words) - n + 1))
    return [r for r in rows if not held(dc.words(r["text"]))]


def mixed(rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", [(r["doc_id"], r["text"], r["source"]) for r in rows])
    size = {r["doc_id"]: r for r in rows}
    taken = con.sql(queries.OP4_SQL).fetchall()
    return sorted((d, k, size[d]["text"]) for d, n, _, _, words in taken if n for k in range(1, words // n + 1))


def test_stages_equal_their_plain_versions(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    plain = {
        "language_id": languages, "line_dedup": distinct_lines, "simhash_near_dedup": distinct_texts,
        "benchmark_decontamination": lambda rows: clean(rows, items),
    }
    for name, stage in corpus_pipeline.STAGES:
        before = [r.asDict() for r in docs.collect()]
        docs = corpus_pipeline.materialize(stage(spark, docs, sf), name)
        got = [r.asDict() for r in docs.collect()]
        assert len(got) > 100
        if name == "source_mixing":
            assert sorted((r["doc_id"], r["copy_number"], r["text"]) for r in got) == mixed(before)
        else:
            key = lambda r: r["doc_id"]
            assert sorted(got, key=key) == sorted(plain[name](before), key=key), name


def test_stages_at_the_edges(spark, sf):
    rng = np.random.default_rng(1)
    junk = " ".join("".join(rng.choice(list("bcdfghjklmnpqrstvwxz"), 7)) for _ in range(400))
    base = [(r.doc_id, r.text, r.lang, r.source) for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect()]
    rows = [*base, base[0], base[0], (9001, None, "en", "src1"), (9002, "", None, None), (None, base[5][1], "en", "src1"), (9003, "12 34", "en", None), (9004, junk, None, "src2"), (9005, base[7][1] * 40, "en", None)]
    docs = spark.createDataFrame([(*r, 1, 2, 3, "c") for r in rows], "doc_id long, text string, lang string, source string, row int, version int, score int, copies string")
    none = docs.limit(0)
    ids = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns + ["copy_number"] * (name == "source_mixing")
        ids[name] = sorted([r.doc_id for r in out.collect()], key=repr)
        assert stage(spark, none, sf).count() == 0
    assert {9001, 9002, 9003, 9004}.isdisjoint(ids["language_id"])
    assert None in ids["language_id"] and ids["language_id"].count(base[0][0]) == 3
    assert ids["simhash_near_dedup"].count(base[0][0]) == 1
    assert None in ids["simhash_near_dedup"]
    assert 9001 in ids["benchmark_decontamination"]

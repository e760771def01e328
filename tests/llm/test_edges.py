"""Every operator on nulls, empty and very long texts, repeated rows, empty tables and clashing column names."""

import pytest
from pyspark.sql import functions as F

from docloom.llm import decontaminate, hd_langid, line_dedup, maxent_lm, mixing, secret_scan, simhash, token_count, warc

LONG = "the quick brown fox jumps over the lazy dog. " * 6_000
ROWS = [
    (1, "some words in a first text that stands here", "en", "a"), (1, "some words in a first text that stands here", "en", "a"),
    (2, None, "en", "a"), (3, "", "de", None), (None, "quelques mots dans un texte", "fr", "b"), (4, LONG, "en", "b"), (5, "漢" * 40_000, None, "b"), (6, "\n \t\n", "de", "a"), (7, "einige Wörter im Text", "de", ""),
]
CLASHING = [
    "id", "row", "version", "fp", "component_id", "size", "copies", "score", "lang_pred", "held_out", "n_words", "n_hit", "items", "spans", "base", "n_tokens", "n_known", "hits",
    "doc", "node", "keep", "gone_lines", "lines_dropped", "payload", "digest", "refers_to", "at", "part", "target", "units", "token", "n", "key", "word", "lang2",
]


@pytest.fixture(scope="module")
def docs(spark):
    frame = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string")
    return frame.select("*", *[F.lit(f"other {c}").alias(c) for c in CLASHING])


def operators(spark):
    items = spark.createDataFrame([(1, "quick brown fox"), (2, None), (3, ""), (1, "quick brown fox")], "item_id long, text string")
    vocabulary = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    pages = lambda d: d.withColumnsRenamed({"doc_id": "page_id", "text": "html"})
    return {
        "simhash": simhash.near_duplicates,
        "leaks": lambda d: decontaminate.contamination(d, items),
        "lines": line_dedup.deduplicated,
        "mix": mixing.mix,
        "model": maxent_lm.score,
        "language": hd_langid.identify,
        "archives": lambda d: warc.round_trip(pages(d)),
        "tokens": lambda d: token_count.token_counts(d, vocabulary),
        "secrets": secret_scan.secret_spans,
    }


@pytest.mark.parametrize("name", ["simhash", "leaks", "lines", "mix", "model", "language", "archives", "tokens", "secrets"])
def test_edges(spark, docs, name):
    run = operators(spark)[name]
    out = run(docs).collect()
    assert len(out) == len(ROWS)
    key = "doc_id" if "doc_id" in out[0].asDict() else "id"
    ids = [r[key] for r in out]
    assert sorted(ids, key=repr) == sorted([r[0] for r in ROWS], key=repr)
    first, second = (r.asDict() for r in out if r[key] == 1)
    if name not in ("mix", "archives"):  # those take and store repeated rows one by one
        assert first == second
    assert run(docs.limit(0)).count() == 0


def test_defined_results(spark, docs):
    run = operators(spark)
    leaks = {r.id: r for r in run["leaks"](docs).collect()}
    assert (leaks[2].n_words, leaks[3].n_words) == (0, 0)
    assert (leaks[4].n_words, leaks[4].n_hit, leaks[4]["items"]) == (54_000, 18_000, ["1"])
    languages = {r.doc_id: r for r in run["language"](docs).collect()}
    assert languages[2].lang_pred == languages[3].lang_pred == languages[6].lang_pred == "und"
    tokens = {r.id: r for r in run["tokens"](docs).collect()}
    assert (tokens[2].n_tokens, tokens[5].n_bytes) == (0, 120_000)
    model = {r.id: r for r in run["model"](docs).collect()}
    assert (model[2].n_tokens, model[3].n_tokens, model[6].n_tokens) == (1, 1, 1)
    assert model[2].score == model[3].score
    assert model[4].n_tokens == 54_001
    archived = {r.id: r for r in run["archives"](docs).collect()}
    assert (archived[2].payload_bytes, archived[2].record_type) == (0, "response")
    mixed = {r.id: r.size for r in run["mix"](docs).collect()}
    assert (mixed[2], mixed[4]) == (0, 54_000)

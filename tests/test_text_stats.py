"""Golden values of the densities, and edge cases of the text functions."""

import pytest
from pyspark.sql import functions as F

from docloom.functions import questions as fq
from docloom.functions import text_stats as ts


def one(spark, text, **columns):
    row = spark.createDataFrame([(text,)], "t string").select(*[c.alias(k) for k, c in columns.items()]).first()
    return row.asDict()


def test_densities_of_a_small_text(spark):
    text = "ab 12²\n"
    got = one(spark, text, **{k: v for k, v in ts.densities(F.col("t")).items()})
    assert got["numeric"] == pytest.approx(min(1, 3 / 7 / 0.3))
    assert got["line"] == 1.0
    assert got["token"] == pytest.approx(min(1, 2 / 7 / 0.25))
    assert got["whitespace"] == pytest.approx(max(0, 1 - 2 / 7 / 0.3))


def test_empty_text(spark):
    for text in ("", " \n", None):
        got = one(spark, text, c=ts.classify_density(F.col("t")), d=ts.overall_density(F.col("t")))
        assert got == {"c": "empty", "d": 0.0}


@pytest.mark.parametrize(("density", "size", "overlap"), [(0.1050, 1843, 276), (0.3304, 1505, 225), (0.3292, 1507, 226), (0.4295, 1356, 203), (1.0, 500, 75), (0.0, 2000, 300)])
def test_recommended_sizes(spark, density, size, overlap):
    row = spark.createDataFrame([(density,)], "d double").select(ts.recommend_chunk_size(F.col("d")).alias("s")).select("s", ts.recommend_overlap(F.col("s")).alias("o")).first()
    assert abs(row.s - size) <= 1
    assert abs(row.o - overlap) <= 1


@pytest.mark.parametrize(
    ("text", "kind"),
    [("INTRODUCTION", "header"), ("2.1 Methods", "header"), ("a | b | c\n1 | 2 | 3", "table"), ("- one thing\nand more of it", "list"), ("\tx = f(a);\n\ty = {b};\n\tz = [c];", "code"), ("    x = f(a);\n    y = {b};", "table"), ("Plain words in a row.", "paragraph"), (" ", "paragraph")],
)
def test_content_types(spark, text, kind):
    assert one(spark, text, k=ts.identify_content_type(F.col("t")))["k"] == kind


def test_sentences_split_before_capitals_only(spark):
    got = one(spark, " One. two? Three!  Four 3.5 five.\nSix", s=fq.split_sentences(F.col("t")))["s"]
    assert got == ["One. two?", "Three!", "Four 3.5 five.", "Six"]


def test_query_lists(spark):
    parse = lambda t: one(spark, t, q=fq.parse_query_list(F.col("t"), 3, 2))["q"]
    assert parse('["alpha", " be ", "gamma", "delta", "omega"]') == ["alpha", "gamma", "delta"]
    assert parse('1. first one\n2. "second one"') == ["first one", "second one"]
    assert parse("- first one\n- second one") == ["first one", "second one"]
    assert parse("nothing") == []


def test_default_box(spark):
    row = spark.createDataFrame([([306.0, 396.0, 612.0, 792.0],), (None,), ([1.0],)], "b array<double>").select(*[v.alias(k) for k, v in fq.bbox_to_percent(F.col("b")).items()]).collect()
    assert [tuple(r) for r in row] == [(50.0, 50.0, 50.0, 50.0), (10.0, 10.0, 30.0, 30.0), (10.0, 10.0, 30.0, 30.0)]

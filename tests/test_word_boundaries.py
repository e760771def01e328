"""Word boundaries and white space as Python's ``re`` has them for text in any script."""

import random
import re

from pyspark.sql import functions as F

from docloom.functions import questions as fq
from docloom.functions import text_stats as ts
from docloom.sources.tables import WHITE, stripped

SAID = ["5% of sales", "5%of", "15% of", "(7.5%)", "a mean value", "meaning", "MEAN²", "mean_", "émean", "mean é", "p-value!", "x12", "12", "figure 3", "Figure 33a", "however", "Thus,", "thus1", "cause s", "causes", "is known", "key finding", "standard deviation.", ""]


def test_critical_patterns_equal_re(spark):
    rng = random.Random(5)
    texts = SAID + [" ".join(rng.choice(SAID) for _ in range(5)) for _ in range(300)]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.n for r in frame.select("i", fq.critical_matches(F.col("t")).alias("n")).collect()}
    for i, t in enumerate(texts):
        want = sum(bool(re.search(rf"\b(?:{p})\b", t, re.IGNORECASE)) for p in fq.CRITICAL)
        assert got[i] == want, t


def test_white_space_equals_str(spark):
    odd = [c for c in map(chr, range(0x3100)) if c.isspace()]
    assert sorted(WHITE) == odd
    texts = [f"{c}a{c}{c}b{c}" for c in odd] + ["a​b", "﻿x"]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = frame.select("i", stripped("t").alias("s"), fq.word_number(F.col("t")).alias("n"), ts.whitespace_density(F.col("t")).alias("d"), fq.split_sentences(F.concat(F.lit("One."), F.col("t"), F.lit("B"))).alias("x")).collect()
    for r in rows:
        t = texts[r.i]
        assert r.s == t.strip()
        assert r.n == len(t.split())
        assert abs(r.d - max(0.0, 1 - sum(c.isspace() for c in t) / len(t) / 0.30)) < 1e-12
    assert stripped_pages(spark) == [(1, 1)]


def stripped_pages(spark):
    from docloom.sources.tables import pages_of

    docs = spark.createDataFrame([(1, "x" * 3000 + "  "), (2, "　"), (3, ""), (4, None)], "doc_id long, text string")
    return [(r.doc_id, r.page_number) for r in pages_of(docs).collect()]

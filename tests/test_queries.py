"""Every registered query equals its SQL twin on the smallest tables; the others give rows."""

import glob
import math
import os

import duckdb
import pytest

from docloom.plans import catalogue

QUERIES, ORACLES = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def cell(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 8)
    return float(v) if type(v).__name__ == "Decimal" else v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(cell(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    got = rows(df.columns, df.collect())
    if name in ORACLES:
        want = duck.sql(ORACLES[name])
        assert sorted(df.columns) == sorted(want.columns)
        assert got == rows(want.columns, want.fetchall())
    else:
        assert got


def test_repartitioning_changes_nothing(spark, sf):
    from docloom.plans.questions import critical_of, dedupe_sentences, sentences_of
    from docloom.plans.texts import pages

    run = lambda n: sorted(map(tuple, dedupe_sentences(critical_of(sentences_of(pages(spark, sf).repartition(n)))).collect()))
    assert run(1) == run(3) == run(8)

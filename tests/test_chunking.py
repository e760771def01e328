"""Properties of the splitter."""

from hypothesis import given, settings
from hypothesis import strategies as st

from docloom.operators.chunking import LEVELS, PROSE, repaired, split_hierarchical, split_semantic_pages, split_text

texts = st.text(alphabet="ab .,\n!éÄ", min_size=1, max_size=400)


@settings(max_examples=150, deadline=None)
@given(texts, st.integers(5, 60), st.integers(0, 4))
def test_chunks_fit_and_come_from_the_text(text, size, overlap):
    for chunk in split_text(text, size, overlap, PROSE):
        assert 0 < len(chunk) <= size
        assert chunk in text
        assert chunk == chunk.strip()


@settings(max_examples=100, deadline=None)
@given(texts, st.integers(5, 60))
def test_nothing_is_lost_without_overlap(text, size):
    bare = lambda s: "".join(s.split())
    assert bare("".join(split_text(text, size, 0, PROSE))) == bare(text)


def test_known_splits():
    assert split_text("aaa bbb ccc", 6, 0, LEVELS) == ["aaa", "bbb", "ccc"]
    assert split_text("aaa bbb ccc", 8, 0, LEVELS) == ["aaa bbb", "ccc"]
    assert split_text("x" * 12, 5, 2, LEVELS) == ["xxxxx", "xxxxx", "xxxxx", "xxx"]
    assert split_text(" \n ", 5, 0, LEVELS) == []


def test_boundary_repair_carries_open_sentences():
    assert repaired(["One. Two is", "not done. Three"]) == ["One.", "Two is not done.", "Three"]
    assert repaired(["open", "still open"]) == ["open still open"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab AB.!?", min_size=1, max_size=40).map(str.strip).filter(bool), min_size=1, max_size=8))
def test_repaired_chunks_end_where_a_sentence_does(chunks):
    out = repaired(chunks)
    assert "".join("".join(out).split()) == "".join("".join(chunks).split())
    assert all(c[-1] in ".!?" for c in out[:-1])
    page, at = "".join(chunks).replace(" ", ""), 0
    ends = {sum(len(c.replace(" ", "")) for c in chunks[: i + 1]) for i in range(len(chunks))}
    for c in out[:-1]:  # no chunk grows beyond the end that it had, but for taking up what is unfinished
        at += len(c.replace(" ", ""))
        assert any(at <= e for e in ends)
        assert page[at - 1] in ".!?"


def plain_split(text, size, marks):
    """Without overlap, by cutting at the first mark that occurs and filling chunks greedily."""
    mark = next(m for m in marks if m == "" or m in text)
    pieces, rest = [], text
    while rest:
        cut = 1 if mark == "" else rest.find(mark, 1 if rest.startswith(mark) else 0)
        cut = len(rest) if cut < 0 else cut
        pieces.append(rest[:cut])
        rest = rest[cut:]
    out, held = [], ""
    for p in pieces:
        if len(p) >= size:
            out += [held, *(plain_split(p, size, marks[marks.index(mark) + 1 :]) if mark else [p])]
            held = ""
        elif len(held) + len(p) > size:
            out.append(held)
            held = p
        else:
            held += p
    return [c.strip() for c in [*out, held] if c.strip()]


def test_splits_of_whole_tables_equal_a_plain_splitter(spark, sf):
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if r.text]
    for size in (90, 400, 1000):
        for marks in (PROSE, LEVELS):
            for text in texts:
                assert split_text(text[:20_000], size, 0, marks) == plain_split(text[:20_000], size, marks)


def test_children_lie_in_parents(spark):
    page = ("Some words here. " * 300).strip()
    rows = split_hierarchical(spark.createDataFrame([(1, 1, page)], "doc_id long, page_number int, content string")).collect()
    assert len({r.parent_id for r in rows}) > 1
    assert all(r.child in r.parent for r in rows)
    assert len({r.child_id for r in rows}) == len(rows)


def test_semantic_pages_turn_where_the_meaning_does(spark):
    import numpy as np

    def embed(texts):  # how often either word occurs
        return np.array([[t.count("sun"), t.count("sea")] for t in texts], float)

    text = "The sun is up. The sun is hot!  The sun sets?\nThe sea is wide. The sea is deep. The sea is cold."
    rows = [(1, 1, text), (1, 2, "One sentence only"), (2, 1, None), (2, 2, " \n "), (3, 1, "No words here. None there. ")]
    pages = spark.createDataFrame(rows, "doc_id long, page_number int, content string")
    got = {(r.doc_id, r.page_number, r.chunk_index): (r.content, r.n_sentences) for r in split_semantic_pages(pages, embed, 70.0, neighbours=0).collect()}
    assert got == {
        (1, 1, 0): ("The sun is up. The sun is hot! The sun sets?", 3), (1, 1, 1): ("The sea is wide. The sea is deep. The sea is cold.", 3),
        (1, 2, 0): ("One sentence only", 1), (3, 1, 0): ("No words here. None there.", 2),
    }
    calls = []

    def counting(texts):
        calls.append(len(texts))
        return np.ones((len(texts), 2))

    from docloom.operators.vectors import neighbour_distances

    frame = neighbour_distances(counting, batch=4).func
    import pandas as pd

    (far,) = frame(iter([pd.Series([["a", "b", "c"], [], ["d"], ["e", "f"]])]))
    assert [len(x) for x in far] == [2, 0, 0, 1] and calls == [4, 2]
    assert split_semantic_pages(pages.limit(0), embed).count() == 0


def test_the_table_function_splits_as_the_operator_does(spark, sf):
    from docloom.plans import catalogue

    rows = lambda name: sorted(tuple(r) for r in catalogue.queries()[name](spark, sf).select("doc_id", "page_number", "chunk_index", "content").collect())
    assert rows("c01_split_sql") == rows("c01_split_flat")
    spark.createDataFrame([(1, None), (2, ""), (3, "a b")], "i int, t string").createOrReplaceTempView("odd_texts")
    got = spark.sql("SELECT o.i, s.content FROM odd_texts o, LATERAL split_text(o.t, 10, 0) s").collect()
    assert [tuple(r) for r in got] == [(3, "a b")]

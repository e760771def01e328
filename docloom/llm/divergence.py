"""Source divergence audit: how the terms of a language's sources differ from each other and from the language."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import discard, materialize, small_batches, table, utf8

#: Letters and everything outside ASCII stay, A-Z in lower case; all other bytes part terms.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
LEAST_DOCUMENTS, SMOOTHING, UNIT, TOP_TERMS = 30, 5, 1_000_000_000, 50
#: A task sends its sums when it holds so many terms, so its memory doesn't grow with its input.
HELD_TERMS = 400_000
#: Cells of a block of terms by sources, and of the sums that a task holds before it sends them.
BLOCK_CELLS, HELD_CELLS = 1 << 19, 1 << 22


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences, and rows that hold the term, summed by task so far.

    The empty term stands for the rows themselves, so groups without terms occur too.
    """
    small_batches(docs.sparkSession)

    def send(held: dict[tuple[str, str], tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
        for (lang, source), (total, present) in held.items():
            words = list(present)
            same = lambda v: pa.array([v], pa.string()).take(pa.array(np.zeros(len(words), np.int32)))  # noqa: E731,B023
            yield table({"lang": same(lang), "source": same(source), "term": pa.array(words, pa.binary()).cast(pa.string()), "n": pa.array([total[w] for w in words], pa.int64()), "docs": pa.array([present[w] for w in words], pa.int64())})
        held.clear()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        for b in batches:
            for text, lang, source in zip(*(c.to_pylist() for c in b.columns), strict=True):
                total, present = held.setdefault((lang, source), (Counter(), Counter()))
                own = Counter(utf8(text).translate(LETTERS).split())
                for term, n in own.items():
                    total[term] += n
                present.update(own.keys())
                present[b""] += 1
            if sum(len(p) for _, p in held.values()) > HELD_TERMS:
                yield from send(held)
        yield from send(held)

    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(plain(text_col).alias("text"), plain(lang_col).alias("lang"), plain(source_col).alias("source"))
    return rows.mapInArrow(run, "lang string, source string, term string, n long, docs long")


def share(n: F.Column, total: F.Column, terms: F.Column) -> F.Column:
    """1 + floor(UNIT * (n + SMOOTHING) / (total + SMOOTHING * terms)) in exact whole numbers."""
    above = F.lit(UNIT).cast("decimal(10,0)") * (n + SMOOTHING).cast("decimal(19,0)")
    return F.call_function("div", above, (total + SMOOTHING * terms).cast("decimal(19,0)")).cast("long") + 1


def _pair_sums(rows: DataFrame) -> DataFrame:
    """(lang, i, j, value): sums of |p_i - p_j| over the terms, i < j, added up by task.

    rows: (lang, zeros, present, shares) for each term; zeros has the p of count 0 of all sources of the language in order,
    present the places of the sources that hold the term and shares their p.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}

        def send() -> Iterator[pa.RecordBatch]:
            for lang, s in sums.items():
                for i in range(len(s) - 1):
                    others = np.arange(i + 1, len(s))
                    whole = lambda v, n=len(others): pa.array(np.full(n, v), pa.int32())
                    yield table({"lang": pa.array([lang] * len(others), pa.string()), "i": whole(i), "j": pa.array(others, pa.int32()), "value": pa.array(s[i, i + 1 :], pa.int64())})
            sums.clear()

        for b in batches:
            langs = b.column(0)
            for lang in langs.unique().to_pylist():
                own = pa.RecordBatch.from_arrays(b.columns, schema=b.schema).filter(pa.compute.equal(langs, lang))
                zeros = own.column(1)[0].values.to_numpy()
                if lang not in sums and sum(s.size for s in sums.values()) + len(zeros) ** 2 > HELD_CELLS:
                    yield from send()
                s = sums.setdefault(lang, np.zeros((len(zeros), len(zeros)), np.int64))
                step = max(1, BLOCK_CELLS // len(zeros))
                for at in range(0, own.num_rows, step):
                    part = own.slice(at, step)
                    p = np.tile(zeros, (part.num_rows, 1))
                    lengths = part.column(2).value_lengths().to_numpy()
                    p[np.repeat(np.arange(part.num_rows), lengths), part.column(2).flatten().to_numpy()] = part.column(3).flatten().to_numpy()
                    p = np.ascontiguousarray(p.T)
                    for i in range(len(zeros) - 1):
                        s[i, i + 1 :] += np.abs(p[i + 1 :] - p[i]).sum(axis=1)
        yield from send()

    return rows.mapInArrow(run, "lang string, i int, j int, value long").groupBy("lang", "i", "j").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least: int = LEAST_DOCUMENTS, top: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): the distance of each source to every other, and its most typical terms.

    Each language keeps the terms of ``least`` of its rows or more. p of a kept term in a group is
    1 + floor(10^9 * (n + 5) / (N + 5 * V)). Part ``pair``: the sum of |p - q| over all kept terms to every other source of
    the language. Part ``term``: kept terms of the source with p above the language's q, by p - q, to rank ``top``.
    Ranks are from 1 by value, highest first, then item by its bytes.

    Texts are read once. Sums by task go to the tasks that own a (language, term), whatever the size of a source, and
    everything after works on counts. A term's row holds an entry for each source that has it; the result has a row
    for each ordered pair of sources. Null text, language and source are empty strings; repeated rows count each
    time; an empty table gives no rows; other columns play no part.
    """
    counts = term_counts(docs, text_col, lang_col, source_col).repartition("lang", "term")
    counts = counts.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    everywhere = Window.partitionBy("lang", "term")
    counts = counts.select("lang", "term", "source", "n", F.sum("docs").over(everywhere).alias("in_docs"), F.sum("n").over(everywhere).alias("lang_n"))
    kept = materialize(counts.where((F.col("term") == "") | (F.col("in_docs") >= least)), "divergence-terms")
    terms = kept.where("term <> ''")
    # one row for each group, and one for each language
    groups = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = terms.groupBy("lang", "term").agg(F.first("lang_n").alias("n")).groupBy("lang").agg(F.count("*").alias("terms"), F.sum("n").alias("lang_total"))
    groups = groups.join(langs, "lang", "left").fillna(0, ["terms", "lang_total"])
    groups = groups.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1)
    zero = F.when(F.col("terms") > 0, share(F.lit(0).cast("long"), F.col("total"), F.col("terms")))
    groups = materialize(groups.withColumn("zero", zero), "divergence-groups")

    shares = terms.join(groups, ["lang", "source"]).select("lang", "source", "term", "place", "n", share(F.col("n"), F.col("total"), F.col("terms")).alias("p"), share(F.col("lang_n"), F.col("lang_total"), F.col("terms")).alias("q"))
    listed = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item"))
    typical = shares.where("n > 0 and p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    typical = typical.withColumn("rank", F.row_number().over(listed)).where(F.col("rank") <= top)

    zeros = groups.where("terms > 0").groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("place", "zero")))["zero"].alias("zeros"))
    by_term = shares.groupBy("lang", "term").agg(F.collect_list(F.struct("place", "p")).alias("held"))
    sums = _pair_sums(by_term.join(zeros, "lang").select("lang", "zeros", F.col("held.place").alias("present"), F.col("held.p").alias("shares")))
    one = groups.select("lang", "source", F.col("place").alias("a"))
    pairs = one.join(groups.select("lang", F.col("source").alias("item"), F.col("place").alias("b")), "lang").where("a <> b")
    pairs = pairs.withColumns({"i": F.least("a", "b"), "j": F.greatest("a", "b")}).join(sums, ["lang", "i", "j"], "left")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).cast("long").alias("value"))
    pairs = pairs.withColumn("rank", F.row_number().over(listed))
    out = materialize(pairs.unionByName(typical), "divergence")
    discard(kept, groups)
    return out

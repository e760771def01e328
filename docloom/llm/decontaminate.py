"""Benchmark decontamination: one Aho-Corasick automaton over the words of test items."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import small_batches, table, utf8

#: Words are digits, letters and everything outside ASCII; other ASCII characters part them.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
WINDOW = 10
#: Items of at most about so many bytes go into one automaton (and one broadcast); more items, more scans.
SHARD_BYTES = 16_000_000


def words(text: str | None) -> list[bytes]:
    return utf8(text).translate(FOLD).split()


class Matcher:
    """All windows of the items as word-number sequences in one automaton."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW):
        self.numbers: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str]] = {}
        for item_id, text in items:
            seq = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in words(text)]
            for i in range(max(1, len(seq) - window + 1) if seq else 0):
                owner = owners.setdefault(tuple(seq[i : i + window]), set())
                if item_id is not None:
                    owner.add(item_id)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for key, owner in owners.items():
            self.automaton.add_word(key, (len(key), tuple(owner)))
        self.empty = not owners
        if owners:
            self.automaton.make_automaton()

    def scan(self, seq: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Word ranges of all occurrences (start, end), and the items found."""
        get = self.numbers.get
        numbers = tuple([get(w, 0) for w in seq])
        if self.empty or not any(numbers):
            return [], set()
        ranges, found = [], set()
        for last, (size, owner) in self.automaton.iter(numbers):
            ranges.append((last + 1 - size, last + 1))
            found.update(owner)
        return ranges, found


_matchers: dict[str, Matcher] = {}


def merge(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of half-open ranges, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(id, n_words, n_hit, items array<string>, spans array<struct<start,end>>) of every document row.

    spans are half-open code-point ranges of the hit words in the original text, merged. Every text is
    scanned once for each shard of items; there is one shard unless the items outgrow ``shard_bytes``.
    Null texts have no words. A null item id hits words but is not listed; repeated item ids count once.
    """
    spark = docs.sparkSession
    small_batches(spark)
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text).alias("text"))
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    shards = max(1, -(-total // shard_bytes))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.array().cast("array<int>").alias("hits"), F.array().cast("array<string>").alias("items"))
    schema = f"id {dict(rows.dtypes)['id']}, text string, hits array<int>, items array<string>"
    for shard in range(shards):
        part = items.where(F.pmod(F.xxhash64("text"), F.lit(shards)) == shard) if shards > 1 else items
        sent = spark.sparkContext.broadcast([tuple(r) for r in part.distinct().orderBy("item", "text").collect()])  # bounded by shard_bytes
        rows = rows.mapInArrow(_scanner(sent, window), schema)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_words, n_hit, spans = [], [], []
            for text, flat in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                ranges = merge(list(zip(flat[::2], flat[1::2], strict=True)))
                n_words.append(len(words(text)))
                n_hit.append(sum(e - s for s, e in ranges))
                places = [m.span() for m in _WORD.finditer(text)] if ranges else []
                spans.append([{"start": places[s][0], "end": places[e - 1][1]} for s, e in ranges])
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield table({"id": b.column(0), "n_words": pa.array(n_words, pa.int64()), "n_hit": pa.array(n_hit, pa.int64()), "items": b.column(3), "spans": pa.array(spans, kind)})

    return rows.mapInArrow(finish, f"id {dict(rows.dtypes)['id']}, n_words long, n_hit long, items array<string>, spans array<struct<start:int,end:int>>")


def _scanner(sent, window: int):
    name = uuid.uuid4().hex

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _matchers:  # one automaton for each Python worker and shard; those of earlier calls go
            if len(_matchers) > 2:
                _matchers.clear()
            _matchers[name] = Matcher(sent.value, window)
        matcher = _matchers[name]
        for b in batches:
            hits, items = [], []
            for text, old, had in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                ranges, found = matcher.scan(words(text))
                hits.append(old + [x for r in merge(ranges) for x in r])
                items.append(sorted({*had, *found}))
            yield table({"id": b.column(0), "text": b.column(1), "hits": pa.array(hits, pa.list_(pa.int32())), "items": pa.array(items, pa.list_(pa.string()))})

    return scan


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without any hit, with all their columns, in one scan (rows are judged one by one)."""
    spark = docs.sparkSession
    small_batches(spark)
    found = contamination(docs.select(F.struct(*docs.columns).alias("row"), F.col(text_col).alias("scanned_text")), benchmark, "row", "scanned_text")
    return found.where("n_hit = 0").select("id.*")

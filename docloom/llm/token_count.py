"""Exact token counts; huge texts are encoded in overlapping chunks that resynchronise."""

from __future__ import annotations

from collections import ChainMap
from collections.abc import Iterable, Iterator
from unicodedata import ucd_3_2_0

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import small_batches, table, utf8

#: Texts of more characters than this are encoded in chunks of it.
CHUNK = 16_384
OVERLAP = 256
#: Counts of pieces that a worker remembers, of so many characters each at most: about 100 MB.
REMEMBER, REMEMBERED_CHARS = 400_000, 64
#: Characters encoded at a time, as an encoding takes some hundred bytes a token.
ENCODED_CHARS = 1 << 19
_BLANK = " \n\r\t"
#: First letters of the Unicode categories on both sides of a sure boundary: letter or digit, then a sign; letter and digit.
_BREAKS = {"LP", "LS", "LN", "NL", "NP", "NS"}
category = ucd_3_2_0.category


def load(path: str):
    """The tokenizer of a .json file, with the library's defaults for special strings."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def specials(tokenizer) -> list[str]:
    """The special strings that the tokenizer takes out of a text before all else."""
    return [t.content for t in tokenizer.get_added_tokens_decoder().values()]


def is_seam(text: str, at: int, special: list[str] = ()) -> bool:
    """Whether tokens on both sides of ``at`` are proven independent by the rule of the byte-level pre-tokenizer.

    Its matches are runs of letters, of digits, of other signs (all with one leading blank at most), of white
    space, or short forms such as 's; it looks behind none. So every match ends before white space that follows
    something else, and where a letter is followed by a sign, a digit by a letter or a letter by a digit. Letters and
    signs count as such here only if they have been since Unicode 3.2, as the library may know fewer than Python.
    A place inside a special string is none.
    """
    if not 0 < at < len(text) or text[at - 1].isspace():
        return False
    after = text[at]
    if after not in _BLANK:
        before, after = category(text[at - 1])[0], category(after)[0]
        if before + after not in _BREAKS:
            return False
    return not any(text.find(s, max(0, at - len(s) + 1), at + len(s) - 1) >= 0 for s in special)


def spliced_count(tokenizer, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Token count of a huge text from chunks [begin, begin + chunk) that share ``overlap`` characters.

    Neighbours are spliced at a position inside the overlap that is a token boundary in both encodings
    and a proven seam. If there is none, the overlap doubles, and in the end the left chunk doubles, so
    that all encodings together stay within a few times the text even where it has no seam at all.
    """
    special = specials(tokenizer)
    total, begin, size, wide = 0, 0, chunk, overlap
    left = tokenizer.encode(text[:size], add_special_tokens=False).offsets
    while begin + size < len(text):
        end = begin + size
        start = max(begin + 1, end - wide)
        right = tokenizer.encode(text[start : start + chunk + wide], add_special_tokens=False).offsets
        ends_left = {begin + e for _, e in left if begin + e > start}
        starts_right = {start + s for s, _ in right if start + s < end}
        seam = next((p for p in sorted(ends_left & starts_right) if start < p < end and is_seam(text, p, special)), None)
        if seam is None:
            if start > begin + 1:
                wide *= 4  # widen the overlap
            else:
                size, wide = 2 * size, overlap  # no seam in the whole chunk: let it grow
                left = tokenizer.encode(text[begin : begin + size], add_special_tokens=False).offsets
            continue
        total += sum(1 for _, e in left if begin + e <= seam)
        size = min(len(text), start + chunk + wide) - seam
        left = [(s + start - seam, e + start - seam) for s, e in right if start + s >= seam]
        begin, wide = seam, overlap
    return total + len(left)


class Counter:
    """Counts tokens of texts. Texts up to ``chunk`` characters part at their seams into pieces whose counts are remembered."""

    def __init__(self, path: str, chunk: int = CHUNK, overlap: int = OVERLAP):
        self.tokenizer, self.chunk, self.overlap = load(path), chunk, overlap
        if any(" " in s for s in specials(self.tokenizer)):
            raise ValueError("a special string holds a blank, at which texts are cut")
        self.known: dict[str, int] = {}

    def pieces(self, text: str) -> list[str]:
        parts = text.split(" ")
        out = [parts[0]] if parts[0] else []
        joined = bool(out) and not parts[0][-1].isspace()
        for p in parts[1:]:
            if joined or not out:
                out.append(" " + p)
            else:
                out[-1] += " " + p  # the blank follows white space: no seam
            joined = p != "" and not p[-1].isspace()
        return out

    def counts(self, texts: list[str]) -> list[int]:
        split = [self.pieces(t) if len(t) <= self.chunk else None for t in texts]
        known = self.known
        new = {p for s in split if s for p in s if p not in known}
        if len(known) + len(new) > REMEMBER:
            known.clear()
            new = {p for s in split if s for p in s}
        once = {}
        for group in self.groups(new):
            for p, e in zip(group, self.tokenizer.encode_batch_fast(group, add_special_tokens=False), strict=True):
                (known if len(p) <= REMEMBERED_CHARS else once)[p] = len(e.ids)
        found = ChainMap(once, known) if once else known
        return [sum([found[p] for p in s]) if s is not None else spliced_count(self.tokenizer, t, self.chunk, self.overlap) for s, t in zip(split, texts, strict=True)]

    def groups(self, pieces: Iterable[str]) -> Iterator[list[str]]:
        """Pieces in lists of about ``ENCODED_CHARS`` characters."""
        held, size = [], 0
        for p in pieces:
            held.append(p)
            size += len(p)
            if size >= ENCODED_CHARS:
                yield held
                held, size = [], 0
        if held:
            yield held


_counters: dict[tuple, Counter] = {}


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row, without begin, end or other added tokens.

    ``path`` is a byte-level .json vocabulary that every executor can open. Null texts are empty.
    Rows are judged one by one: repeated rows, null ids and other columns play no part.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (path, chunk, overlap)
        if key not in _counters:
            _counters[key] = Counter(*key)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            n = _counters[key].counts(texts)
            yield table({"id": b.column(0), "n_bytes": pa.array([len(utf8(t)) for t in texts], pa.int64()), "n_tokens": pa.array(n, pa.int64()), "over_limit": pa.array([x > limit for x in n])})

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, n_bytes long, n_tokens long, over_limit boolean")

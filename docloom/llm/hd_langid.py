"""Language identification with hyperdimensional profiles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import small_batches, table

DIM = 1024
#: Letters a-z and blank have numbers of their own; all others share the rest by code point.
LETTERS = 96
_rng = np.random.default_rng(11)
_BASE = _rng.choice(np.array([-1, 1], dtype=np.int8), size=(LETTERS, DIM))
#: The letter's place in an n-gram is bound in by rotating its vector.
_FIRST, _SECOND, _THIRD = np.roll(_BASE, 2, axis=1), np.roll(_BASE, 1, axis=1), _BASE
_PLANE = 1 << 16


def _letter_numbers() -> np.ndarray:
    out = np.zeros(_PLANE, dtype=np.uint8)
    for cp in range(_PLANE):
        ch = chr(cp)
        if ch.isalpha():
            out[cp] = cp - 96 if "a" <= ch <= "z" else 27 + cp % (LETTERS - 27)
    return out


_NUMBERS = _letter_numbers()


def grams(text: str | None) -> np.ndarray:
    """Numbers of the letter trigrams of a text in lower case, words set off by single blanks; empty without letters."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    high = codes >= _PLANE
    letters = _NUMBERS[np.where(high, 0, codes)].astype(np.int32)
    if high.any():
        for i in np.flatnonzero(high):
            letters[i] = 27 + int(codes[i]) % (LETTERS - 27) if codes[i] <= 0x10FFFF and chr(codes[i]).isalpha() else 0
    if not letters.any():
        return np.zeros(0, dtype=np.int32)
    letters = np.concatenate([[0], letters, [0]]).astype(np.int32)
    letters = letters[(letters != 0) | np.concatenate([[True], letters[:-1] != 0])]
    return (letters[:-2] * LETTERS + letters[1:-1]) * LETTERS + letters[2:]


def bundle(ids: np.ndarray, counts: np.ndarray, kind: type = np.float32) -> np.ndarray:
    """Sum of the n-gram vectors, each the product of its three rotated letter vectors."""
    out = np.zeros(DIM, dtype=kind)
    weights = counts.astype(kind)
    for lo in range(0, len(ids), 2048):
        part = ids[lo : lo + 2048]
        bound = _FIRST[part // (LETTERS * LETTERS)] * _SECOND[part // LETTERS % LETTERS] * _THIRD[part % LETTERS]
        out += weights[lo : lo + 2048] @ bound.astype(kind)
    return out


def profile(text: str | None) -> np.ndarray:
    ids, counts = np.unique(grams(text), return_counts=True)
    return bundle(ids, counts)


def train(labelled: DataFrame) -> dict[str, np.ndarray]:
    """Unit prototypes by language from (text, lang); languages are few (each takes a vector of 4 KB).

    A prototype bundles all n-grams of its language. As bundling is a sum, the n-grams are counted first
    and each distinct one is bound once.
    """

    def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        ids, place = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        return ids, np.bincount(place, np.concatenate([p[1] for p in parts]), len(ids)).astype(np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        for b in batches:
            by: dict[str, list[np.ndarray]] = {}
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                by.setdefault(lang, []).append(grams(text))
            for lang, parts in by.items():
                held = sums.setdefault(lang, [])
                held.append(np.unique(np.concatenate(parts), return_counts=True))
                if len(held) > 64:
                    sums[lang] = [summed(held)]
        for lang, held in sums.items():
            ids, n = summed(held)
            yield table({"lang": pa.array([lang] * len(ids), pa.string()), "gram": pa.array(ids.astype(np.int64)), "n": pa.array(n)})

    def bind(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            lang, ids, n = b.column(0).to_pylist(), b.column(1).to_numpy(), b.column(2).to_numpy()
            names = np.array(lang, dtype=object)
            for name in set(lang):
                at = names == name
                sums[name] = sums.get(name, 0) + bundle(ids[at], n[at], np.float64)
        for name, vector in sums.items():
            yield table({"lang": pa.array([name] * DIM), "place": pa.array(np.arange(DIM, dtype=np.int32)), "value": pa.array(vector.astype(np.int64))})

    rows = labelled.where("lang IS NOT NULL AND text IS NOT NULL").select("text", "lang")
    counted = rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    bound = counted.mapInArrow(bind, "lang string, place int, value long").groupBy("lang", "place").agg(F.sum("value").alias("value"))
    sums: dict[str, np.ndarray] = {}
    for lang, place, value in bound.collect():  # DIM numbers for each language
        sums.setdefault(lang, np.zeros(DIM))[place] = value
    return {lang: (v / max(np.linalg.norm(v), 1e-9)).astype(np.float32) for lang, v in sorted(sums.items())}


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with lang_pred and score added: the closest prototype and its cosine, cut to 0 to 1.

    ``und`` with score 0 where the text is null or has no letter, or where nothing was learned. Ties go
    to the language first by code point. Clashing columns lang_pred and score are replaced.
    """
    small_batches(docs.sparkSession)
    names = list(prototypes)
    matrix = np.stack([prototypes[n] for n in names]) if names else np.zeros((0, DIM), dtype=np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, scores = [], []
            for text in b.column(b.schema.get_field_index("hd_text")).to_pylist():
                ids, counts = np.unique(grams(text), return_counts=True)
                lang, score = "und", 0.0
                if len(ids) and names:
                    v = bundle(ids, counts)
                    cos = matrix @ (v / max(float(np.linalg.norm(v)), 1e-9))
                    k = int(cos.argmax())
                    lang, score = names[k], float(min(1.0, max(0.0, cos[k])))
                langs.append(lang)
                scores.append(score)
            yield table({"row": b.column(0), "lang_pred": pa.array(langs, pa.string()), "score": pa.array(scores, pa.float64())})

    keep = [c for c in docs.columns if c not in ("lang_pred", "score")]
    rows = docs.select(F.struct(*keep).alias("row"), F.col(text_col).alias("hd_text"))
    return rows.mapInArrow(run, f"row {dict(rows.dtypes)['row']}, lang_pred string, score double").select("row.*", "lang_pred", "score")


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds


def identify(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, held_out, lang_pred, score) of every row, learned from the rows outside fold 2 of 4 that have a language."""
    small_batches(docs.sparkSession)
    held = (fold(id_col, 4) == 2).alias("held_out")
    prototypes = train(docs.where(fold(id_col, 4) != 2))
    return predict(docs.select(id_col, held, "text"), prototypes).drop("text")

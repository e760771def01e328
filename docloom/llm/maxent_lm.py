"""Language-model scores: a hashed maximum-entropy model with a class-factored softmax.

P(word | history) = P(class | history) * P(word | class). Classes come from the form of a word (its
last letters, hashed), the end of a text is a class of its own. P(class | history) is a softmax over
hashed features of the history: the last word, the last two word endings (n-grams), and the words
two and three back (skips). P(word | class) is the add-half estimate from the counts, each class with
one more place for unseen words, so the probabilities of all words and one unseen word in each class
add up to one.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import lower_words, materialize, small_batches, table

#: Word classes; the last is the end of a text.
CLASSES = 49
END = CLASSES - 1
#: Rows of the weight table for each kind of feature.
BUCKETS = 1 << 13
KINDS = 4
#: Words that may be sent to the tasks with their counts; the others are looked up by a join.
HEAD_WORDS = 1 << 17
STEP_TOKENS = 4096
#: Rows that are added for all groups at once; longer groups are summed one by one.
ROUNDS = 24
RATE = 0.1
#: What AdaGrad sums start from; it damps the first steps of rare features.
PRIOR = 1.0
#: Row blocks of the weight table in which tasks send their updates.
BLOCKS = 64
#: Distinct words that a task counts before it passes them on.
FLUSH_WORDS = 200_000
_START = (7919, 7920, 7921)


def word_class(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % (CLASSES - 1)


class Coder(dict):
    """Class (low 8 bits) and hash of each word, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 2 * FLUSH_WORDS:
            self.clear()
        code = self[word] = zlib.crc32(word) << 8 | word_class(word)
        return code

    def __call__(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        codes = np.array(list(map(self.__getitem__, words)), dtype=np.int64)
        return codes & 255, codes >> 8


def features(classes: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """[token, kind] rows of the weight table for the words of one text and its end."""
    n = len(classes) + 1
    back = np.concatenate([_START, hashes])
    form = np.concatenate([[CLASSES, CLASSES], classes])
    out = np.empty((n, KINDS), dtype=np.int64)
    out[:, 0] = back[2 : 2 + n] % BUCKETS
    out[:, 1] = back[1 : 1 + n] * 31 % BUCKETS + BUCKETS
    out[:, 2] = back[:n] * 131 % BUCKETS + 2 * BUCKETS
    out[:, 3] = (form[1 : 1 + n] * (CLASSES + 1) + form[:n]) % BUCKETS + 3 * BUCKETS
    return out


@dataclass
class Weights:
    bias: np.ndarray
    table: np.ndarray

    def logits(self, rows: np.ndarray) -> np.ndarray:
        z = row_sums(self.table, rows)
        z += self.bias
        return z

    def log10(self, rows: np.ndarray, classes: np.ndarray) -> np.ndarray:
        """log10 P(class | history) of each token."""
        z = self.logits(rows)
        goal, top = z[np.arange(len(z)), classes], z.max(axis=1)
        z -= top[:, None]
        total = np.log(np.exp(z, out=z).sum(axis=1)) + top
        return (goal - total) / math.log(10)


def encoded(texts: list[str | None], coder: Coder) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature rows, classes and number of tokens (with the end) of some texts."""
    return encoded_words([lower_words(text) for text in texts], coder)


def encoded_words(texts: list[list[bytes]], coder: Coder) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same from the words of the texts."""
    rows, classes, sizes = [], [], []
    for words in texts:
        c, h = coder(words)
        rows.append(features(c, h))
        classes.append(np.append(c, END))
        sizes.append(len(c) + 1)
    return np.concatenate(rows), np.concatenate(classes), np.array(sizes)


def held_out(id_col: str) -> F.Column:
    """Fold 1 of 5 by crc32 of the id as text; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 1


def count_words(rows: DataFrame) -> DataFrame:
    """(word, n) over all training texts; tasks count first and exchange their distinct words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = table({"word": pa.array(list(seen), pa.binary()), "n": pa.array(list(seen.values()), pa.int64())})
            seen.clear()
            return out

        for b in batches:
            for text in b.column(0).to_pylist():
                seen.update(lower_words(text))
            if len(seen) > FLUSH_WORDS:
                yield flush()
        yield flush()

    return rows.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def group_sums(z: np.ndarray, order: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sum of the rows z[order[f : f + n]] for each first and size, added in order; faster than reduceat on short rows.

    Groups are taken by falling size, so those that have an r-th row stand in front.
    """
    by = np.argsort(-sizes, kind="stable")
    first, sizes = first[by], sizes[by]
    sums = z.take(order[first], axis=0)
    rounds = min(ROUNDS, int(sizes[0]))
    for r, left in enumerate(np.searchsorted(-sizes, -np.arange(1, rounds)).tolist(), 1):
        sums[:left] += z.take(order[first[:left] + r], axis=0)
    for i in range(int(np.searchsorted(-sizes, -ROUNDS))):
        sums[i] = np.add.reduce(z.take(order[first[i] : first[i] + sizes[i]], axis=0), axis=0)
    out = np.empty_like(sums)
    out[by] = sums
    return out


def row_sums(table: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Sum of the rows of a table named by each row of [n, KINDS]; ``take`` into one buffer is faster than indexing."""
    z = table.take(rows[:, 0], axis=0, mode="clip")
    more = np.empty_like(z)
    for k in range(1, KINDS):
        z += table.take(rows[:, k], axis=0, out=more, mode="clip")
    return z


def train(rows: DataFrame, rate: float = RATE) -> Weights:
    """One pass of gradient updates over all training texts.

    Each task starts from zero, takes AdaGrad steps over the minibatches of its texts, and sends its updates;
    these are averaged, each feature by the number of tokens that each task has seen with it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = KINDS * BUCKETS + 1  # the last row is the bias
        w = np.zeros((size, CLASSES), dtype=np.float32)
        squares = np.full(size, PRIOR, dtype=np.float32)
        seen = np.zeros(size, dtype=np.float64)
        coder = Coder()
        for b in batches:
            rows, classes, _ = encoded(b.column(0).to_pylist(), coder)
            for lo in range(0, len(rows), STEP_TOKENS):
                part, goal = rows[lo : lo + STEP_TOKENS], classes[lo : lo + STEP_TOKENS]
                m = len(part)
                z = row_sums(w, part)
                z += w[-1]
                z -= z.max(axis=1)[:, None]
                np.exp(z, out=z)
                z *= (1 / z.sum(axis=1))[:, None]
                z[np.arange(m), goal] -= 1
                for k in range(KINDS):
                    place = (part[:, k] - k * BUCKETS).astype(np.uint16)  # numpy sorts 16 bits by radix
                    order = np.argsort(place, kind="stable")
                    keys = place[order]
                    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
                    sizes = np.diff(np.append(first, m))
                    g = group_sums(z, order, first, sizes)
                    at = keys[first].astype(np.int64) + k * BUCKETS
                    squares[at] += np.einsum("ij,ij->i", g, g) / CLASSES
                    g *= (rate / np.sqrt(squares[at]))[:, None]
                    w[at] -= g
                    seen[at] += sizes
                g = z.sum(axis=0)
                squares[-1] += (g * g).mean()
                w[-1] -= rate * g / np.sqrt(squares[-1])
                seen[-1] += m
        used = np.flatnonzero(seen)
        for block in range(BLOCKS):
            at = used[used % BLOCKS == block]
            if len(at):
                yield table({"block": pa.array([block]), "at": pa.array([at.tolist()], pa.list_(pa.int64())), "seen": pa.array([seen[at].tolist()], pa.list_(pa.float64())), "w": pa.array([w[at].tobytes()], pa.binary())})

    def merge(group: pa.Table) -> pa.Table:
        total, weight = {}, {}
        for row in group.to_pylist():
            part = np.frombuffer(row["w"], dtype=np.float32).reshape(-1, CLASSES)
            for i, (at, n) in enumerate(zip(row["at"], row["seen"], strict=True)):
                total[at] = total.get(at, 0) + n * part[i].astype(np.float64)
                weight[at] = weight.get(at, 0.0) + n
        ats = sorted(total)
        mean = np.array([total[a] / weight[a] for a in ats], dtype=np.float32)
        return pa.table({"at": pa.array([ats], pa.list_(pa.int64())), "w": pa.array([mean.tobytes()], pa.binary())})

    updates = rows.select("text").mapInArrow(run, "block long, at array<long>, seen array<double>, w binary")
    merged = updates.groupBy("block").applyInArrow(merge, "at array<long>, w binary")
    w = np.zeros((KINDS * BUCKETS + 1, CLASSES), dtype=np.float32)
    for at, part in merged.collect():  # the weight table: its size is fixed
        w[np.array(at)] = np.frombuffer(part, dtype=np.float32).reshape(-1, CLASSES)
    return Weights(w[-1], w[:-1])


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", head_words: int = HEAD_WORDS) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    Word counts cover all training texts. The most frequent words, at most ``head_words``, go to the tasks
    with their counts; tokens of rarer words are added up by text and word and meet their counts in a
    join. Null texts are empty (one token, the end). Repeated rows are scored alike, each in its row; repeated rows of the
    training part count each time. Without any training row all counts are zero and the model is uniform.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).alias("id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    learn = rows.where(~F.col("held_out"))
    counts = materialize(count_words(learn), "lm-counts")
    ends = learn.count()
    classed = F.crc32(F.substring("word", -2, 2)) % (CLASSES - 1)
    by_class = counts.groupBy(classed.alias("c")).agg(F.sum("n"), F.count("*")).collect()  # at most CLASSES rows
    total, kinds = np.zeros(CLASSES), np.zeros(CLASSES)
    for c, n, v in by_class:
        total[c], kinds[c] = n, v
    total[END], kinds[END] = ends, int(ends > 0)
    tokens, vocabulary = int(total.sum()), int(kinds.sum())
    base_rest = math.log10(tokens + 0.5 * (vocabulary + 1))
    class_rest = np.log10(total + 0.5 * (kinds + 1))
    # the smallest count whose words, with all more frequent ones, fit into the head
    ladder = counts.groupBy(F.floor(F.log2("n")).alias("e")).count().orderBy(F.col("e").desc()).collect()
    fit, least = 0, None
    for e, n in ladder:
        if fit + n > head_words:
            break
        fit, least = fit + n, 2**e
    head = {r[0]: r[1] for r in counts.where(F.col("n") >= least).collect()} if least is not None else {}
    head = {bytes(w): math.log10(n + 0.5) for w, n in head.items()}
    sent = spark.sparkContext.broadcast((head, train(learn)))  # bounded by head_words and the weight table's fixed size
    end_log = math.log10(ends + 0.5)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (head, weights), coder = sent.value, Coder()
        for b in batches:
            texts = [lower_words(text) for text in b.column(2).to_pylist()]
            rows, classes, sizes = encoded_words(texts, coder)
            logs = np.concatenate([weights.log10(rows[i : i + STEP_TOKENS], classes[i : i + STEP_TOKENS]) for i in range(0, len(rows), STEP_TOKENS)])
            firsts = np.cumsum(sizes) - sizes
            model = np.add.reduceat(logs - class_rest[classes], firsts)
            known, counted, rare, offsets = [], [], [], [0]
            for words in texts:
                found = list(map(head.get, words))
                if None in found:
                    rare += [w for w, v in zip(words, found, strict=True) if v is None]
                    found = [v for v in found if v is not None]
                offsets.append(len(rare))
                known.append(len(found) + bool(ends))
                counted.append(sum(found) + end_log)
            words = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(rare, pa.binary()))
            yield table({"id": b.column(0), "held_out": b.column(1), "n_tokens": pa.array(sizes.astype(np.int64)), "known": pa.array(known, pa.int64()), "counted": pa.array(counted, pa.float64()), "model": pa.array(model), "rare": words})

    schema = f"id {dict(rows.dtypes)['id']}, held_out boolean, n_tokens long, known long, counted double, model double, rare array<binary>"
    scored = rows.mapInArrow(run, schema).withColumn("at", F.monotonically_increasing_id())
    scored = materialize(scored, "lm-scored")
    rare = scored.select("at", F.explode("rare").alias("word"))
    tail = counts if least is None else counts.where(F.col("n") < least)
    n = F.coalesce("n", F.lit(0))
    looked = rare.join(tail, "word", "left").groupBy("at").agg(
        F.sum(F.log10(n + 0.5)).alias("rare_counted"), F.count_if(n > 0).alias("rare_known")
    )
    joined = scored.drop("rare").join(looked, "at", "left")
    counted = F.col("counted") + F.coalesce("rare_counted", F.lit(0.0))
    return joined.select(
        "id", "held_out", "n_tokens", (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"),
        (counted - F.col("n_tokens") * base_rest).alias("base_score"), (counted + F.col("model")).alias("score"),
    )

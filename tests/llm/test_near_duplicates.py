"""SimHash and line deduplication against brute force."""

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from docloom.llm import line_dedup as ld
from docloom.llm import simhash as sh
from docloom.llm.components import connected_components
from docloom.llm.verify import jaccard, with_texts


def components(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def slow_simhash(text, width=4):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in low).split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", ["", None, "One", "a b c", "A b C d É f g", "x " * 900, "é ß t\x1cu v w x y"])
def test_simhash_definition(text):
    assert sh.simhash(text) == slow_simhash(text)


def test_spark_hash_is_the_same(spark):
    got = spark.range(1).select(F.xxhash64(F.lit("a b c d")).alias("h")).first().h
    assert got % (1 << 64) == xxhash.xxh64_intdigest(b"a b c d", 42)


def test_allocation_covers_every_close_pair(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 150, dtype=np.uint64)
    near = base.copy()
    for i in range(len(near)):
        for b in rng.choice(64, 4, replace=False):
            near[i] ^= np.uint64(1) << np.uint64(b)
    fps = np.unique(np.concatenate([base, near]).view(np.int64))
    frame = spark.createDataFrame([(int(x), int(x)) for x in fps], "node long, fp long")
    got = {r.node: r.root for r in sh.near_components(frame).collect()}
    links = [(i, j) for i in range(len(fps)) for j in range(i) if int(np.bitwise_count(np.uint64(int(fps[i]) % (1 << 64)) ^ np.uint64(int(fps[j]) % (1 << 64)))) <= 4]
    assert len(links) >= 150
    want = components(len(fps), links)
    assert [got[int(x)] for x in fps] == [int(fps[w]) for w in want]


EDGE = [(1, "same words here now ok"), (2, "same words here now ok"), (3, None), (4, ""), (5, " \n"), (None, "same words here now ok"), (2, "same words here now ok"), (9, "entirely different words in this one " * 400)]


def test_near_duplicates_edges(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in EDGE], "doc_id long, text string, fp string")
    got = [(r.id, r.component_id) for r in sh.near_duplicates(docs).collect()]
    assert sorted(got, key=repr) == sorted([(1, 1), (2, 1), (2, 1), (None, 1), (3, 3), (4, 3), (5, 3), (9, 9)], key=repr)
    assert sh.near_duplicates(docs.limit(0)).count() == 0


def test_keep_one_edges(spark):
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in EDGE], "doc_id long, text string, row string, version string")
    kept = sh.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted([r.doc_id for r in kept.collect()], key=repr) == sorted([1, 3, 9, None], key=repr)
    assert sh.keep_one(docs.limit(0)).count() == 0


def test_keep_one_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.orderBy("doc_id").collect()
    sets = [sh.word_shingles(r.text) for r in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if jaccard(sets[i], sets[j]) >= 0.8]
    want = {rows[i].doc_id for i, c in enumerate(components(len(rows), links)) if c == i}
    got = {r.doc_id for r in sh.keep_one(docs).collect()}
    assert got == want


def test_set_prints_follow_the_sets():
    text = "the old house by the river had nine windows and a red door that nobody used"
    twice = f"{text} {text}"
    assert sh.set_prints(twice) == sh.set_prints(f"{twice} {twice} {text}".upper())
    assert sh.set_prints(None) == sh.set_prints(" \n") == (0, 0, 0)
    assert sh.set_prints("one two")[2] == 1
    rng = np.random.default_rng(8)
    caught = 0
    for _ in range(200):
        words = rng.integers(0, 1 << 40, 220).astype(str).tolist()
        other = list(words)
        for at in rng.choice(44, 5, replace=False) * 5:
            other[at] = "changed"
        a, b = " ".join(words), " ".join(other)
        assert 0.78 < jaccard(sh.word_shingles(a), sh.word_shingles(b)) < 0.84
        caught += int(np.bitwise_count(np.uint64(sh.set_prints(a)[0] ^ sh.set_prints(b)[0]))) <= 14
    assert caught >= 180


def test_nodes_with_one_fingerprint_are_judged_like_any_others(spark):
    nodes = spark.createDataFrame([(i, 7) for i in range(9)], "node long, fp long")
    some = lambda pairs: pairs.where("u % 3 = v % 3")
    got = {r.node: r.root for r in sh.near_components(nodes, 4, some).collect()}
    assert got == {i: i % 3 for i in range(9)}


@pytest.mark.parametrize("probes", [1 << 27, 500])
def test_nodes_meet_those_of_neighbouring_classes_in_turns(spark, monkeypatch, probes):
    monkeypatch.setattr(sh, "PROBES", probes)
    monkeypatch.setattr(sh, "PROBES_SHARE", 0)
    rng = np.random.default_rng(21)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    fps = np.concatenate([base ^ (np.uint64(1) << np.uint64(b)) for b in range(5)]).view(np.int64)
    classes = rng.integers(0, 6, len(fps))
    frame = spark.createDataFrame([(i, int(x), int(c)) for i, (x, c) in enumerate(zip(fps, classes, strict=True))], "node long, fp long, class long")
    links = [(i, j) for i in range(len(fps)) for j in range(i) if i % 60 == j % 60 and abs(classes[i] - classes[j]) <= 1]
    want = components(len(fps), links)
    assert len(set(want)) > 60
    assert (sh.slices_of(len(fps), sh.choose_parts(100, 4), 4, 0) > 1) == (probes == 500)
    got = {r.node: r.root for r in sh.near_components(frame).collect()}
    assert [got[i] for i in range(len(fps))] == want
    got = {r.node: r.root for r in sh.near_components(frame, 4, lambda pairs: pairs.distinct()).collect()}
    assert [got[i] for i in range(len(fps))] == want


def test_similar_sets_lie_in_neighbouring_classes(spark):
    sizes = spark.range(0, 3000).select(F.col("id").alias("n"), sh.size_class(F.col("id"), 0.8).alias("c"), sh.size_class(F.ceil(F.col("id") * 0.8 - 1e-9), 0.8).alias("low"))
    rows = sizes.collect()
    assert all(0 <= r.c - r.low <= 1 for r in rows)
    assert max(r.c for r in rows) > 30


def test_probes_of_a_text_do_not_grow_with_the_table():
    # 0.11 of the texts lie in a class of sizes and the one below; 2.65 million texts are some 6 GB, 13 million 30 GB
    for n in (226_000, 2_650_000, 13_000_000):
        parts = sh.choose_parts(int(0.11 * n), 13)
        assert sh.probes_of(parts, 13) <= 100
        turns = sh.slices_of(n, parts, 13, n * parts * 2)
        assert n * sh.probes_of(parts, 13) / turns <= max(1 << 27, 60 * n)


def test_components_of_paths_and_cliques(spark):
    path = [(i, i + 1) for i in range(100, 160)]
    clique = [(i, j) for i in range(20) for j in range(i)]
    frame = spark.createDataFrame([*path, *clique, (5, 5)], "u long, v long").repartition(7)
    got = {r.node: r.component for r in connected_components(frame).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, **{i: 0 for i in range(20)}}
    assert connected_components(frame.limit(0)).count() == 0


def test_open_pairs_miss_nothing_around_a_hub(spark):
    rng = np.random.default_rng(5)
    hub = "".join(rng.choice(list("abcdefgh"), 90))
    lines = [hub]
    for _ in range(140):
        # changed, cut or grown copies, and changed copies of those
        at, n = int(rng.integers(0, 80)), int(rng.integers(1, 9))
        old = lines[int(rng.integers(0, len(lines)))]
        new = "".join(rng.choice(list("abcdefghxyz"), int(rng.integers(0, 9))))
        lines.append(old[:at] + new + old[at + n :])
    lines = sorted(set(lines) - {hub})
    texts = spark.createDataFrame(list(enumerate([hub, *lines])), "node long, text string")
    spokes = spark.createDataFrame([(0, i + 1) for i in range(len(lines))], "hub long, node long")
    kind = "hub long, node long, near boolean, size int, more array<string>, less array<string>"
    stars = with_texts(spokes, texts).mapInArrow(ld._deltas, kind).cache()
    # nothing is united yet but what is similar to the hub
    roots = stars.where("near").select("node", F.lit(0).cast("long").alias("component"))
    found = {(r.u, r.v) for r in ld.open_pairs(stars, roots).collect()}
    sets = [ld.shingles(x) for x in [hub, *lines]]
    near = [jaccard(sets[0], s) >= 0.8 for s in sets]
    apart = [(i, j) for j in range(1, len(sets)) for i in range(1, j) if not (near[i] and near[j])]
    true = {(i, j) for i, j in apart if jaccard(sets[i], sets[j]) >= 0.8}
    assert len(true) > 50
    assert true <= found
    assert len(found) < len(apart) / 3


def test_band_recall_of_pairs_at_the_threshold():
    rng = np.random.default_rng(6)
    met = total = 0
    for _ in range(400):
        line = "".join(rng.choice(list("abcdefghijkl "), 300))
        at = int(rng.integers(0, 250))
        other = line[:at] + "".join(rng.choice(list("mnopqrs"), 28)) + line[at + 28 :]
        if jaccard(ld.shingles(line), ld.shingles(other)) >= 0.8:
            keys = ld.band_keys([line, other])
            met, total = met + bool((keys[0] == keys[1]).any()), total + 1
    assert total > 300
    assert met >= 0.9 * total


def test_normal_lines():
    cases = ["", " ", "A b", "A  b", " a b", "a b ", "a\tb", "a\u00a0b", "\u3000a", "a\u200bb  c", "É x", "a\x1cb", "x\r", "one two  "]
    assert [ld.normal(x) for x in cases] == [" ".join(x.lower().split()) for x in cases]


def test_folded_keys_show_every_shared_bucket():
    texts = ["one line\nanother line of words\nanother line of wordz", "another line of words\none line", None]
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array([1, 2, 3]), pa.array(texts)], names=["doc", "version", "text"])
    rows = [r for b in ld._banded(iter([batch])) for r in b.to_pylist()]
    lines = {ld.normal(x) for t in texts if t for x in t.split("\n")}
    whole = {}
    for line in lines:
        for key in ld.band_keys([line])[0].tolist():
            whole.setdefault(key, set()).add(ld.short(line))
    for key, ids in whole.items():
        mine = [r for r in rows if r["key"] == key]
        assert {r["id"] % 2**64 for r in mine} == ids
        assert len({r["id"] for r in mine if r["salt"] == 0}) == min(2, len(ids))


def brute_lines(rows):
    lines = [(i, k, ld.normal(x)) for i, t in rows for k, x in enumerate((t or "").split("\n")) if ld.normal(x)]
    texts = sorted({x for _, _, x in lines})
    sets = [ld.shingles(x) for x in texts]
    links = [(i, j) for i in range(len(texts)) for j in range(i) if min(len(sets[i]), len(sets[j])) >= 0.8 * max(len(sets[i]), len(sets[j])) and jaccard(sets[i], sets[j]) >= 0.8]
    label = dict(zip(texts, components(len(texts), links), strict=True))
    seen, gone = set(), set()
    for i, k, x in lines:
        if label[x] in seen:
            gone.add((i, k))
        seen.add(label[x])
    return {i: "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone) for i, t in rows if t is not None}


def test_lines_equal_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(120)
    docs = docs.cache()
    rows = [(r.doc_id, r.text) for r in docs.orderBy("doc_id").collect()]
    got = {r.doc_id: r.text for r in ld.dedup_lines(docs).collect()}
    assert got == brute_lines(rows)


def test_lines_edges(spark):
    rows = [(1, "Alpha beta gamma delta\n\nshort\nshort"), (2, "alpha  beta gamma delta\nshort"), (3, None), (4, ""), (5, "\n"), (2, "alpha  beta gamma delta\nshort"), (None, "lonely line of words")]
    docs = spark.createDataFrame([(i, t, 7, 8, 9) for i, t in rows], "doc_id long, text string, lines_dropped int, row int, version int")
    got = ld.dedup_lines(docs)
    assert [c for c in got.columns if c != "lines_dropped"] == ["doc_id", "text", "row", "version"]
    want = [(1, "Alpha beta gamma delta\n\nshort"), (2, ""), (2, ""), (3, None), (4, ""), (5, "\n"), (None, "lonely line of words")]
    assert sorted([(r.doc_id, r.text) for r in got.collect()], key=repr) == sorted(want, key=repr)
    kept = {r.doc_id for r in ld.dedup_lines(docs, drop_emptied=True).collect()}
    assert kept == {1, 3, 4, 5, None}
    assert ld.dedup_lines(docs.limit(0)).count() == 0


SPACED = ["", "A b", " A", "a ", "a  b", "a\n", "\n", "a \n b\nC", "a\tb", "x\x85y", "Ένας ΟΔΟΣ\nΣ", "İI\u3000ß", "a\r\nb", "\u2028"]


@pytest.mark.parametrize("text", SPACED)
def test_lines_of_a_text_are_normalised_like_single_lines(text):
    assert ld.normal_lines(text) == [ld.normal(line) for line in text.split("\n")]


def test_all_white_space_is_known():
    assert {" ", "\n", *ld._SPACES} == {c for c in map(chr, range(0x110000)) if c.isspace()}
    assert {c for c in ld._SPACES if c.isascii()} == set(ld._ASCII_SPACES)


def test_difference_from_a_hub_equals_that_of_the_sets():
    rng = np.random.default_rng(11)
    for letters in ("ab", "abcdefgh ", "aé\u0fff", "a\u1000漢", "a😀"):
        for _ in range(60):
            hub, line = ("".join(rng.choice(list(letters), rng.integers(1, 40))) for _ in range(2))
            more, less, size = ld.difference(hub, line, ld.numbered_shingles(hub))
            a, b = ld.shingles(hub), ld.shingles(line)
            assert (sorted(more), sorted(less), size) == (sorted(b - a), sorted(a - b), len(b))


def test_band_keys_are_sent_by_range_and_meet(spark, monkeypatch):
    rng = np.random.default_rng(12)
    monkeypatch.setattr(ld, "RANGE_BITS", 4)
    common = ["one line that is in many of the texts"] * 3 + ["one line that is in many of the texts!"] * 2
    lines = ["".join(rng.choice(list("abcdefgh "), 40)).strip() for _ in range(400)] + common
    texts = ["\n".join(rng.choice(lines, 6).tolist()) for _ in range(300)] + ["", None, "\n \n"]
    rows = spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "doc long, version long, text string").repartition(5)
    distinct = sorted({x for t in texts if t for x in ld.normal_lines(t) if x})
    buckets = {}
    for line, keys in zip(distinct, ld.band_keys(distinct).tolist(), strict=True):
        for key in keys:
            buckets.setdefault(key, set()).add(int(np.uint64(ld.short(line)).view(np.int64)))
    want = {(k, i) for k, ids in buckets.items() if len(ids) > 1 for i in ids}
    got = [(r.key, r.id) for r in ld.candidate_buckets(rows).collect()]
    assert len(got) == len(set(got))
    assert set(got) == want and want
    # a task sends a row for each range and piece, not for each line and band
    batch = pa.RecordBatch.from_pydict({"doc": list(range(300)), "version": [0] * 300, "text": texts[:300]})
    assert sum(b.num_rows for b in ld._banded(iter([batch]))) <= 17


def test_band_keys_meet_over_several_looks(monkeypatch):
    monkeypatch.setattr(ld, "FULL", 1)
    raw = lambda *x: np.array(x, dtype=np.int64).tobytes()
    rows = [(0, False, raw(5, 6), raw(1, 2)), (0, False, raw(5, 6), raw(3, 2)), (1, False, raw(9), raw(4)), (1, True, raw(8, 8), raw(7, 6)), (1, False, raw(9), raw(5)), (2, False, raw(11), raw(1))]
    batches = [pa.RecordBatch.from_arrays([pa.array([r[k]]) for k in range(4)], names=["part", "shared", "keys", "ids"]) for r in rows]
    got = {(r["key"], r["id"]) for b in ld._met(iter(batches)) for r in b.to_pylist()}
    assert got == {(5, 1), (5, 3), (9, 4), (9, 5), (8, 7), (8, 6)}


def test_numbers_tell_the_same_difference_from_a_hub():
    rng = np.random.default_rng(13)
    for letters in ("ab", "abcdefgh ", "aé\u0fff", "ab\u1000漢", "a😀"):
        for _ in range(60):
            hub, line = ("".join(rng.choice(list(letters), rng.integers(1, 40))) for _ in range(2))
            more, less, size = ld.numbered_difference(hub, line, ld.numbered_shingles(hub))
            want = ld.difference(hub, line, None)
            assert [sorted(x.tolist()) for x in (more, less)] == [sorted(map(ld._shingle_number, x)) for x in want[:2]]
            assert size == want[2] and len({*more.tolist(), *less.tolist()}) == len(more) + len(less)


def test_few_nodes_around_a_hub_give_only_similar_pairs(spark, monkeypatch):
    monkeypatch.setattr(ld, "COLUMNS", 7)
    monkeypatch.setattr(ld, "FEW", 19)
    rng = np.random.default_rng(14)
    texts, spokes = {}, []
    for hub in range(0, 400, 20):
        texts[hub] = "".join(rng.choice(list("abcdefgh" if hub % 40 else "abé漢"), 90))
        for node in range(hub + 1, hub + 20):
            at, n, old = int(rng.integers(0, 80)), int(rng.integers(1, 9)), texts[int(rng.integers(hub, node))]
            texts[node] = old[:at] + "".join(rng.choice(list("abxyz"), int(rng.integers(0, 9)))) + old[at + n :]
            spokes.append((hub, node))
    frame = spark.createDataFrame(list(texts.items()), "node long, text string")
    kind = "hub long, node long, near boolean, size int, more array<long>, less array<long>"
    stars = with_texts(spark.createDataFrame(spokes, "hub long, node long"), frame).mapInArrow(ld._numbered_deltas, kind).cache()
    roots = stars.where("near").select("node", F.col("hub").alias("component"))
    found = {(r.u, r.v) for r in ld.open_pairs(stars, roots).collect()}
    sets = {k: ld.shingles(x) for k, x in texts.items()}
    root = {k: k // 20 * 20 if jaccard(sets[k], sets[k // 20 * 20]) >= 0.8 else k for k in texts}
    want = {(i, j) for h, j in spokes for i in range(h + 1, j) if root[i] != root[j] and jaccard(sets[i], sets[j]) >= 0.8}
    assert found == want and len(want) > 50


@pytest.mark.parametrize("remembered", [500_000, 40])
def test_only_lines_that_may_repeat_are_told_by_place(spark, monkeypatch, remembered):
    monkeypatch.setattr(ld, "SEEN_LINES", remembered)
    rng = np.random.default_rng(15)
    line = lambda: "".join(rng.choice(list("abcdefgh "), 60)).strip()
    common = [line() for _ in range(40)]
    common += [x + "!" for x in common[:10]]
    texts = ["\n".join([*(line() for _ in range(5)), *([rng.choice(common)] * (i % 3))]) for i in range(300)]
    rows = spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "doc long, version long, text string").repartition(5)
    components, finds = ld.line_components(rows)
    got = {(r.doc, r.pos): r.digest for r in finds.collect()}
    places = {(i, k): ld.digest(ld.normal(x)) for i, t in enumerate(texts) for k, x in enumerate(t.split("\n"))}
    times = {}
    for d in places.values():
        times[d] = times.get(d, 0) + 1
    near = {bytes(r.node) for r in components.collect()}
    wanted = {at: d for at, d in places.items() if times[d] > 1 or d in near}
    assert wanted.items() <= got.items() <= places.items()
    assert len(got) < len(wanted) + 0.1 * len(places)

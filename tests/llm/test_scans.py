"""Decontamination, language, secrets, token counts and archives on small cases."""

import base64
import bz2
import gzip
import lzma
import random
import time
import zlib
from urllib.parse import quote

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm import decontaminate as dc
from docloom.llm import hd_langid as hd
from docloom.llm import secret_scan as ss
from docloom.llm import token_count as tc
from docloom.llm import warc


def brute_leaks(text, items):
    words = dc.words(text)
    hit, found = set(), set()
    for item, t in items:
        seq = dc.words(t)
        for i in range(max(1, len(seq) - 9) if seq else 0):
            win = seq[i : i + 10]
            for p in range(len(words) - len(win) + 1):
                if words[p : p + len(win)] == win:
                    hit.update(range(p, p + len(win)))
                    found.add(item)
    return len(words), len(hit), sorted(found)


def test_leaks_equal_brute_force():
    rng = random.Random(3)
    letters = "abcd"
    items = [(str(i), " ".join(rng.choices(letters, k=rng.choice([1, 3, 10, 14])))) for i in range(9)] + [("e", "")]
    matcher = dc.Matcher(items)
    for _ in range(40):
        text = ", ".join(rng.choices([*letters, "É"], k=60))
        ranges, found = matcher.scan(dc.words(text))
        got = (len(dc.words(text)), sum(e - s for s, e in dc.merge(ranges)), sorted(found))
        assert got == brute_leaks(text, items)


@pytest.mark.parametrize("shard_bytes", [10**6, 40])
def test_leak_edges(spark, shard_bytes):
    item = "one two three four five six seven eight nine ten eleven"
    bench = spark.createDataFrame([(1, item), (2, "Solo-word pair"), (None, "hidden thing here"), (3, None), (1, item)], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"x {item.upper()}! y"), (2, "a solo, WORD; pair b"), (3, None), (4, ""), (5, "the hidden thing here"), (None, "x" * 50_000)], "doc_id long, text string")
    got = {r.id: r for r in dc.contamination(docs, bench, shard_bytes=shard_bytes).collect()}
    assert (got[1].n_words, got[1].n_hit, got[1]["items"]) == (13, 11, ["1"])
    assert [(s.start, s.end) for s in got[1].spans] == [(2, 2 + len(item))]
    assert (got[2].n_hit, got[2]["items"]) == (3, ["2"])
    assert (got[3].n_words, got[4].n_words, got[None].n_words) == (0, 0, 1)
    assert (got[5].n_hit, got[5]["items"]) == (3, [])
    kept = dc.decontaminate(docs.withColumn("items", F.lit(1)), bench)
    assert kept.columns == ["doc_id", "text", "items"]
    assert {r.doc_id for r in kept.collect()} == {3, 4, None}


def test_language_of_held_out_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = hd.identify(docs).withColumnRenamed("doc_id", "id").join(docs, F.col("id") == docs.doc_id).where("held_out AND n_chars >= 40").collect()
    assert len(got) > 20
    assert sum(r.lang == r.lang_pred for r in got) / len(got) >= 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_language_edges(spark):
    rows = [(1, "the thing and the other thing", "en", 1.0), (3, None, "en", 1.0), (4, "123 !?", None, 1.0), (5, "𝒳" * 3, None, 1.0), (6, "l'été à la plage était chaud", "fr", 1.0), (8, "the and of it", None, 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    prototypes = hd.train(docs)
    assert list(prototypes) == ["en", "fr"]
    got = {r.doc_id: (r.lang_pred, r.score) for r in hd.predict(docs, prototypes).collect()}
    assert got[1][0] == "en" and got[6][0] == "fr" and got[8][0] == "en"
    assert got[3] == got[4] == ("und", 0.0)
    assert {r.lang_pred for r in hd.predict(docs, {}).collect()} == {"und"}


def test_binding_is_linear():
    a, b = hd.profile("hello world"), hd.profile("salut")
    both = hd.profile("hello world salut")
    assert (a * b).sum() < (a * a).sum()
    assert both.shape == (hd.DIM,)


SECRET = "my password: hunter2hunter2 ok"


@pytest.mark.parametrize(
    "wrap",
    [
        lambda s: base64.b64encode(s.encode()).decode(),
        lambda s: base64.urlsafe_b64encode(gzip.compress(s.encode())).decode(),
        lambda s: quote(base64.b64encode(base64.b64encode(s.encode())).decode(), safe=""),
        lambda s: "".join(f"\\u{ord(c):04x}" for c in s),
        lambda s: "".join(f"%{b:02X}" for b in s.encode()),
    ],
)
def test_wrapped_secrets_are_found_where_they_stand(wrap):
    text = f"before é {wrap(SECRET)} after"
    base, spans = ss.scan(text)
    assert base == []
    begin = text.index(wrap(SECRET))
    whole = begin + len(wrap(SECRET))
    assert {k for _, _, k in spans} == {"assign"}
    for start, end, _ in spans:
        assert begin <= start < end <= whole
    # escapes and base64 are traced to the characters that hold the secret, compressed content to its whole range
    inner, value = SECRET.index("password"), len("password: hunter2hunter2")
    if wrap("a") in ("%61", "\\u0061"):
        each = len(wrap("a"))
        assert spans == [(begin + each * inner, begin + each * (inner + value), "assign")]
    elif not wrap(SECRET).startswith("H4sI") and "%" not in wrap(SECRET):
        assert base64.b64decode(wrap(SECRET)[(spans[0][0] - begin) // 4 * 4 : -(-(spans[0][1] - begin) // 4) * 4]).strip().startswith(b"password") or spans[0][1] - spans[0][0] < whole - begin


@pytest.mark.parametrize("odd", [b"\x0c", b"\x1b", b"\x00", b"\xff", "\u00a0".encode(), "\u3000".encode(), "\u200b".encode(), "\ufeff".encode()])
def test_odd_characters_hide_no_secret(odd):
    raw = odd + b" " + SECRET.encode() + b" " + odd
    for layer in (base64.b64encode(raw).decode(), "".join(f"%{b:02X}" for b in raw)):
        (start, end, kind), = ss.scan(f"x {layer} y")[1]
        assert kind == "assign"
        assert 2 < start < end < 2 + len(layer)
        assert end - start in (3 * 24, 32, 33, 34)


@pytest.mark.parametrize("text", ["password%3A hunter2hunter2", "\\u0070assword: hunter2hunter2", r"pass\u0077ord: \"hunter2\x68unter2", "a=%ff%70assword%3Dhunter2hunter2 b"])
def test_partly_encoded_secrets(text):
    assert [k for _, _, k in ss.scan(text)[1]] == ["assign"]


@pytest.mark.parametrize("front", ["x-", "path_", "https://host/", "word", "ab", "abc", "+"])
def test_base64_behind_anything(front):
    for raw in (SECRET.encode(), gzip.compress(SECRET.encode()), zlib.compress(SECRET.encode())):
        text = f"see {front}{base64.b64encode(raw).decode()}"
        assert {k for _, _, k in ss.scan(text)[1]} == {"assign"}


def test_members_large_layers_and_long_runs():
    two = gzip.compress(b"nothing") + gzip.compress(SECRET.encode())
    assert ss.scan("v " + base64.b64encode(two).decode())[1]
    for secret_first in (True, False):
        filler = b"lorem ipsum " * 3_000_000
        raw = SECRET.encode() + filler if secret_first else filler + SECRET.encode()
        layer = base64.b64encode(gzip.compress(gzip.compress(raw, 1), 1)).decode()
        assert {k for _, _, k in ss.scan(f"v {layer}")[1]} == {"assign"}
    noise = np.random.default_rng(3).integers(0, 256, 700_000, dtype=np.uint8).tobytes()
    long = base64.b64encode(noise).decode() + "%41" + "a" * 1_000_000 + "\\u0041" + SECRET
    began = time.process_time()
    spans = ss.scan(long)[1]
    assert time.process_time() - began < 20
    assert any(k == "assign" for _, _, k in spans)


def test_scan_equals_brute_force_on_single_layers():
    rng = np.random.default_rng(4)
    for _ in range(60):
        front = "".join(rng.choice(list("ab cd-_/"), 12))
        lead = "".join(rng.choice(list("xyz "), int(rng.integers(0, 5))))
        raw = f"{lead}token={''.join(rng.choice(list('abcdef123'), 9))} "
        text = front + base64.b64encode(raw.encode()).decode() + " tail"
        run = max(text.split(" "), key=len)
        want = set()
        for k in range(4):
            cut = run[k:].replace("-", "+").replace("_", "/").rstrip("=")
            cut = cut[: len(cut) - (len(cut) % 4 == 1)]
            inner = base64.b64decode(cut + "=" * (-len(cut) % 4)).decode("latin-1")
            want |= {k2 for _, _, k2 in ss.direct(inner)}
        got = {k2 for _, _, k2 in ss.scan(text)[1]}
        assert want <= got


PLAIN = "x password: hunter2hunter2 y"


def zlibbed(s, bits):
    c = zlib.compressobj(9, zlib.DEFLATED, bits)
    return c.compress(s) + c.flush()


def lines_of(s, n=40, end="\n"):
    return end.join(s[i : i + n] for i in range(0, len(s), n))


@pytest.mark.parametrize(
    "wrap",
    [
        lambda s: base64.b64encode(s.encode("utf-16-le")).decode(),
        lambda s: base64.b64encode(s.encode("utf-16")).decode(),
        lambda s: base64.b64encode(s.encode("utf-16-be")).decode(),
        lambda s: lines_of(base64.b64encode(s.encode() * 3).decode()),
        lambda s: lines_of(base64.b64encode(gzip.compress(s.encode() * 3)).decode(), end="\r\n  "),
        lambda s: lines_of(base64.b64encode(s.encode() * 3).decode(), end="\\n"),
        lambda s: base64.b64encode(bz2.compress(s.encode())).decode(),
        lambda s: base64.b64encode(lzma.compress(s.encode())).decode(),
        *[lambda s, b=b: base64.b64encode(zlibbed(s.encode(), b)).decode() for b in range(9, 16)],
        lambda s: base64.b64encode(zlibbed(s.encode(), -15)).decode(),
        lambda s: "".join(f"%u{ord(c):04x}" for c in s),
        lambda s: "".join(f"\\u{{{ord(c):x}}}" for c in s),
        lambda s: "".join(f"\\u{{0000{ord(c):x}}}" for c in s),
        lambda s: "".join(f"\\U{ord(c):08X}" for c in s),
        lambda s: "".join(f"%5cu{ord(c):04x}" for c in s),
        lambda s: "".join(f"\\u0025{ord(c):02x}" for c in s),
    ],
)
def test_less_common_layers(wrap):
    for times in (1, 2):
        layer = wrap(PLAIN) if times == 1 else base64.b64encode(wrap(PLAIN).encode()).decode()
        text = f"é see: {layer} :end"
        spans = [(s, e) for s, e, k in ss.scan(text)[1] if k == "assign"]
        assert spans
        for s, e in spans:
            assert text.index(layer) <= s < e <= text.index(layer) + len(layer)


def test_deeply_nested_escapes():
    took = {}
    for n in (1_100, 10_000, 100_000):
        for kind, text in enumerate(("%" + "25" * n + "70assword=hunter2hunter2", "\\" + "u005c" * n + "u0070assword=hunter2hunter2", "%" + "5cu0025" * (n // 5) + "70assword=hunter2hunter2")):
            began = time.process_time()
            spans = ss.scan(text)[1]
            took[n, kind] = time.process_time() - began
            assert (0, len(text), "assign") in spans
    for kind in range(3):
        assert took[100_000, kind] < 30 * took[10_000, kind] + 0.5  # in proportion


def test_unwinding_ends_where_single_steps_end():
    rng = random.Random(8)
    for _ in range(400):
        text = "".join(rng.choice(["%", "2", "5", "41", "%25", "g", "é", "%2", "5%"]) for _ in range(rng.randrange(30)))
        want = text
        while (made := ss.unescaped(want, ss._ESCAPE, ss.Origin())) is not None:
            want = made[0]
        got, origin = ss.unwound(text, ss.Origin())
        assert got == want
        if got:
            assert origin.span(0, len(got)) == (0, len(text))
            for i, c in enumerate(got):  # what was kept stands for itself
                a, b = origin.span(i, i + 1)
                assert b - a > 1 or text[a] == c


def test_every_level_of_escapes_is_looked_at(monkeypatch):
    text = "%" + "25" * 8 + "41" + "a" * 22 + ", token=" + "%" + "25" * 9 + "5cu0041 end"
    assert (17, 41, "hex") in ss.scan(text)[1]  # the level after has 22 digits left

    def plain(text, origin, found):
        while made := ss.unescaped(text, ss._ESCAPE, origin):
            yield made
            text, origin = made

    rng = random.Random(3)
    ends = ["41KIA" + "Z" * 16, "41" + "a" * 24, "70assword=hunter2hunter2", "secret%3dabcdefgh", base64.b64encode(PLAIN.encode()).decode(), base64.b64encode(zlibbed(b"token=abcdefgh", -15)).decode(), "\n" + "ab" * 20 + "\n" + "00" * 9, "\\\\x41", "x^abc", "{41}", "5"]
    codes = [["25"], ["u005c"], ["5cu0025"], ["25", "5cu0025"], ["u{5c}"], ["x5c"], ["u0025"]]
    passed = 0
    for _ in range(150):
        text = ""
        for _ in range(rng.randrange(1, 4)):
            code = rng.choice(codes)
            text += rng.choice(["", " and more words than that; "]) + ("%" if code[0][0] in "25" else "\\") + "".join(rng.choice(code) for _ in range(rng.randrange(1, 90))) + rng.choice(ends)
        whole, seen = ss.chained, []
        monkeypatch.setattr(ss, "chained", lambda t, o, f: seen.append((t, got := whole(t, o, f))) or got)
        got = ss.scan(text)
        monkeypatch.undo()
        passed += any(a != b for a, (b, _) in seen)
        monkeypatch.setattr(ss, "levels", plain)
        assert got == ss.scan(text), text
        monkeypatch.undo()
    assert passed > 20  # levels were passed over in these


def test_layers_nest_in_any_order():
    rng = random.Random(9)
    wraps = [
        lambda b: base64.b64encode(b), lambda b: base64.urlsafe_b64encode(gzip.compress(b)), lambda b: base64.b64encode(zlibbed(b, 10)), lambda b: "".join(f"%{x:02x}" for x in b).encode(),
        lambda b: "".join(f"\\u{x:04x}" for x in b).encode(), lambda b: base64.b64encode(bz2.compress(b)), lambda b: lines_of(base64.b64encode(b).decode(), 76).encode(), lambda b: quote(b.decode("latin-1"), safe="").encode(),
    ]
    for _ in range(120):
        layer = PLAIN.encode()
        for _ in range(rng.randrange(1, 5)):
            layer = b"a: " + rng.choice(wraps)(layer) + b" b"
        text = layer.decode()
        assert any(k == "assign" for _, _, k in ss.scan(text)[1]), text[:200]


def test_layers_larger_than_a_window(monkeypatch):
    monkeypatch.setattr(ss, "WINDOW", 1 << 16)
    monkeypatch.setattr(ss, "OVERLAP", 1 << 13)
    noise = base64.b64encode(np.random.default_rng(3).integers(0, 256, 60_000, dtype=np.uint8).tobytes())
    inner = base64.b64encode(gzip.compress(noise + b" " + PLAIN.encode() + b" " + noise))
    for content in (inner, b"some words first, value=" + inner + b", and words after it", base64.b64encode(gzip.compress(noise + b"," + inner))):
        layer = base64.b64encode(gzip.compress(content, 1)).decode()
        assert {k for _, _, k in ss.scan(f"v {layer}")[1]} == {"assign"}


def test_secret_spans_edges(spark):
    rows = [(1, "token = abcdefgh"), (1, "token = abcdefgh"), (None, "x"), (3, None), (4, ""), (5, "lorem " * 50_000 + "AKIA" + "A" * 16)]
    docs = spark.createDataFrame([(i, t, "q", "r") for i, t in rows], "doc_id long, text string, base string, spans string")
    got = [(r.id, len(r.base), len(r.spans)) for r in ss.secret_spans(docs).collect()]
    assert sorted(got, key=repr) == sorted([(1, 1, 1), (1, 1, 1), (None, 0, 0), (3, 0, 0), (4, 0, 0), (5, 1, 1)], key=repr)
    assert ss.secret_spans(docs.limit(0)).count() == 0


def test_deeply_compressed_secrets():
    raw = SECRET.encode()
    for _ in range(12):
        raw = gzip.compress(raw)
    layer = base64.b64encode(raw).decode()
    assert ss.scan(f"x {layer} y")[1] == [(2, 2 + len(layer), "assign")]


def test_plain_secrets():
    text = "Token = abcde; SECRET:'abcdef' token=token=abcdefgh AKIA" + "A1" * 8 + " AKIASHORT " + "0f" * 12 + " deadbeef"
    base, spans = ss.scan(text)
    assert [(text[s:e], k) for s, e, k in base] == [("SECRET:'abcdef", "assign"), ("token=token=abcdefgh", "assign"), ("AKIA" + "A1" * 8, "access"), ("0f" * 12, "hex")]
    assert set(base) <= set(spans)
    assert ss.scan("secret: token = abcdefgh")[0] == []  # the first match takes its value and fails
    assert ss.scan(None) == ss.scan("") == ([], [])


def test_redaction(spark):
    docs = spark.createDataFrame([(1, "token=abcdefgh x"), (2, None), (3, "")], "doc_id long, text string")
    assert {r.id: r.text for r in ss.redact(docs).collect()} == {1: "[SECRET] x", 2: None, 3: ""}


@pytest.fixture(scope="module")
def vocabulary():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


def test_spliced_counts_are_exact(vocabulary, sf):
    import duckdb

    counter = tc.Counter(vocabulary)
    texts = [t for (t,) in duckdb.sql(f"SELECT text FROM '{sf}/documents.parquet'").fetchall()]
    texts += ["", " ", "  a  b\n c ", "x <|endoftext|> y", "é" * 900, "ab  cd\t ef\n gh " * 300, "word" * 500, "<|endoftext|>" * 90, "a  b  c" * 99]
    want = [len(e.ids) for e in counter.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert counter.counts(texts) == want
    assert [tc.spliced_count(counter.tokenizer, t, 120, 8) for t in texts] == want


def test_token_edges(spark, vocabulary):
    docs = spark.createDataFrame([(1, None), (2, "é a"), (None, "x" * 40_000), (2, "é a")], "doc_id long, text string")
    got = sorted([(r.id, r.n_bytes, r.over_limit) for r in tc.token_counts(docs, vocabulary).collect()], key=repr)
    assert got == sorted([(1, 0, False), (2, 4, False), (2, 4, False), (None, 40_000, True)], key=repr)
    assert tc.token_counts(docs.limit(0), vocabulary).count() == 0


def test_huge_texts_are_counted_in_linear_time(vocabulary):
    counter = tc.Counter(vocabulary)
    rng = random.Random(1)
    signs = [chr(c) for c in range(0x4E00, 0x4F00)]
    chinese = "".join(rng.choice(signs) + ("。" if rng.random() < 0.05 else "") for _ in range(150_000))
    lines = "\n".join(f"word{rng.randrange(999)}" for _ in range(60_000))
    unbroken = "".join(rng.choice("abcdefgh") for _ in range(70_000))
    for text, times in ((chinese, 3), (lines, 3), (unbroken, 20)):
        began = time.process_time()
        want = len(counter.tokenizer.encode(text, add_special_tokens=False).ids)
        plain = time.process_time() - began
        began = time.process_time()
        assert tc.spliced_count(counter.tokenizer, text) == want
        assert time.process_time() - began < times * plain + 0.3


def test_memory_of_a_worker_is_bounded(vocabulary):
    import resource

    counter, rng = tc.Counter(vocabulary), random.Random(5)
    signs = [chr(c) for c in range(0x4E00, 0x5E00)]
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    for _ in range(4):
        texts = ["".join(rng.choices(signs, k=16_000)) for _ in range(100)] + ["a b"]
        counts = counter.counts(texts)
        assert counts[-1] == 2 and counts[0] == len(counter.tokenizer.encode(texts[0], add_special_tokens=False).ids)
        assert all(len(p) <= tc.REMEMBERED_CHARS for p in counter.known)
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 500_000  # kB; all encodings at once take 1 GB and more
    assert [sum(map(len, g)) for g in counter.groups(["x" * tc.ENCODED_CHARS, "a", "b"])] == [tc.ENCODED_CHARS, 2]


def test_seams_never_change_a_count(vocabulary):
    counter = tc.Counter(vocabulary)
    rng = random.Random(2)
    parts = ["don't", "  ", "\n", "a1", "é", "x.y", " 12 ", "<|endoftext|>", "’s", "'s", " ", "\t\n ", "ß", "你好。", "…", "--", "e\u0301", "\x1c", "\ufeff", "Ⅷ", "²"]
    for _ in range(300):
        text = "".join(rng.choice(parts) for _ in range(60))
        assert tc.spliced_count(counter.tokenizer, text, 40, 8) == len(counter.tokenizer.encode(text, add_special_tokens=False).ids)


def test_archives_are_rolled_and_damage_is_told(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(warc, "ARCHIVE_RECORDS", 3)
    pages = spark.createDataFrame([(i, f"<p>{i}</p>" * 40) for i in range(10)], "page_id long, html string").coalesce(1)
    warc.write_archives(warc.revisits(pages), f"file://{tmp_path}/rolled")
    assert len(list((tmp_path / "rolled").glob("*.gz"))) == 4
    back = warc.read_archives(spark, f"file://{tmp_path}/rolled/*.gz")
    assert sorted(r.id for r in back.where("intact").collect()) == sorted(str(i) for i in range(10))


def test_archives_round_trip(spark):
    rows = [(1, "u", "a" * 200), (2, None, "a" * 200), (None, "x", "a" * 200), (3, "u", None), (4, "u", "b"), (5, "u", "b"), (5, "u", "b"), (6, "u", "\r\n\r\nWARC/1.1é" * 9000), (7, "v", "a" * 200)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = warc.round_trip(pages).collect()
    assert all(r.intact for r in got)
    assert len(got) == len(rows)
    assert {(r.id, r.record_type, r.refers_to) for r in got} == {(1, "response", None), (2, "revisit", 1), (None, "revisit", 1), (3, "response", None), (4, "response", None), (5, "response", None), (6, "response", None), (7, "revisit", 1)}
    assert {bytes(r.payload).decode() for r in got if r.id == 6} == {rows[7][2]}
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_damaged_segments_are_told(spark, tmp_path):
    records = warc.page_records(1, "0.0", "u", b"z" * 5000, None, 1000)
    (tmp_path / "a.warc").write_bytes(b"".join(r + warc.END for r in records[:2] + records[3:]))
    (tmp_path / "b.warc").write_bytes(b"".join(r + warc.END for r in reversed(warc.page_records(2, "0.0", "u", b"y" * 5000, None, 1000))))
    got = {r.id: (r.intact, r.payload_bytes) for r in warc.read_archives(spark, f"file://{tmp_path}/*.warc").collect()}
    assert not got["1"][0]
    assert got["2"] == (True, 5000)


def test_chunked_framing():
    assert warc.dechunked(warc.chunked(b"")) == b""
    assert warc.dechunked(b"3;ext=1\r\nabc\r\n2\r\nde\r\n0\r\nTrailer: x\r\n\r\n") == b"abcde"
    with pytest.raises(ValueError):
        warc.dechunked(b"9\r\nabc\r\n0\r\n\r\n")

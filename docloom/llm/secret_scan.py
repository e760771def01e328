"""Secret scans through nested encodings: a worklist that unwraps layers until nothing new appears."""

from __future__ import annotations

import base64
import bz2
import lzma
import math
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import small_batches, table, utf8

KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
#: A run of the class is maximal, so the length can stand in the pattern for these two.
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
#: Escapes that stand for one character or byte each.
_PERCENT = re.compile(r"%u([0-9A-Fa-f]{4})|%([0-9A-Fa-f]{2})")
_CODED = r"""\\u([0-9A-Fa-f]{4})|\\u\{0*([0-9A-Fa-f]{1,5}|10[0-9A-Fa-f]{4})\}|\\U00(0[0-9A-Fa-f]{5}|10[0-9A-Fa-f]{4})|\\x([0-9A-Fa-f]{2})"""
_BACKSLASH = re.compile(_CODED + r"""|\\(["'\\/nrt])""")
_ESCAPE = re.compile(f"{_PERCENT.pattern}|{_BACKSLASH.pattern}")
_CODE_AT_END = re.compile(f"(?:{_PERCENT.pattern}|{_CODED})$")
#: The longest code that is read when codes nest deeply (zeros in braces make longer ones).
LONGEST_ESCAPE = 24
_BLANKS = {"n": "\n", "r": "\r", "t": "\t"}
_RUN = "[A-Za-z0-9+/_-]"
_BASE64 = re.compile(_RUN + "{16,}={0,2}")
#: The same over several lines.
_WRAPPED = re.compile(f"(?<!{_RUN})(?:{_RUN}{{16,}}+[\\t ]*+\\r?\\n[\\t ]*+)+{_RUN}++={{0,2}}")
_STANDARD = str.maketrans("-_", "+/", "\t\r\n ")
#: Text of two bytes a character, in either order.
_WIDE = (re.compile("(?:[\x01-\xff]\x00){8,}"), re.compile("(?:\x00[\x01-\xff]){8,}"))
#: First bytes of zlib streams by the rule of their format (deflate, any window, no dictionary), of gzip, bzip2 and xz.
_ZLIB = [bytes([c, f]) for c in range(0x08, 0x80, 0x10) for f in range(256) if (256 * c + f) % 31 == 0 and not f & 0x20]
_PACKED = re.compile("|".join(["\x1f\x8b\x08", "BZh[1-9]1AY&SY", "\xfd7zXZ\x00", *(re.escape(h.decode("latin-1")) for h in _ZLIB)]), re.DOTALL)
_MARK = re.compile(r"[%\\]")
_RUNS, _DIGITS, _LINE_END = re.compile(_RUN + "*"), re.compile("[0-9a-f]*"), re.compile(r"[\t ]*\r?\n")
#: Where a finding may begin that isn't a run of hexadecimal digits.
_BEGIN = re.compile(r"""AKIA|(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]""", re.IGNORECASE | re.ASCII)
#: What decoded bytes have where some part of them may hold a finding or a layer, other than deflate without a head. At most JOINT long.
_ALIVE = re.compile(f"(?i:AKIA|passw|secret|token|api_?key)|[0-9a-f]{{24}}|\\\\u\\{{|{_ESCAPE.pattern}|{_RUN}{{16}}|\x00|{_PACKED.pattern}", re.DOTALL)
JOINT = 64
#: Compressed content is unpacked and scanned in windows of so many bytes, each with the end of the last before it.
WINDOW, OVERLAP, STEP = 8 << 20, 1 << 16, 1 << 16
#: A base64 value that fills so much of a window's end may go on in the next.
LONG_RUN = 1 << 12

Span = tuple[int, int, str]
Stream = Callable[[], Iterator[bytes]]


class Origin:
    """Where each character of a layer comes from in the original text; composed by indexing, so nesting costs no depth.

    With arrays, character i comes from first[i] to last[i]; with numbers, all of them from one range; without, from themselves.
    """

    def __init__(self, first=None, last=None):
        self.first, self.last = first, last

    def span(self, start: int, end: int) -> tuple[int, int]:
        if self.first is None:
            return start, end
        return (int(self.first[start]), int(self.last[end - 1])) if isinstance(self.first, np.ndarray) else (self.first, self.last)

    def of(self, begin: np.ndarray, end: np.ndarray) -> Origin:
        """That of a layer whose characters come from begin[i] to end[i] of this one."""
        if self.first is None:
            return Origin(begin.astype(np.int32), end.astype(np.int32))
        return Origin(self.first[begin], self.last[end - 1]) if isinstance(self.first, np.ndarray) else self


def direct(text: str) -> list[Span]:
    """(start, end, kind) of the plain patterns; leftmost and non-overlapping for each kind."""
    out = [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 6] if ":" in text or "=" in text else []
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text)]
    out += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return out


def _meant(m: re.Match) -> str:
    code = m[m.lastindex]
    return _BLANKS.get(code, code) if m[0][0] == "\\" and len(m[0]) == 2 else chr(int(code, 16))


def unescaped(text: str, escapes: re.Pattern, origin: Origin) -> tuple[str, Origin] | None:
    """The whole layer with its escapes decoded once and the rest as it was; null without escapes.

    Every byte or code becomes one character: all patterns are ASCII, so nothing needs to be put together.
    """
    found = [m.span() for m in escapes.finditer(text)]
    if not found:
        return None
    starts, ends = np.array(found).T
    inside = np.zeros(len(text) + 1, np.int8)
    inside[starts + 1] += 1
    inside[ends] -= 1
    begin = np.flatnonzero(np.cumsum(inside[:-1]) == 0)
    end = begin + 1
    end[np.searchsorted(begin, starts)] = ends
    return escapes.sub(_meant, text), origin.of(begin, end)


def unwound(text: str, origin: Origin) -> tuple[str, Origin]:
    """The layer with all hexadecimal codes decoded until none is left, however deep they nest, in one pass. Scans look at each level.

    A decoded character may complete a code with what stands before it, which is decoded at once. As a code has its mark in
    its first place only, codes never overlap, and the order of decoding doesn't matter.
    """
    out: list[str] = []
    first: list[int] = []
    last: list[int] = []
    mark = -LONGEST_ESCAPE  # the last per cent sign or backslash
    for at, c in enumerate(text):
        out.append(c)
        first.append(at)
        last.append(at + 1)
        if c in "%\\":
            mark = len(out) - 1
            continue
        while ((size := len(out) - mark) in (3, 4, 6, 10) or (c == "}" and size <= LONGEST_ESCAPE)) and (m := _CODE_AT_END.search("".join(out[mark:]))):
            size = len(m[0])
            begin, end = first[-size], last[-1]
            del out[-size:], first[-size:], last[-size:]
            c = _meant(m)
            out.append(c)
            first.append(begin)
            last.append(end)
            mark = next((i for i in range(len(out) - 1, max(-1, len(out) - 1 - LONGEST_ESCAPE), -1) if out[i] in "%\\"), -LONGEST_ESCAPE)
    return "".join(out), origin.of(np.array(first), np.array(last))


def _no_deflate(content: bytes) -> bool:
    """Whether a stream that begins like this is proven not to be raw deflate."""
    try:
        zlib.decompressobj(-zlib.MAX_WBITS).decompress(content, STEP)
    except zlib.error:
        return True
    return False


class _Inflated:
    """Raw deflate fed in small steps, with what has to be known of its output."""

    def __init__(self, other: _Inflated | None = None):
        self.stream = other.stream.copy() if other else zlib.decompressobj(-zlib.MAX_WBITS)
        self.head, self.tail, self.size, self.alive, self.broken = (other.head, other.tail, other.size, other.alive, other.broken) if other else (b"", b"", 0, False, False)

    def feed(self, content: bytes) -> None:
        for i in range(0, len(content), 16):
            if self.broken or self.stream.eof:
                return
            try:
                out = self.stream.decompress(content[i : i + 16])
            except zlib.error:
                self.broken = True
                self.size += 16 * 1032  # what it may have given before it broke
                return
            self.size += len(out)
            self.head = (self.head + out)[:64] if len(self.head) < 64 else self.head
            self.alive = self.alive or bool(_ALIVE.search((self.tail + out).decode("latin-1")))
            self.tail = (self.tail + out)[-JOINT:]

    def silent(self) -> bool:
        if not self.stream.eof and self.size < STEP:
            return True  # nothing comes of it
        return not self.broken and not self.alive and (self.size <= 8 or _no_deflate(self.head))


def _silences(unit: bytes, rest: bytes, most: int) -> Iterator[bool]:
    """Whether raw deflate shows nothing in 0, 1, 2, ... repeats of the unit with the rest behind."""
    whole = _Inflated()
    for _ in range(most + 1):
        ended = _Inflated(whole)
        ended.feed(rest)
        yield ended.silent()
        whole.feed(unit)


class _Chain:
    """An escape whose decoded character is the mark of the next one, and so on: ``mark`` stands for text[start:at].

    What a level adds is what begins anew behind the mark. Up to ``limit`` that is proven to be a run of hexadecimal digits at
    most: no other pattern begins there, and base64 from any of its places holds nothing, however it is cut.
    """

    def __init__(self, text: str, start: int):
        self.text, self.start, self.mark, self.at = text, start, text[start], start + 1
        self.live, self.digits = True, 0
        other = _MARK.search(text, self.at)
        end = other.start() if other else len(text)
        begun = _BEGIN.search(text, self.at, end)
        run = _RUNS.match(text, self.at, end).end()
        self.run, self.limit = run, min(run, begun.start() if begun else end)
        if _LINE_END.match(text, run) or any(_ALIVE.search(self.decoded(self.at + k, run).decode("latin-1")) for k in range(4)):
            self.limit = self.at
        self.silence: dict[int, list[bool]] = {}
        self.cycle = self.even = 0

    def decoded(self, begin: int, end: int) -> bytes:
        part = self.text[begin : max(begin, end - ((end - begin) % 4 == 1))].translate(_STANDARD)
        return base64.b64decode(part + "=" * (-len(part) % 4))

    def silent(self, at: int) -> bool:
        """Whether deflate without a head from this place of the run on is proven to show nothing.

        Where the run repeats itself, bytes of a repeated unit and a rest stand behind each place. The places of a class differ
        in the number of units only, so one stream with a copy at each unit tells them all.
        """
        if _no_deflate(self.decoded(at, min(self.run, at + 96))):
            return True
        if not self.cycle:
            places = np.frombuffer(self.text[self.start + 1 : self.run].encode("latin-1"), np.uint8)
            self.cycle = 1
            for n in range(1, LONGEST_ESCAPE):
                differ = np.flatnonzero(places[n:] != places[:-n])
                even = int(differ[0]) + n if len(differ) else len(places)
                if even > 8 * n + at - self.start:
                    self.cycle, self.even = math.lcm(n, 4), self.start + 1 + even
                    break
        kind = at % self.cycle
        last = at + (self.even - at) // self.cycle * self.cycle
        if last <= at or self.run - last > 1 << 12:
            return False
        if kind not in self.silence:
            self.silence[kind] = list(_silences(self.decoded(at, at + self.cycle), self.decoded(last, self.run), (last - at) // self.cycle))
        units = (last - at) // self.cycle
        return units < len(self.silence[kind]) and self.silence[kind][units]

    def next(self) -> tuple[str, int] | None:
        """The mark and its end one level deeper; null where the level has to be looked at as a whole."""
        window = self.mark + self.text[self.at : self.at + LONGEST_ESCAPE]
        m = _ESCAPE.match(window)
        if not m:
            return None if window.startswith("\\u{") else (self.mark, self.at)
        mark, at = _meant(m), self.at + m.end() - 1
        if mark not in "%\\" or at > self.limit:
            return None
        return (mark, at) if self.run - at < 16 or all(self.silent(at + k) for k in range(4)) else None

    def hex_run(self) -> tuple[int, int] | None:
        if self.at > self.digits:
            self.digits = _DIGITS.match(self.text, self.at).end()
        return (self.at, self.digits) if self.digits - self.at >= 24 else None


def chained(text: str, origin: Origin, found: set[Span]) -> tuple[str, Origin]:
    """The deepest level below this one before which no level can show anything but runs of hexadecimal digits, which go to ``found``.

    So a long chain of escapes costs no pass over the text for each of its levels. Where a level isn't proven to be empty
    the chain stops, and the caller looks at it as a whole.
    """
    starts = [m.start() for m in _ESCAPE.finditer(text)]
    if not starts or "\x00" in text or _PACKED.search(text) or any(s and text[s - 1] == "\\" for s in starts):
        return text, origin
    if any(_meant(m) not in "%\\" for m in _ESCAPE.finditer(text)):
        return text, origin
    chains = [_Chain(text, s) for s in starts]
    first, ends = chains[0], [*starts[1:], len(text) + LONGEST_ESCAPE + 1]
    if first.start >= 64 and not _no_deflate(text[:64].encode("latin-1", "replace")):
        return text, origin
    moved = False
    while live := [(c, end) for c, end in zip(chains, ends, strict=True) if c.live]:
        steps = []
        for c, end in live:
            step = c.next() if c.at + LONGEST_ESCAPE < end else None
            if step is None:
                break
            steps.append(step)
        if len(steps) < len(live) or all(step[1] == c.at for step, (c, _) in zip(steps, live, strict=True)):
            break
        if first.start < 64:
            mark, at = steps[0] if first.live else (first.mark, first.at)
            if not _no_deflate((text[: first.start] + mark + text[at : min(at + 64, ends[0])])[:64].encode("latin-1", "replace")):
                break
        for (c, _), (mark, at) in zip(live, steps, strict=True):
            c.live = at > c.at
            c.mark, c.at = mark, at
            if c.live and (run := c.hex_run()):
                found.add((*origin.span(*run), "hex"))
        moved = True
    if not moved:
        return text, origin
    out, begin, end, at = [], [], [], 0
    for c in [*chains, None]:
        stop = c.start if c else len(text)
        out.append(text[at:stop])
        begin.append(np.arange(at, stop))
        end.append(np.arange(at + 1, stop + 1))
        if c:
            out.append(c.mark)
            begin.append([c.start])
            end.append([c.at])
            at = c.at
    return "".join(out), origin.of(np.concatenate(begin).astype(np.int64), np.concatenate(end).astype(np.int64))


def levels(text: str, origin: Origin, found: set[Span]) -> Iterator[tuple[str, Origin]]:
    """The layer with its escapes decoded once, twice, and so on until none is left.

    Levels that ``chained`` proves to show nothing new are passed over; all others come whole, however many they are.
    """
    while made := unescaped(text, _ESCAPE, origin):
        yield made
        text, origin = chained(*made, found)


class _Zlib:
    """zlib, gzip or raw deflate with the interface of the other decompressors."""

    def __init__(self, bits: int):
        self.stream, self.held = zlib.decompressobj(bits), b""

    def decompress(self, chunk: bytes, most: int) -> bytes:
        out = self.stream.decompress(self.held + chunk, most)
        self.held = self.stream.unconsumed_tail
        return out

    eof = property(lambda self: self.stream.eof)
    unused_data = property(lambda self: self.stream.unused_data)
    needs_input = property(lambda self: not self.held)


def _decompressor(head: bytes):
    if head.startswith(b"BZh"):
        return bz2.BZ2Decompressor()
    return lzma.LZMADecompressor() if head.startswith(b"\xfd7zXZ") else _Zlib(zlib.MAX_WBITS | 32)


def unpacked(chunks: Iterator[bytes], strict: bool = False, used: list[int] | None = None, raw: bool = False) -> Iterator[bytes]:
    """Content of a compressed file of one member or more, chunk by chunk, as far as it can be read.

    With ``strict`` nothing comes of a stream that breaks within its first STEP bytes. ``used`` gets the number of
    compressed bytes of every member that is whole, counted from the start. ``raw`` reads deflate without a head.
    """
    stream, held, fed = None, b"", 0
    for chunk in chunks:
        fed += len(chunk)
        stream = stream or (_Zlib(-zlib.MAX_WBITS) if raw else _decompressor(chunk[:6]))
        while True:
            try:
                out = stream.decompress(chunk, STEP)
            except (zlib.error, OSError, EOFError, lzma.LZMAError):
                return
            held += out
            strict = strict and not stream.eof and len(held) < STEP
            if held and not strict:
                yield held
                held = b""
            chunk = b""
            if stream.eof:
                chunk = stream.unused_data
                if used is not None:
                    used.append(fed - len(chunk))
                if raw or not _PACKED.match(chunk[:10].decode("latin-1")) or chunk[:1] not in b"\x1fB\xfd":
                    return
                stream = _decompressor(chunk)
            elif stream.needs_input:
                break
    if held and not raw:
        yield held


def windows(chunks: Iterator[bytes]) -> Iterator[tuple[int, bytes]]:
    """(place, bytes) of the stream in pieces of about WINDOW bytes; each but the first begins with the end of the one before."""
    held, size, fresh, at = [], 0, False, 0
    for chunk in chunks:
        held.append(chunk)
        size, fresh = size + len(chunk), True
        if size >= WINDOW:
            whole = b"".join(held)
            yield at, whole
            at += len(whole) - OVERLAP
            held, size, fresh = [whole[-OVERLAP:]], OVERLAP, False
    if fresh:
        yield at, b"".join(held)


def _decoded64(chunks: Iterator[bytes], skip: int) -> Iterator[bytes]:
    """Bytes of a base64 value from ``skip`` on in the stream, up to the first character that can't belong to one."""
    rest = b""
    for chunk in chunks:
        if skip >= len(chunk):
            skip -= len(chunk)
            continue
        m = _CLEAN.match(chunk, skip)
        skip = 0
        rest += m[0].translate(_STANDARD64, b"\t\r\n ")
        whole = len(rest) // 4 * 4
        yield base64.b64decode(rest[:whole])
        rest = rest[whole:]
        if m.end() < len(chunk):
            break
    if len(rest) > 1:
        yield base64.b64decode(rest + b"=" * (-len(rest) % 4))


def _from(chunks: Iterator[bytes], skip: int) -> Iterator[bytes]:
    for chunk in chunks:
        if skip < len(chunk):
            yield chunk[skip:]
        skip = max(0, skip - len(chunk))


_CLEAN = re.compile(rb"[A-Za-z0-9+/_\t\r\n -]*")
_STANDARD64 = bytes.maketrans(b"-_", b"+/")
_LETTERS64 = bytes(b for b in range(256) if _CLEAN.fullmatch(bytes([b])))


def opened(stream: Stream) -> Iterator[bytes]:
    """Windows of a stream, and of what is in it where that goes on beyond a window: compressed content at its start, and compressed
    content in a base64 value that reaches the end of a window. Decoders carry their state over windows; smaller layers
    are left to the caller, who sees each window.
    """
    work, seen = [stream], set()
    while work:
        make = work.pop()
        several = False
        for at, piece in windows(make()):
            several = several or at > 0 or len(piece) >= WINDOW
            yield piece
            tail = len(piece) - len(piece.rstrip(_LETTERS64))
            if len(piece) >= WINDOW and tail >= LONG_RUN:
                begin = at + len(piece) - len(piece[-tail:].lstrip(b"\t\r\n "))
                for k in range(4):
                    head = b"".join(_decoded64(iter([piece[begin - at : begin - at + LONG_RUN]]), k))
                    if found := _PACKED.search(head.decode("latin-1"), 0, 64):
                        inner = lambda make=make, skip=begin + k, begin=found.start(): _from(_decoded64(make(), skip), begin)
                        work.append(lambda inner=inner: unpacked(inner(), True))
        if several:
            first = next(make(), b"")
            mark = xxhash.xxh128_digest(first)
            if mark not in seen and _PACKED.match(first[:10].decode("latin-1")):
                seen.add(mark)
                work.append(lambda make=make: unpacked(make()))


def _wide_runs(text: str) -> Iterator[tuple[int, re.Match]]:
    """(place of the character in its two bytes, match) of text of two bytes a character; most texts are ruled out without a search."""
    zero = np.frombuffer(text.encode("latin-1", "replace"), np.uint8) == 0
    for low, pattern in enumerate(_WIDE):
        pair = (zero[1:] & ~zero[:-1]) if low == 0 else (zero[:-1] & ~zero[1:])
        for step in (2, 4, 8):  # eight pairs in a row
            pair = pair[:-step] & pair[step:] if len(pair) > step else pair[:0]
        if pair.any():
            yield from ((low, m) for m in pattern.finditer(text))


def layers(text: str, origin: Origin, raw: bool, escaped: bool, found: set[Span]) -> Iterator[tuple[str, Origin, bool, bool]]:
    """What stands one step below a layer: (text, origin, whether it holds decoded bytes, whether escapes in it are still to be decoded).

    URL and Unicode escapes are decoded in place in the whole layer, so a secret may be encoded in part: each kind once, and all
    of them level by level to the end. Base64 runs, also over lines, are decoded at all four alignments, as what
    stands directly before a value may look like base64 too. Text of two bytes a character is narrowed. Compressed bytes
    are found wherever they begin (deflate without a head: at the start of decoded bytes); what is in them stands for their
    whole range. They are unpacked as a stream, so content larger than a window needs no more memory than one.
    """
    if escaped and ("%" in text or "\\" in text):
        for escapes in (_PERCENT, _BACKSLASH):
            if made := unescaped(text, escapes, origin):
                yield *made, True, False
        for made in levels(text, origin, found):
            yield *made, True, False
    runs = [m for pattern in ((_BASE64, _WRAPPED) if "\n" in text else (_BASE64,)) for m in pattern.finditer(text)]
    for m in runs:
        run = m[0].rstrip("=").translate(_STANDARD)
        places = np.arange(m.start(), m.end()) if len(m[0].translate(_STANDARD)) == len(m[0]) else m.start() + np.flatnonzero(~np.isin(np.frombuffer(m[0].encode("latin-1", "replace"), np.uint8), list(b"\t\r\n ")))
        for k in range(4):
            part = run[k : len(run) - (len(run) - k) % 4 if (len(run) - k) % 4 == 1 else len(run)]
            if len(part) >= 8:
                content = base64.b64decode(part + "=" * (-len(part) % 4)).decode("latin-1")
                j = np.arange(len(content))
                begin, end = places[k + j * 4 // 3], places[np.minimum(k + (j * 4 + 6) // 3, len(run)) - 1] + 1
                end[-1:] = m.end()
                yield content, origin.of(begin, end), True, True
    if raw:
        if "\x00" in text:
            for low, m in _wide_runs(text):
                begin = np.arange(m.start(), m.end(), 2)
                yield m[0][low::2], origin.of(begin, begin + 2), True, True
        done = 0
        source = lambda begin: lambda: (text[i : i + STEP].encode("latin-1", "replace") for i in range(begin, len(text), STEP))
        for m in _PACKED.finditer(text):
            if m.start() >= done:  # else it lies in what has been unpacked as a whole
                used: list[int] = []
                for piece in opened(lambda m=m: unpacked(source(m.start())(), m[0][0] != "\x1f", used)):
                    yield piece.decode("latin-1"), Origin(*origin.span(m.start(), len(text))), True, True
                done = m.start() + max(used, default=0)
        if not done and len(text) > 8:
            for piece in opened(lambda: unpacked(source(0)(), True, raw=True)):
                yield piece.decode("latin-1"), Origin(*origin.span(0, len(text))), True, True


def scan(text: str | None) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans), in code points of the original text.

    A worklist holds layers with their origin; a finding inside a layer stands for the characters that it was decoded from. A
    layer seen before for the same range is not opened again, which ends cycles. Escapes may nest to any depth, and
    so may base64 and compressed content of any size.
    """
    text = text or ""
    order = {k: i for i, k in enumerate(KINDS)}
    base = sorted(direct(text), key=lambda s: (s[0], order[s[2]]))
    found = set(base)
    seen = set()
    work = [layers(text, Origin(), False, True, found)]
    while work:
        below = next(work[-1], None)
        if below is None:
            work.pop()
            continue
        layer, origin, raw, escaped = below
        if not layer:
            continue
        mark = (*origin.span(0, len(layer)), escaped, xxhash.xxh128_digest(utf8(layer)))
        if mark in seen:
            continue
        seen.add(mark)
        found.update((*origin.span(start, end), kind) for start, end, kind in direct(layer))
        work.append(layers(layer, origin, raw, escaped, found))
    return base, sorted(found, key=lambda s: (s[0], order[s[2]], s[1]))


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, base, spans) of every row; both are arrays of struct<kind, start, end> by start, then kind.

    Offsets are code points of the original text, end exclusive. Null texts are empty. Whole texts are
    scanned. Rows are judged one by one: repeated rows, null ids and other columns play no part.
    """
    small_batches(docs.sparkSession)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            results = [scan(t) for t in b.column(1).to_pylist()]
            both = [pa.array([[{"kind": k, "start": s, "end": e} for s, e, k in r[i]] for r in results], kind) for i in (0, 1)]
            yield table({"id": b.column(0), "base": both[0], "spans": both[1]})

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    spans = "array<struct<kind:string,start:int,end:int>>"
    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, base {spans}, spans {spans}")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """(id, text) with every found range replaced by ``mark``."""
    small_batches(docs.sparkSession)

    def clean(text: str | None) -> str | None:
        spans, at, out = scan(text)[1], 0, []
        for start, end, _ in sorted(spans):
            if start >= at:
                out += [text[at:start], mark]
            at = max(at, end)
        return text if not spans else "".join(out) + text[at:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield table({"id": b.column(0), "text": pa.array([clean(t) for t in b.column(1).to_pylist()], pa.string())})

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, text string")

r"""Secret scans with a recursive decoding worklist.

Three kinds are looked for in a text and in every layer that can be decoded from it:
percent escapes, \\u, \\x and numeric character escapes, base64, and
compressed (gzip, zlib) data within base64.  A layer of escapes is the whole text
with all of them decoded in place; base64 is joined over line ends and read from each
path segment on; bytes that are no text stay where they hold a find or a layer.  Layers wait in a worklist
until nothing new decodes; a layer whose text came from the same place of the
original before is not opened again, so cycles end and a copy elsewhere is.  Each decoded character carries the span of the original text
that it came from, and a find in a layer is reported as the span of its
first to last character there.

Cases: a null or empty text has no span; texts of any length are scanned
whole; equal texts have equal spans; repeated rows are each scanned; an empty
table gives an empty result.  A compressed layer of more than
``most_bytes`` is scanned in parts of that size that overlap by ``OVERLAP`` bytes, one
part in memory at a time, and the row counts it in ``n_oversize``.  A base64 run that a part
does not end is decoded on beside the parts, as a stream, so that the size of parts decides about no find in it.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from titlelake.llm.common import column, doc_rows, pieces, small_batches, texts_of

# The kinds, in order, and their patterns.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")

RUN = r"[A-Za-z0-9+/_-]"
BASE64 = re.compile(rf"(?<!{RUN}){RUN}{{16,}}={{0,2}}")
LINE_END = re.compile(r"[ \t]*(?:\r?\n|(?:\\r)?\\n)[ \t]*")
JOINED = re.compile(rf"(?<!{RUN}){RUN}{{4,}}+(?:{LINE_END.pattern}{RUN}++)+={{0,2}}")
PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ONE_ESCAPE = re.compile(r"\\u([0-9A-Fa-f]{4})|\\x([0-9A-Fa-f]{2})|&#(\d{1,7});|&#[xX]([0-9A-Fa-f]{1,6});")
#: Bytes that parts of a large layer share.
OVERLAP = 1 << 16
#: Bytes that are inflated at a time.
STEP = 1 << 16
LINE_END_BYTES, CUT_LINE_END = re.compile(LINE_END.pattern.encode()), re.compile(rb"[ \t\r\n\\]*\Z")
BYTES_OF_RUN = re.compile(rb"(?:[A-Za-z0-9+/_-]|\n(?!\n))*+")
MAY_BE_RUN = np.isin(np.arange(256), np.frombuffer(bytes(x for x in range(128) if re.match(RUN, chr(x))) + b" \t\r\n\\", np.uint8))
#: Compressed data may begin after these.
LINE_FEED, BEFORE_HEAD = 10, np.frombuffer(b"/_-\n", np.uint8)


@dataclass
class Layer:
    """A text and, for each of its characters, where it began and ended in the original (None: the original itself)."""

    text: str
    begin: np.ndarray | None = None
    end: np.ndarray | None = None
    part: bool = False  # may begin within a run

    def span(self, lo: int, hi: int) -> tuple[int, int]:
        return (lo, hi) if self.begin is None else (int(self.begin[lo]), int(self.end[hi - 1]))

    def of(self, text: str, first: np.ndarray, last: np.ndarray, part: bool = False) -> Layer:
        """A layer whose characters come from the characters ``first`` to ``last`` of this one."""
        return Layer(text, *((first, last + 1) if self.begin is None else (self.begin[first], self.end[last])), part)


@dataclass
class Found:
    base: list[tuple[int, int, int]] = field(default_factory=list)  # start, kind, end
    all: list[tuple[int, int, int]] = field(default_factory=list)
    layers: int = 0  # with different texts
    oversize: int = 0


def finds(text: str) -> Iterator[tuple[int, int, int]]:
    """``start, kind, end`` of the three kinds: leftmost, non-overlapping for each kind, failing matches dropped."""
    for m in ASSIGN.finditer(text):
        if m.end(1) - m.start(1) >= 6:
            yield m.start(), 0, m.end()
    if "AKIA" in text:
        for m in ACCESS.finditer(text):
            if m.end() - m.start() >= 20:
                yield m.start(), 1, m.end()
    for m in HEX.finditer(text):
        yield m.start(), 2, m.end()


def characters(data: bytes) -> tuple[str, np.ndarray, np.ndarray, bool]:
    """Text of the bytes, each character's first and last byte, and whether all are UTF-8; a byte that is not becomes U+FFFD."""
    text = data.decode("utf-8", "surrogateescape")
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").copy()
    lone = (code >= 0xDC80) & (code <= 0xDCFF)
    size = 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)
    size[lone] = 1
    last = np.cumsum(size) - 1
    if lone.any():
        code[lone] = 0xFFFD
        text = code.tobytes().decode("utf-32-le", "surrogatepass")
    return text, last - size + 1, last, not lone.any()


def holds(text: str) -> bool:
    """A find or something that decodes."""
    return any(True for _ in finds(text)) or any(p.search(text) for p in (PERCENT, ONE_ESCAPE, BASE64))


def reads(text: str) -> bool:
    return sum(c.isprintable() or c in "\t\n\r" for c in text) >= 0.9 * len(text)


def in_place(layer: Layer, decoded: list[tuple[int, int, str, np.ndarray, np.ndarray]]) -> Layer:
    """The text with each ``lo, hi, text, first, last`` in place of its characters ``lo`` to ``hi``."""
    out, first, last, at = [], [], [], 0
    for lo, hi, own, a, b in [*decoded, (len(layer.text), 0, "", np.zeros(0, np.int64), np.zeros(0, np.int64))]:
        same = np.arange(at, lo)
        out += [layer.text[at:lo], own]
        first += [same, a]
        last += [same, b]
        at = hi
    return layer.of("".join(out), np.concatenate(first), np.concatenate(last))


def unescape_percent(layer: Layer) -> Iterator[Layer]:
    decoded = []
    for m in PERCENT.finditer(layer.text):
        own, first, last, _ = characters(bytes.fromhex(m[0].replace("%", "")))
        decoded.append((m.start(), m.end(), own, m.start() + 3 * first, m.start() + 3 * last + 2))
    if decoded:
        yield in_place(layer, decoded)


def unescape_unicode(layer: Layer) -> Iterator[Layer]:
    decoded: list[list[int]] = []
    for m in ONE_ESCAPE.finditer(layer.text):
        c = int(m[1] or m[2] or m[4], 16) if not m[3] else int(m[3])
        if 0xDC00 <= c < 0xE000 and decoded and decoded[-1][1] == m.start() and 0xD800 <= decoded[-1][2] < 0xDC00:  # the second half of a pair
            decoded[-1][1:] = m.end(), 0x10000 + (decoded[-1][2] - 0xD800 << 10) + c - 0xDC00
        else:
            decoded.append([m.start(), m.end(), min(c, 0x10FFFF)])
    if decoded:
        yield in_place(layer, [(lo, hi, chr(c), np.array([lo]), np.array([hi - 1])) for lo, hi, c in decoded])


class Stream:
    """Bytes that arrive bit by bit, given out in overlapping parts of at most ``most``.  The base64 run that is open
    where a part ends, and too long for the overlap, is decoded on; what it holds is given out as parts too."""

    def __init__(self, most: int) -> None:
        self.most, self.overlap = most, min(OVERLAP, most // 2)
        self.held, self.offered, self.fresh, self.run = bytearray(), 0, False, None

    def feed(self, data: bytes) -> Iterator[bytes]:
        for at in range(0, len(data), self.overlap):
            self.held += data[at : at + self.overlap]
            self.fresh = True
            if len(self.held) >= self.most:
                yield from self.go_on(len(self.held))
                if self.run is None:
                    yield from self.open()
                yield bytes(self.held)
                cut = len(self.held) - self.overlap
                del self.held[:cut]
                self.offered, self.fresh = max(0, self.offered - cut), False

    def go_on(self, end: int) -> Iterator[bytes]:
        """Offer the open run what follows it; a line end that may be cut waits."""
        if self.run is not None:
            new = self.held[self.offered : end]
            new = new[: len(new) - len(CUT_LINE_END.search(new)[0])]
            self.offered += len(new)
            own = BYTES_OF_RUN.match(LINE_END_BYTES.sub(b"\n", new))
            yield from self.run.feed(own[0])
            if own.end() < len(own.string):
                yield from self.run.close()
                self.run = None

    def open(self) -> Iterator[bytes]:
        code = np.frombuffer(bytes(self.held), np.uint8)
        hard = np.flatnonzero(~MAY_BE_RUN[code])
        begin = int(hard[-1]) + 1 if len(hard) else 0
        if len(code) - begin > self.overlap:
            tail = bytes(self.held[begin:])
            tail = tail[: len(tail) - len(CUT_LINE_END.search(tail)[0])]
            self.offered = begin + len(tail)
            own = LINE_END_BYTES.sub(b"\n", tail)
            own = own[max(own.rfind(c) for c in (b" ", b"\t", b"\r", b"\\")) + 1 :].rpartition(b"\n\n")[2]
            self.run = Run(self.most)
            yield from self.run.feed(own)

    def close(self) -> Iterator[bytes]:
        yield from self.go_on(len(self.held))
        if self.run is not None:
            yield from self.run.close()
        if self.fresh:
            yield bytes(self.held)


class Run:
    """A base64 run that arrives bit by bit: read in every step, and inflated from each place where compressed data may begin."""

    def __init__(self, most: int) -> None:
        self.most, self.before, self.ahead, self.begins = most, b"\n", b"", np.zeros(0, bool)
        self.read: list[tuple[Base64, Stream | Inflated]] = [(Base64(k), Stream(most)) for k in range(4)]

    def feed(self, chars: bytes) -> Iterator[bytes]:
        """``chars``: of the run, and the line feeds within it."""
        if not chars:
            return
        code = np.frombuffer(self.before + chars, np.uint8)
        own = code[1:] != LINE_FEED
        body, begins = code[1:][own].tobytes(), np.isin(code[:-1], BEFORE_HEAD)[own]
        self.before = chars[-1:]
        for decoder, to in self.read:
            yield from to.feed(decoder.feed(body))
        whole, begins = self.ahead + body, np.append(self.begins, begins)
        for at in np.flatnonzero(begins[: max(0, len(whole) - 3)]).tolist():
            if is_compressed(plain_base64(whole[at : at + 4])):
                decoder, to = Base64(0), Inflated(self.most)
                self.read.append((decoder, to))
                yield from to.feed(decoder.feed(whole[at:]))
        self.ahead, self.begins = whole[-3:], begins[-3:]
        self.read = [(decoder, to) for decoder, to in self.read if isinstance(to, Stream) or not to.run_out]

    def close(self) -> Iterator[bytes]:
        for decoder, to in self.read:
            yield from to.feed(decoder.rest())
            yield from to.close()


class Base64:
    """Decodes all but the first ``skip`` characters."""

    def __init__(self, skip: int) -> None:
        self.skip, self.left = skip, b""

    def feed(self, body: bytes) -> bytes:
        own = self.left + body[self.skip :]
        self.skip = max(0, self.skip - len(body))
        whole = len(own) // 4 * 4
        self.left = own[whole:]
        return plain_base64(own[:whole])

    def rest(self) -> bytes:
        return _decoded(self.left.decode().replace("-", "+").replace("_", "/"))


class Inflated:
    """What gzip or zlib data holds, up to its first error."""

    def __init__(self, most: int) -> None:
        self.zip, self.out, self.run_out, self.most = zlib.decompressobj(47), Stream(most), False, most

    def feed(self, data: bytes) -> Iterator[bytes]:
        for at in range(0, len(data), 4096):
            rest = data[at : at + 4096]
            while not self.run_out:
                try:
                    more, rest = self.zip.decompress(rest, STEP), self.zip.unconsumed_tail
                except zlib.error:
                    more, self.run_out = b"", True
                yield from self.out.feed(more)
                if self.zip.eof:
                    self.run_out = True
                if not rest and len(more) < STEP:
                    break
            if self.run_out:
                break
        if self.run_out:
            yield from self.close()

    def close(self) -> Iterator[bytes]:
        yield from self.out.close()
        self.out = Stream(self.most)


def plain_base64(body: bytes) -> bytes:
    return base64.b64decode(body, b"-_") if b"-" in body or b"_" in body else base64.b64decode(body)


def is_compressed(head: bytes) -> bool:
    """The first bytes of gzip or zlib data."""
    return head[:2] == b"\x1f\x8b" or bool(head) and head[0] & 15 == 8 and (head[0] << 8 | head[1]) % 31 == 0


def inflated(data: bytes, most: int) -> Iterator[bytes]:
    """Parts of at most about ``most`` bytes of what gzip or zlib data holds."""
    own = Inflated(most)
    yield from own.feed(data)
    yield from own.close()


def unwrap_base64(layer: Layer, most: int, out: Found) -> Iterator[Layer]:
    for m in (*BASE64.finditer(layer.text), *JOINED.finditer(layer.text)):
        lo, hi = m.start(), m.start() + len(m[0].rstrip("="))
        ends = [x.span() for x in LINE_END.finditer(layer.text, lo, hi)] if m.re is JOINED else []
        lines = list(zip([lo, *(b for _, b in ends)], [*(a for a, _ in ends), hi]))
        body, place = "".join(layer.text[a:b] for a, b in lines), np.concatenate([np.arange(a, b) for a, b in lines])
        if len(body) < 16:
            continue
        # a path segment, a line or a part may begin anywhere; what follows reads the same from any place in step with it
        starts = {0, *np.cumsum([b - a for a, b in lines])[:-1].tolist(), *(x.end() for x in re.finditer("[/_-]", body))}
        body = body.replace("-", "+").replace("_", "/")
        opened = False
        for at in sorted(starts):
            head = base64.b64decode(body[at : at + 4]) if at + 16 <= len(body) else b""
            if is_compressed(head):
                for k, plain in enumerate(inflated(_decoded(body[at:]), most)):
                    text = characters(plain)[0]
                    out.oversize += k == 1
                    opened |= at == 0
                    if reads(text[:4096]) or holds(text):
                        yield layer.of(text, np.full(len(text), place[at]), np.full(len(text), place[-1]), True)
        for at in sorted({0, 1, 2, 3} if layer.part else {x % 4 for x in starts}):
            data = _decoded(body[at:])
            text, first, last, utf8 = characters(data)
            if not opened and at == 0 and utf8 and reads(text) or holds(text):
                yield layer.of(text, place[at + first * 4 // 3], place[at + ((last + 1) * 4 + 2) // 3 - 1])


def _decoded(body: str) -> bytes:
    if len(body) % 4 == 1:
        body = body[:-1]
    return base64.b64decode(body + "=" * (-len(body) % 4))


def scan(text: str, most_bytes: int = 16 << 20) -> Found:
    """All finds of a text and its layers, the deepest first, so that only a layer and those it came from are held."""
    out = Found(sorted(finds(text)))
    every, seen, texts = set(out.base), set(), set()

    def inner(layer: Layer) -> Iterator[Layer]:
        yield from unescape_percent(layer)
        yield from unescape_unicode(layer)
        yield from unwrap_base64(layer, most_bytes, out)

    work = [inner(Layer(text))]
    while work:
        layer = next(work[-1], None)
        if layer is None:
            work.pop()
            continue
        own = xxhash.xxh3_128_digest(layer.text.encode("utf-8", "surrogatepass"))
        key = own + xxhash.xxh3_128_digest(layer.begin.tobytes() + layer.end.tobytes())
        if not layer.text or key in seen:
            continue
        seen.add(key)
        texts.add(own)
        for lo, kind, hi in finds(layer.text):
            a, b = layer.span(lo, hi)
            every.add((a, kind, b))
        work.append(inner(layer))
    out.all, out.layers = sorted(every), len(texts)
    return out


def written(spans: list[tuple[int, int, int]]) -> str:
    """kind:start:end, comma-joined."""
    return ",".join(f"{KINDS[kind]}:{lo}:{hi}" for lo, kind, hi in spans)


def scan_documents(docs: DataFrame, most_bytes: int = 16 << 20) -> DataFrame:
    """Counts and spans of every document; starts and ends are code points of its own text."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                own = [scan(t, most_bytes) for t in texts_of(part)]
                count = lambda kind: pa.array([sum(s[1] == kind for s in f.base) for f in own], pa.int64())
                yield pa.RecordBatch.from_arrays([
                    column(part, "doc_id"), count(0), count(1), count(2), pa.array([hashlib.sha256(written(f.base).encode()).hexdigest() for f in own], pa.string()),
                    pa.array([written(f.all) for f in own], pa.string()), pa.array([f.layers for f in own], pa.int64()), pa.array([f.oversize for f in own], pa.int64())],
                    ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_layers", "n_oversize"])

    return doc_rows(docs).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_layers bigint, n_oversize bigint")

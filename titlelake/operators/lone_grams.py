"""For each text and order, the n-gram occurrences that no other text has (M8), met as packed hashes.

The i-th occurrence of a gram in a text is *lone* when no other text has the gram i times.  Occurrences meet
as 74 or more bits of a hash of gram and i (with N different ones, one that is lone is taken for met with a chance of N / 2^74).
What is shuffled is kept small by four means:

1. Texts are packed into compressed chunks of a bounded number of tokens.
2. What several texts of a chunk have is sent once, marked so, and without a text.  An occurrence of one
   text is sent with the text's number in the chunk, in as many bits as that takes.
3. A chunk's hashes are sent sorted, by range of the hash (``h``): their upper bits as steps (Elias-Fano), the lower ones as they are.
4. With ``hold`` orders meet one after the other, and the shuffled hashes of one are gone before the next are sent.

A task holds one chunk, or one or more ranges of together about ``MEET_BYTES`` of packed hashes, at a time. A range has a share of all hashes:
with up to 65,536 chunks it is about what one chunk sends, beyond that (or beyond 1,024 without ``hold``) it grows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tokens and bytes of text after which a chunk ends (a longer text is a chunk of its own).
CHUNK_TOKENS = 1 << 20
CHUNK_BYTES = 1 << 24
#: log2 of the number of hash ranges, least and most; 64 more bits are sent. With ``hold`` there are about as many ranges as chunks.
RANGE_BITS, MOST_RANGE_BITS = 10, 16
#: Bytes of packed hashes after which a task lets the ranges read so far meet.
MEET_BYTES = 1 << 24
#: A list of fewer hashes than this for each range is sent as plain numbers.
FEW = 16

SENT = "key bigint, h int, n int, k bigint, m int, hashes binary, shared binary, texts binary"
LOST = "key bigint, n int, k bigint, m int, texts binary"
U64 = np.uint64
STEP, SALT_1, SALT_2 = U64(0x9E3779B97F4A7C15), U64(0xD1342543DE82EF95), U64(0xAEF17502108EF2D9)


# ------------------------------------------------------------ packing
def pack(v: np.ndarray) -> bytes:
    """Sorted numbers, at least one: a bit string that steps through the upper bits, then the lower bits."""
    m = len(v)
    w = 64 - m.bit_length()
    steps = np.zeros(m + (1 << m.bit_length()), np.uint8)
    steps[(v >> U64(w)).astype(np.int64) + np.arange(m)] = 1
    return _bits(steps) + pack_plain(v, w)


def unpack(data: bytes, m: int) -> np.ndarray:
    w = 64 - m.bit_length()
    n = (m + (1 << m.bit_length()) + 7) // 8
    high = (np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8, n))) - np.arange(m)).astype(U64)
    return (high << U64(w)) | unpack_plain(data[n:], m, w)


def pack_plain(v: np.ndarray, w: int) -> bytes:
    """The lower ``w`` bits of each number."""
    return _bits(np.unpackbits(v.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)[:, 64 - w:])


def unpack_plain(data: bytes, m: int, w: int) -> np.ndarray:
    own = np.zeros((m, 64), np.uint8)
    own[:, 64 - w:] = np.unpackbits(np.frombuffer(data, np.uint8), count=m * w).reshape(m, w)
    return np.packbits(own, axis=1).view(">u8").ravel().astype(U64)


def _bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def _flags(data: bytes, m: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=m).astype(bool)


# ------------------------------------------------------------ hashes
def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers (splitmix64's last steps), in place."""
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two 64-bit hashes of every token, and the number of tokens of each text that has any. (Arrow splits at the 29 characters of ``STRIP_CLASS``.)"""
    cut = pc.utf8_split_whitespace(texts)
    words, ends = cut.flatten(), np.asarray(cut.offsets)
    real = np.asarray(pc.binary_length(words)) > 0  # white space at an end of a text cuts an empty string off
    count = np.concatenate([[0], np.cumsum(real)])[ends - ends[0]]
    coded = words.dictionary_encode()
    at = np.asarray(coded.indices)[real]
    known = coded.dictionary.to_numpy(zero_copy_only=False)
    h1, h2 = (pd.util.hash_array(known, hash_key=k, categorize=False)[at] if len(at) else np.zeros(0, U64)
              for k in ("titlelake-gram-1", "titlelake-gram-2"))
    lens = np.diff(count)
    return h1, h2, lens[lens > 0]


def grams(h: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` tokens from each place on."""
    g = mixed(h[at])
    for j in range(1, n):
        g = mixed(g * STEP + h[at + j])
    return g


def in_turn(g1: np.ndarray, g2: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The different occurrences (gram, i) of a chunk in order of their first hash: both hashes, whether several texts
    have it, and the text that has it. The grams of a text are given in its order, and texts one after the other."""
    o = np.argsort(g1, kind="stable")
    a, b, t = g1[o], g2[o], text[o]
    place = np.arange(len(a))
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (t[1:] != t[:-1])
    i = (place - np.maximum.accumulate(np.where(new, place, 0))).astype(U64)
    again = np.flatnonzero(i)
    if len(again):
        a[again] = mixed(a[again] + i[again] * SALT_1)
        b[again] = mixed(b[again] + i[again] * SALT_2)
        o = np.argsort(a, kind="stable")
        a, b, t = a[o], b[o], t[o]
    first = np.ones(len(a), bool)
    first[1:] = a[1:] != a[:-1]
    first = np.flatnonzero(first)
    return a[first], b[first], np.diff(np.append(first, len(a))) > 1, t[first]


# ------------------------------------------------------------ chunks
def _stored(texts: list[pa.Array]) -> bytes:
    out = pa.BufferOutputStream()
    batch = pa.record_batch([pa.concat_arrays(texts)], ["t"])
    with pa.ipc.new_stream(out, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(batch)
    return out.getvalue().to_pybytes()


def _read(stored: bytes) -> pa.Array:
    return pa.ipc.open_stream(stored).read_all().column("t").combine_chunks()


def chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``texts``: stored chunks."""
    held, size, n = [], 0, 0
    for batch in batches:
        texts = pc.drop_null(batch.column(0)).cast(pa.large_string())
        while len(texts):
            length = np.asarray(pc.binary_length(texts))
            # mostly as many tokens; other white space is left to CHUNK_BYTES (a token takes two bytes)
            words = 1 + sum(np.asarray(pc.count_substring(texts, x)) for x in " \n\t")
            over = (size + np.cumsum(length) > CHUNK_BYTES) | (n + np.cumsum(words) > CHUNK_TOKENS)
            take = int(np.argmax(over)) if over.any() else len(texts)
            if take == 0 and not held:
                take = 1
            if take:
                held.append(texts[:take])
                size, n, texts = size + int(length[:take].sum()), n + int(words[:take].sum()), texts[take:]
            if len(texts):
                yield pa.record_batch([pa.array([_stored(held)], pa.binary())], ["texts"])
                held, size, n = [], 0, 0
    if held:
        yield pa.record_batch([pa.array([_stored(held)], pa.binary())], ["texts"])


def _rows(key: int, n: int, k: int, bits: int, a: np.ndarray, b: np.ndarray, shared: np.ndarray, holder: np.ndarray, n_texts: int) -> Iterator[tuple]:
    """A row of ``SENT`` for each range that has hashes; where there are few, plain numbers and ``m`` below 0."""
    ends = [*np.searchsorted(a, np.arange(1 << bits, dtype=U64) << U64(64 - bits)).tolist(), len(a)]
    v = (a << U64(bits)) | (b >> U64(64 - bits))
    if few := len(v) < FEW << bits:
        plain, flags, holders = v.astype("<u8").tobytes(), shared.astype(np.uint8).tobytes(), holder.astype("<i4").tobytes()
    width = max(n_texts - 1, 1).bit_length()
    for h, (i, j) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
        if i < j and few:
            yield key, h, n, k, i - j, plain[8 * i:8 * j], flags[i:j], holders[4 * i:4 * j]
        elif i < j:
            yield key, h, n, k, j - i, pack(v[i:j]), _bits(shared[i:j]), bytes([width]) + pack_plain(holder[i:j][~shared[i:j]].astype(U64), width)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


SENT_ARROW = pa.schema([("key", pa.int64()), ("h", pa.int32()), ("n", pa.int32()), ("k", pa.int64()), ("m", pa.int32()),
                        ("hashes", pa.binary()), ("shared", pa.binary()), ("texts", pa.binary())])
LOST_ARROW = pa.schema([("key", pa.int64()), ("n", pa.int32()), ("k", pa.int64()), ("m", pa.int32()), ("texts", pa.binary())])


def send(orders: Sequence[int], bits: int = RANGE_BITS):
    """``key, texts, k`` to ``SENT``: the hashes of each order; of order 0 (and none of it has to meet) the texts' lengths."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, stored, k in zip(*batch.columns, strict=True):
                key, k = key.as_py(), k.as_py()
                h1, h2, lens = tokens(_read(stored.as_buffer()))
                text = np.repeat(np.arange(len(lens), dtype=np.int32), lens)
                left = np.repeat(np.cumsum(lens), lens) - np.arange(len(h1))
                for n in orders:
                    if n == 0:
                        rows = [(key, key % (1 << bits), 0, k, 0, lens.astype("<i4").tobytes(), None, None)]
                    else:
                        at = np.flatnonzero(left >= n)
                        a, b, shared, holder = in_turn(grams(h1, at, n), grams(h2, at, n), text[at])
                        rows = list(_rows(key, n, k, bits, a, b, shared | (k > 1), holder, len(lens)))
                    yield _batch(rows, SENT_ARROW)
    return run


def _by_range(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows of ``SENT`` sorted by h, in lists that no range crosses."""
    held, size = [], 0
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if size > MEET_BYTES and row[1] != held[-1][1]:
                yield held
                held, size = [], 0
            held.append(row)
            size += len(row[5])
    if held:
        yield held


def _lone(rows: list[tuple], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Of rows of one order: for each lone occurrence the number of its row, and its text."""
    plain = np.array([r[4] < 0 for r in rows])
    sizes = np.array([abs(r[4]) for r in rows])
    v = np.concatenate([np.frombuffer(r[5], "<u8") if r[4] < 0 else unpack(r[5], r[4]) for r in rows])
    shared = np.concatenate([np.frombuffer(r[6], bool) if r[4] < 0 else _flags(r[6], r[4]) for r in rows])
    row = np.repeat(np.arange(len(rows)), sizes)
    # plain rows have a text for each hash, packed ones for each that is not shared
    holder = np.zeros(len(v), np.int64)
    holder[plain[row]] = np.frombuffer(b"".join(r[7] for r in rows if r[4] < 0), "<i4")
    packed = [unpack_plain(r[7][1:], len(r[7][1:]) * 8 // r[7][0], r[7][0])[:own] for r, own in zip(
        rows, np.bincount(row[~shared], minlength=len(rows)), strict=True) if r[4] > 0]
    holder[~plain[row] & ~shared] = np.concatenate(packed) if packed else 0
    upper = (np.repeat(np.array([r[1] for r in rows], U64), sizes) << U64(64 - bits)) | (v >> U64(bits))
    o = np.argsort(upper, kind="stable")
    a, b = upper[o], v[o]
    if np.any((a[1:] == a[:-1]) & (b[1:] != b[:-1])):  # told apart by the last bits, so these have to be in order too
        o = np.lexsort((v, upper))
        a, b = upper[o], v[o]
    same = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
    met = shared[o]
    met[1:] |= same
    met[:-1] |= same
    o = o[~met]
    return row[o], holder[o]


def pack_steps(v: np.ndarray) -> tuple[int, bytes]:
    """Sorted small numbers, at least one, some of them equal: how many, and a bit string that steps through
    them; below 0 where plain numbers are shorter."""
    m, n = len(v), len(v) + int(v[-1]) + 1
    if 4 * m <= n // 8:
        return -m, v.astype("<i4").tobytes()
    steps = np.zeros(n, np.uint8)
    steps[v + np.arange(m)] = 1
    return m, _bits(steps)


def unpack_steps(m: int, data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<i4") if m < 0 else np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8))) - np.arange(m)


def meet(bits: int = RANGE_BITS):
    """``SENT`` to ``LOST``: for each lone occurrence of a chunk its text; of order 0 the texts' lengths."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_range(batches):
            out = [(r[0], 0, r[3], 0, r[5]) for r in rows if r[2] == 0]
            for n in sorted({r[2] for r in rows} - {0}):
                of = [r for r in rows if r[2] == n]
                row, holder = _lone(of, bits)
                keys, of_key = np.unique(np.array([r[0] for r in of]), return_inverse=True)
                lone = np.sort((of_key[row].astype(np.int64) << 32) | holder)
                cuts = np.searchsorted(lone, np.arange(len(keys) + 1) << 32).tolist()
                out += [(int(key), n, 0, *pack_steps(lone[i:j] & 0xFFFFFFFF)) for key, i, j in zip(keys, cuts[:-1], cuts[1:], strict=True) if i < j]
            yield _batch(out, LOST_ARROW)
    return run


def count_lost(max_n: int):
    """``LOST`` of one chunk: a row for each of its texts."""
    def run(table: pa.Table) -> pa.Table:
        rows = list(zip(*(table.column(c).to_pylist() for c in ("n", "k", "m", "texts")), strict=True))
        k, lens = next((k, np.frombuffer(texts, "<i4")) for n, k, _, texts in rows if n == 0)
        lost = np.zeros((max_n, len(lens)), np.int32)
        for n, _, m, texts in rows:
            if n:
                lost[n - 1] += np.bincount(unpack_steps(m, texts), minlength=len(lens)).astype(np.int32)
        return pa.table([np.full(len(lens), k, np.int64), lens, *lost], names=["k", "len", *map(str, range(1, max_n + 1))])
    return run


def lone_counts(texts: DataFrame, max_n: int, hold: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Of a table of one text column: ``k, len, 1 .. max_n``, the number of tokens of each text that has any, and how many of its
    grams of each order it alone has. ``k``: so many times all of its chunk is there. Lazy without ``hold``, which
    stores a table, frees what was shuffled for it and returns the stored one."""
    if hold is None:  # a task that runs again has to cut the same chunks; with hold, none runs again once they are stored
        texts = texts.sortWithinPartitions(F.xxhash64(texts.columns[0]), texts.columns[0])
    chunks = texts.mapInArrow(chunked, "texts binary")
    # equal chunks are one with a multiplicity
    chunks = chunks.groupBy(F.xxhash64("texts").alias("key")).agg(F.first("texts").alias("texts"), F.count(F.lit(1)).alias("k"))
    every = list(range(max_n + 1))
    steps = [every] if hold is None else [every[:3], *([n] for n in every[3:])]  # few unigrams are different
    stored, bits = hold or (lambda df: df), RANGE_BITS
    chunks = stored(chunks)
    if hold:
        bits = min(max(bits, chunks.count().bit_length()), MOST_RANGE_BITS)
    lost = [stored(chunks.mapInArrow(send(orders, bits), SENT).repartition("h").sortWithinPartitions("h").mapInArrow(meet(bits), LOST)) for orders in steps]
    schema = ", ".join(["k bigint", "len int", *(f"`{n}` int" for n in range(1, max_n + 1))])
    return reduce(DataFrame.unionByName, lost).groupBy("key").applyInArrow(count_lost(max_n), schema)

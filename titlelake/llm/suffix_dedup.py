"""Removal of byte strings that occur more than once, by suffix arrays.

Every string of ``length`` bytes that starts in two places is removed in both.
The shards are content defined.  A string's *anchor* is the smallest hash
among its ``GRAM``-byte substrings, so equal strings have equal anchors, and the
starts of one document that share an anchor form a *block*:

1. One scan lists the blocks (anchor, hash of the block's bytes, place).  Only
   anchors that occur again can hold a repeat; blocks whose bytes occur again are
   removed whole, by counts alone, however often a text is copied.
2. What differs under one anchor meets in a shard: a suffix array by
   Larsson-Sadakane refinement over the blocks' strings whose hash occurs again
   there, common prefixes of neighbours by Kasai's method, and a start is a
   repeat where a neighbour shares ``length`` bytes.
3. An anchor with more than ``SHARD_BLOCKS`` different blocks is dealt over
   several shards.  Each sends the sorted fingerprints of its different strings,
   cut into ranges, and ranges of the same anchor are merged by binary search:
   a string that no shard holds twice but two shards hold is found there.

Strings are judged on the input; overlapping and touching ones make one
removed run.  Cases: a null text is empty; a text shorter than ``length`` bytes keeps
everything; copies, rows repeated in identifier and text among them, lose all
that lies in a repeated string; long and periodic texts are cut
into blocks of at most ``BLOCK_STARTS`` starts under the same anchor, so no step
holds more than a shard; an empty table gives an empty result.

Both forms can also look for passages by their number of words: the same
search runs over texts written as one ``CODE``-byte hash a word, so a passage of so many
words is a string of fixed length, however short the words are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from titlelake.llm.common import column, doc_rows, pieces, settled, small_batches, stored, stored_so_far, texts_of
from titlelake.llm.shingles import _hashes, mix

GRAM = 128
#: Bytes of a word's hash, and of the substrings that anchors are taken from in texts of such hashes.
CODE, CODE_GRAM = 4, 64
BLOCK_STARTS, CHUNK_STARTS = 4096, 1 << 20
#: Different blocks of an anchor in one shard, and the bytes at which a task starts the next suffix array.
SHARD_BLOCKS, SHARD_BYTES = 2000, 1 << 20
_BASE, _BASE2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def rolling(data: np.ndarray, width: int, base: np.uint64) -> np.ndarray:
    """Polynomial hash of the ``width`` bytes from each place on, by doubling."""
    n = len(data) - width + 1
    have, size, power = data.astype(np.uint64) + np.uint64(1), 1, base
    out, out_size = None, 0
    while True:
        if width & size:
            if out is None:
                out, out_size = have, size
            else:  # what is there, then the next ``size`` bytes
                m = len(data) - out_size - size + 1
                out = out[:m] * power + have[out_size : out_size + m]
                out_size += size
        if size * 2 > width:
            return out[:n]
        m = len(data) - 2 * size + 1
        have = have[:m] * power + have[size : size + m]
        power, size = np.uint64(int(power) ** 2 & (1 << 64) - 1), size * 2


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        x = np.minimum(x[: len(x) - size], x[size:])
        size *= 2
    rest = width - size
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def blocks_of(data: bytes, length: int, gram: int = GRAM) -> list[tuple[int, int, int, int, bool]]:
    """``anchor, first start, last start, hash of the bytes, again`` of each block; ``again``: the anchor's hash stands in several places of the text."""
    n = len(data) - length + 1
    if n <= 0:
        return []
    raw, wide = np.frombuffer(data, np.uint8), length - gram + 1
    anchor, first, seen, before = [], [], [], np.uint64(0)
    for at in range(0, n, CHUNK_STARTS):
        part = raw[at : min(n, at + CHUNK_STARTS) + length - 1]
        grams = mix(rolling(part, gram, _BASE))
        least = sliding_min(grams, wide)
        cut = np.append(0, np.flatnonzero(least[1:] != least[:-1]) + 1)
        anchor.append(least[cut])
        first.append(cut + at)
        own = grams[: len(least)] if at + CHUNK_STARTS < n else grams  # a place counts in one chunk
        # the windows of the chunk before reach into this one, with anchors of their own
        seen.append(own[own <= max(least.max(), before)])
        before = least[-wide:].max()
    anchor, first, seen = np.concatenate(anchor), np.concatenate(first), np.sort(np.concatenate(seen))
    fresh = np.append(True, anchor[1:] != anchor[:-1])
    anchor, first = anchor[fresh], first[fresh]
    again = np.searchsorted(seen, anchor, side="right") - np.searchsorted(seen, anchor) > 1
    out, ends = [], np.append(first[1:], n).tolist()
    for v, lo, end, more in zip(anchor.view(np.int64).tolist(), first.tolist(), ends, again.tolist()):
        for a in range(lo, end, BLOCK_STARTS):
            b = min(end, a + BLOCK_STARTS) - 1
            out.append((v, a, b, xxhash.xxh3_64_intdigest(data[a : b + length]) - (1 << 63), more))
    return out


def suffix_array(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order and each one's place, by Larsson-Sadakane refinement:
    start from the order of seven bytes; each round sorts only the groups that are still
    equal, by the places of what follows, and doubles the compared length."""
    n, depth = len(text), 7
    key, ends = np.zeros(n, np.int64), np.append(text.astype(np.int64) + 1, np.zeros(depth, np.int64))
    for i in range(depth):
        key = key << 9 | ends[i : n + i]
    sa = np.argsort(key, kind="stable")
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    open_, group = np.arange(n), key[sa]
    while True:
        head = np.append(True, group[1:] != group[:-1])
        place = open_[np.flatnonzero(head)[np.cumsum(head) - 1]]
        rank[sa[open_]] = place
        tail = np.append(head[1:], True)
        more = ~(head & tail)
        open_ = open_[more]
        if not len(open_):
            return sa, rank[:n]
        own = sa[open_]
        group = place[more] * (n + 1) + rank[np.minimum(own + depth, n)] + 1
        order = np.argsort(group, kind="stable")
        sa[open_], group = own[order], group[order]
        depth *= 2


def common_prefixes(text: np.ndarray, sa: np.ndarray, rank: np.ndarray, begin: np.ndarray, most: int) -> np.ndarray:
    """Bytes (at most ``most``) that each suffix shares with the one before it in order.

    Kasai: from a place to the next the shared length falls by one at most, and by just one where the
    bytes before both suffixes are equal.  So bytes are compared at the other places only, and at the
    blocks' (they begin at ``begin``): within a block no place is further from a compared one than its size."""
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    longest = most + int(np.diff(np.append(begin, n)).max())
    padded = np.append(text, np.zeros(8, np.uint8))
    eight = np.zeros(n + 1, np.uint64)
    for i in range(8):
        eight = eight << np.uint64(8) | padded[i : i + n + 1]
    before = np.append(-1, sa[:-1])[rank]  # by place in the text
    compared = np.append(True, (before[1:] < 1) | (text[:-1] != text[before[1:] - 1]))
    compared[begin] = True
    at = np.flatnonzero(compared & (before >= 0))
    pair, held, go = before[at], np.zeros(len(at), np.int64), np.arange(len(at))
    while len(go):
        a, b = at[go] + held[go], pair[go] + held[go]
        room = np.minimum(np.minimum(n - a, n - b), longest - held[go])
        differ = eight[a] ^ eight[b]
        same = np.full(len(go), 8)
        end = np.flatnonzero(differ)
        # equal leading bytes of the eight
        last = differ[end]
        lead = np.zeros(len(end), np.int64)
        for k in range(1, 8):
            lead[last >> np.uint64(64 - 8 * k) == 0] = k
        same[end] = lead
        gain = np.minimum(same, room)
        held[go] += gain
        go = go[(gain == 8) & (room > 8)]
    shared = np.zeros(n, np.int64)
    shared[at] = held
    place = np.arange(n)
    near = np.maximum.accumulate(np.where(compared, place, 0))
    out = np.empty(n, np.int64)
    out[rank] = np.clip(shared[near] - (place - near), 0, most)
    return out


class Shard:
    """Blocks that one suffix array covers."""

    def __init__(self, length: int) -> None:
        self.length, self.rows, self.size = length, [], 0

    def add(self, row: dict) -> None:
        self.rows.append(row)
        self.size += len(row["data"])

    def thin(self) -> None:
        """Leave out the starts whose string's hash stands once in the shard: equal strings have equal hashes, so no
        repeat is lost, and the suffix array tells what is left.  Anchors over several shards stay whole."""
        text = np.frombuffer(b"".join(r["data"] for r in self.rows), np.uint8)
        size = np.array([len(r["data"]) for r in self.rows])
        begin = np.cumsum(size) - size
        edge = np.zeros(len(text) + 1, np.int8)
        edge[begin] = 1
        edge[begin + size - self.length + 1] -= 1
        place = np.flatnonzero(np.cumsum(edge[:-1], dtype=np.int8))
        prints = rolling(text, self.length, _BASE2)[place]
        order = np.argsort(prints)
        same = prints[order[1:]] == prints[order[:-1]]
        again = place[np.sort(order[np.append(False, same) | np.append(same, False)])]
        rows = []
        for r, at, a, b in zip(self.rows, begin.tolist(), np.searchsorted(again, begin).tolist(), np.searchsorted(again, begin + size).tolist()):
            if r["deal"] > 1:
                rows.append(r)
            elif a < b:  # starts further apart than a string's length become blocks of their own
                for own in np.split(again[a:b] - at, np.flatnonzero(np.diff(again[a:b]) > self.length) + 1):
                    lo, hi = int(own[0]), int(own[-1]) + self.length
                    rows.append({**r, "lo": r["lo"] + lo, "data": r["data"][lo:hi]})
        self.rows = rows

    def repeats(self) -> Iterator[dict]:
        """Runs of repeated starts, and for anchors over several shards the ranges of fingerprints."""
        if self.rows:
            self.thin()
        if not self.rows:
            return
        text = np.frombuffer(b"".join(r["data"] for r in self.rows), np.uint8)
        size = np.array([len(r["data"]) for r in self.rows])
        begin = np.cumsum(size) - size
        sa, rank = suffix_array(text)
        shared = common_prefixes(text, sa, rank, begin, self.length)
        starts = np.zeros(len(text), bool)
        for b, n in zip(begin.tolist(), size.tolist()):
            starts[b : b + n - self.length + 1] = True
        at = np.flatnonzero(starts[sa])
        # least common prefix on the way from one start to the next in order
        way = np.minimum.reduceat(np.append(shared, 0), at + 1) if len(at) else np.zeros(0, np.int64)
        same = way[:-1] >= self.length
        again = np.zeros(len(text), bool)
        again[sa[at]] = np.append(False, same) | np.append(same, False)
        leader = np.zeros(len(text), bool)  # one start for each different string
        leader[sa[at]] = np.append(True, ~same)[: len(at)]
        prints = None
        for r, b, n in zip(self.rows, begin.tolist(), size.tolist()):
            if r["n"] == 1:
                edge = np.diff(np.concatenate([[0], again[b : b + n - self.length + 1].view(np.int8), [0]]))
                for lo, hi in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()):
                    yield {"k1": r["k1"], "k2": r["k2"], "lo": r["lo"] + lo, "hi": r["lo"] + hi - 1 + self.length}
        groups: dict[tuple, list[int]] = {}
        for i, r in enumerate(self.rows):
            if r["deal"] > 1:
                groups.setdefault((r["v"], r["salt"]), []).append(i)
        for (v, salt), own in groups.items():
            if prints is None:
                prints = mix(rolling(text, self.length, _BASE2))
            place = np.concatenate([begin[i] + np.arange(size[i] - self.length + 1) for i in own])
            block = np.repeat(np.array(own), [size[i] - self.length + 1 for i in own])
            kept = leader[place]
            place, block = place[kept], block[kept]
            # a string found here already, or in a block that is removed whole, only answers
            asks = ~again[place] & (np.array([r["n"] for r in self.rows])[block] == 1)
            order = np.argsort(prints[place])
            place, block, asks = place[order], block[order], asks[order]
            own_print = prints[place]
            bits = max(1, (self.rows[own[0]]["deal"] - 1).bit_length())
            cut = (own_print >> np.uint64(64 - bits)).astype(np.int64)
            for part in np.split(np.arange(len(place)), np.flatnonzero(np.diff(cut)) + 1):
                if not len(part):
                    continue
                get = lambda name: np.array([self.rows[i][name] for i in block[part].tolist()], np.int64)
                start = np.where(asks[part], get("lo") + place[part] - begin[block[part]], -1)
                yield {"v": v, "part": int(cut[part[0]]), "salt": salt, "prints": own_print[part].tobytes(),
                       "refs": np.stack([get("k1"), get("k2"), start]).tobytes()}


def merge_runs(runs: list[tuple[bytes, bytes]], length: int) -> Iterator[dict]:
    """Starts of one run whose string another run holds, by binary search of each in the others."""
    own = [(np.frombuffer(p, np.uint64), np.frombuffer(r, np.int64).reshape(3, -1)) for p, r in runs]
    for i, (prints, refs) in enumerate(own):
        asks = refs[2] >= 0
        want, found = prints[asks], np.zeros(int(asks.sum()), bool)
        for j, (other, _) in enumerate(own):
            if i != j and len(want):
                at = np.minimum(np.searchsorted(other, want), len(other) - 1)
                found |= other[at] == want
        for k1, k2, lo in refs[:, asks][:, found].T.tolist():
            yield {"k1": k1, "k2": k2, "lo": lo, "hi": lo + length}


RUNS = pa.schema([("v", pa.int64()), ("part", pa.int32()), ("salt", pa.int32()), ("prints", pa.binary()), ("refs", pa.binary()),
                  ("k1", pa.int64()), ("k2", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64())])
RUNS_DDL = "v bigint, part int, salt int, prints binary, refs binary, k1 bigint, k2 bigint, lo bigint, hi bigint"


def _batches(rows: Iterator[dict], schema: pa.Schema, count: int = 5000) -> Iterator[pa.RecordBatch]:
    held = []
    for r in rows:
        held.append(r)
        if len(held) >= count:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _keys() -> tuple[Column, Column]:
    """Tell a document by a hash of identifier and text, and the identifier itself."""
    return F.xxhash64("doc_id", "text").alias("k1"), F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0)).alias("k2")


def text_bytes(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def word_codes(text: str) -> bytes:
    """``CODE`` bytes for each word; words are runs without ASCII white space, told apart by case."""
    own = text_bytes(text).split()
    return np.fromiter(map(_hashes.__getitem__, own), np.uint64, len(own)).astype("<u4").tobytes()


def word_ranges(text: str, spans: list[tuple[int, int]], words: int) -> list[tuple[int, int]]:
    """Byte ranges in the text of repeated strings of ``words`` codes: only those that start at a word."""
    raw = np.frombuffer(text_bytes(text), np.uint8)
    space = np.concatenate([[True], (raw == 32) | (raw >= 9) & (raw <= 13), [True]])
    first, last = np.flatnonzero(space[:-1] & ~space[1:]), np.flatnonzero(~space[:-1] & space[1:])
    out = []
    for lo, hi in spans:
        a, b = -(-lo // CODE), (hi - words * CODE) // CODE
        if a <= b:
            out.append((int(first[a]), int(last[b + words - 1])))
    return out


def find_repeats(keyed: DataFrame, length: int, encode: Callable[[str], bytes] = text_bytes, gram: int = GRAM) -> DataFrame:
    """``k1, k2, spans`` (byte ranges, end exclusive, that may overlap) of the documents that hold a repeat."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                found, row = [], []
                for i, t in enumerate(texts_of(part)):
                    own = blocks_of(encode(t), length, gram)
                    found += own
                    row += [i] * len(own)
                cols = list(zip(*found)) or [[]] * 5
                at = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays([
                    column(part, "k1").take(at), column(part, "k2").take(at), pa.array(cols[0], pa.int64()), pa.array(cols[3], pa.int64()),
                    pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[4], pa.bool_())], ["k1", "k2", "v", "c", "lo", "hi", "again"])

    blocks = stored(keyed.mapInArrow(scan, "k1 bigint, k2 bigint, v bigint, c bigint, lo bigint, hi bigint, again boolean"), "blocks")
    anchors = blocks.groupBy("v").agg(F.count(F.lit(1)).alias("n"), F.max("again").alias("again")).filter("n > 1 or again").select("v")
    near = stored(blocks.join(anchors, "v", "left_semi"), "near")
    # counts are tables of their own: a join of two tables on a hot anchor can be split, one with an aggregate can't
    contents = stored(near.groupBy("v", "c").agg(F.count(F.lit(1)).alias("n"), F.max("again").alias("again"), F.min(F.struct("k1", "k2", "lo", "hi")).alias("one")), "contents")
    whole = near.join(contents.filter("n > 1").select("v", "c"), ["v", "c"]).select("k1", "k2", "lo", (F.col("hi") + length).alias("hi"))
    several = stored(contents.groupBy("v").agg(F.count(F.lit(1)).alias("m"), F.max("again").alias("again")).filter("m > 1 or again").select("v", "m"), "several")
    deal = F.ceil(F.col("m") / SHARD_BLOCKS).cast("int")
    open_ = contents.select("v", "c", "n", "one.*").join(several, "v").select("*", deal.alias("deal"))
    open_ = open_.withColumn("salt", F.pmod(F.xxhash64("c"), "deal").cast("int"))
    want = open_.groupBy("k1", "k2").agg(F.collect_set(F.struct("v", "n", "deal", "salt", "lo", "hi")).alias("want"))  # a document's own blocks

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("v", pa.int64()), ("n", pa.int64()), ("deal", pa.int32()), ("salt", pa.int32()), ("k1", pa.int64()), ("k2", pa.int64()), ("lo", pa.int64()), ("data", pa.binary())])
        for batch in batches:
            for part in pieces(batch, 1 << 20):
                def rows():
                    for k1, k2, t, own in zip(*(column(part, c).to_pylist() for c in ("k1", "k2", "text", "want"))):
                        data = encode(t)
                        for x in own:
                            yield {"v": x["v"], "n": x["n"], "deal": x["deal"], "salt": x["salt"], "k1": k1, "k2": k2, "lo": x["lo"], "data": data[x["lo"] : x["hi"] + length]}
                yield from _batches(rows(), schema)

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            shard, last = Shard(length), None
            for batch in batches:
                for r in batch.to_pylist():
                    now = (r["v"], r["salt"])
                    if now != last and shard.size >= SHARD_BYTES:
                        yield from shard.repeats()
                        shard = Shard(length)
                    last = now
                    shard.add(r)
            yield from shard.repeats()
        yield from _batches(rows(), RUNS, 500)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            runs, last = [], None
            for batch in batches:
                for r in batch.to_pylist():
                    if r["prints"] is None:
                        yield r
                        continue
                    if (r["v"], r["part"]) != last:
                        yield from merge_runs(runs, length)
                        runs, last = [], (r["v"], r["part"])
                    runs.append((r["prints"], r["refs"]))
            yield from merge_runs(runs, length)
        spans = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64())])
        yield from _batches(({k: r[k] for k in ("k1", "k2", "lo", "hi")} for r in rows()), spans)

    once = keyed.join(want, ["k1", "k2"])
    data = once.mapInArrow(fetch, "v bigint, n bigint, deal int, salt int, k1 bigint, k2 bigint, lo bigint, data binary")
    # as many tasks as the session's shuffles have: the work of a shard is far more than its bytes say
    tasks = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards = data.repartition(tasks, "v", "salt").sortWithinPartitions("v", "salt").mapInArrow(sort, RUNS_DDL)
    # finished runs are spread by document; fingerprint ranges meet by anchor and range
    by = F.when(F.col("prints").isNull(), F.xxhash64("k1")).otherwise(F.xxhash64("v", "part"))
    found = shards.withColumn("by", by).repartition("by").sortWithinPartitions("v", "part").mapInArrow(merge, "k1 bigint, k2 bigint, lo bigint, hi bigint")
    return whole.unionByName(found).groupBy("k1", "k2").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))


def union_of(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of the ranges; touching ones are one."""
    out: list[list[int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [tuple(x) for x in out]


def cut(data: bytes, runs: list[tuple[int, int]]) -> bytes:
    at, kept = 0, []
    for lo, hi in runs:
        kept.append(data[at:lo])
        at = hi
    return b"".join([*kept, data[at:]])


def _spans_of(value) -> list[tuple[int, int]]:
    return union_of([(x["lo"], x["hi"]) for x in (() if value is None else value)])


def keyed_docs(docs: DataFrame) -> DataFrame:
    return doc_rows(docs).select("doc_id", "text", *_keys())


def _found(keyed: DataFrame, length: int, words: int | None) -> DataFrame:
    """``k1, k2, spans, word_spans``: byte ranges, and ranges in the texts' word codes where ``words`` is given."""
    mark = stored_so_far()
    spans = find_repeats(keyed, length).withColumn("word_spans", F.lit(None).cast("array<struct<lo:bigint,hi:bigint>>"))
    if words is None:
        return spans
    # each search's tables go before the next one's are written
    spans = settled(spans, "byte-spans", mark)
    mark = stored_so_far()
    found = settled(find_repeats(keyed, words * CODE, word_codes, CODE_GRAM), "word-spans", mark)
    return spans.drop("word_spans").join(found.withColumnRenamed("spans", "word_spans"), ["k1", "k2"], "full")


def _check(length: int, words: int | None) -> None:
    if length < GRAM:
        raise ValueError(f"length must be {GRAM} at least")
    if words is not None and words * CODE < CODE_GRAM:
        raise ValueError(f"words must be {CODE_GRAM // CODE} at least")


def remove_repeats(docs: DataFrame, length: int = 400, words: int | None = None) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans, text`` of every document: the digest is of
    the bytes kept, ``text`` is what they spell, where a character that a run covers in part stays.

    Where ``words`` is given, a last column ``n_passages`` counts the maximal runs of repeated passages of so many
    words, in any white space and of any number of bytes, and ``text`` is without them too; the other columns stay as they are."""
    _check(length, words)
    small_batches(docs.sparkSession)
    keyed = keyed_docs(docs)
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "text"] + ["n_passages"] * (words is not None)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                texts = texts_of(part)
                data = [t.encode("utf-8", "surrogatepass") for t in texts]
                runs = [_spans_of(x) for x in column(part, "spans").to_pylist()]
                passages = [_passages(t, x, words) for t, x in zip(texts, column(part, "word_spans").to_pylist())]
                gone = [union_of(r + p) for r, p in zip(runs, passages)]
                cols = [
                    column(part, "doc_id"), pa.array([len(d) for d in data], pa.int64()), pa.array([sum(b - a for a, b in r) for r in runs], pa.int64()),
                    pa.array([len(r) for r in runs], pa.int64()), pa.array([hashlib.sha256(cut(d, r)).hexdigest() for d, r in zip(data, runs)]),
                    pa.array([[list(x) for x in r] for r in runs], pa.list_(pa.list_(pa.int64()))),
                    pa.array([whole_characters(t, g) if g else t for t, g in zip(texts, gone)], pa.string()), pa.array([len(p) for p in passages], pa.int64())]
                yield pa.RecordBatch.from_arrays(cols[: len(names)], names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return keyed.join(_found(keyed, length, words), ["k1", "k2"], "left").select("doc_id", "text", "spans", "word_spans").mapInArrow(
        digest, f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<array<bigint>>, text string" + ", n_passages bigint" * (words is not None))


def _passages(text: str, value, words: int | None) -> list[tuple[int, int]]:
    """Maximal byte ranges in the text of its word spans."""
    return [] if value is None else union_of(word_ranges(text, [(x["lo"], x["hi"]) for x in value], words))


def without_repeats(docs: DataFrame, length: int = 400, words: int | None = None) -> DataFrame:
    """The documents with their repeated runs cut out of ``text``: strings of ``length``
    bytes, and where ``words`` is given passages of so many words too, in any white space.  A character
    that a run covers in part stays.  Other columns stay as they are, but for
    ``n_chars``, which follows the text where there is one."""
    _check(length, words)
    small_batches(docs.sparkSession)
    spans = _found(keyed_docs(docs), length, words)

    @F.pandas_udf("string")
    def trimmed(text: pd.Series, value: pd.Series, by_word: pd.Series) -> pd.Series:
        return pd.Series([whole_characters(t, union_of(_spans_of(s) + _passages(t, w, words))) for t, s, w in zip(text, value, by_word)])

    names = docs.columns
    own = docs.withColumn("__text", F.coalesce("text", F.lit("")))
    k1, k2 = F.xxhash64("doc_id", "__text"), F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0))
    spans = spans.select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2"), F.col("spans").alias("__spans"), F.col("word_spans").alias("__words"))
    own = own.withColumn("__a", k1).withColumn("__b", k2).join(spans, (F.col("__a") == F.col("__k1")) & (F.col("__b") == F.col("__k2")), "left")
    own = own.withColumn("text", F.when(F.col("__k1").isNull(), F.col("text")).otherwise(trimmed("__text", "__spans", "__words")))
    if "n_chars" in names:
        own = own.withColumn("n_chars", F.when(F.col("__k1").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return own.select(*names)


def whole_characters(text: str, runs: list[tuple[int, int]]) -> str:
    data, out = text.encode("utf-8", "surrogatepass"), []
    inside = lambda i: i < len(data) and data[i] & 0xC0 == 0x80
    for lo, hi in runs:
        while inside(lo):
            lo += 1
        while inside(hi):
            hi -= 1
        if hi > lo:
            out.append((lo, hi))
    return cut(data, out).decode("utf-8", "surrogatepass")

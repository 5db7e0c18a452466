"""BPE encoding by speculation and verification, and decoding.

Speculate: cut each new word greedily into the longest tokens.  Verify: a
cut is the merge order's own result exactly if each adjacent pair of its
tokens, merged from their bytes alone, gives that pair back; all pairs of a batch
of words are looked up at once in a sorted array of judged pairs, and a new pair is
judged once.  Words with a failing pair are merged exactly, by rank.  A
worker remembers words and pairs, so the exact merge runs for a small
share of what it reads.

Cases: a null or empty text has no id and decodes to the empty text; an added token's
string becomes its id; words of any length are merged with a heap, in
n log n; equal texts have equal ids; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import json
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from titlelake.llm.common import column, doc_rows, pieces, small_batches, texts_of
from titlelake.llm.pretoken import words
from titlelake.llm.tokens import LONG_WORD, byte_alphabet

#: Words remembered for each worker, in each of two generations.
CACHE_WORDS = 400_000
#: Pairs judged and remembered for each worker.
CACHE_PAIRS = 2_000_000
#: A pair's second place for a token that is a word by itself.
ALONE = (1 << 31) - 1


class Codec:
    """Byte-level BPE of a public vocabulary file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        cut = spec.get("pre_tokenizer") or {}
        if spec["model"]["type"] != "BPE" or spec.get("normalizer") or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space"):
            raise ValueError("a byte-level BPE file without normaliser or prefix space is needed")
        byte_of = {c: b for b, c in byte_alphabet().items()}
        raw = lambda token: bytes(byte_of[c] for c in token)
        vocab = spec["model"]["vocab"]
        self.id_of = {raw(t): i for t, i in vocab.items()}
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes_of = {i: b for b, i in self.id_of.items()} | {i: t.encode() for t, i in self.added.items()}
        self.rank: dict[int, int] = {}  # by first << 31 | second
        self.made: list[int] = []  # by rank
        for n, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.rank[vocab[left] << 31 | vocab[right]] = n
            self.made.append(vocab[left + right])
        self.single = [self.id_of[bytes([b])] for b in range(256)]
        self.longest: dict[bytes, int] = {}
        for token in self.id_of:
            self.longest[token[:2]] = max(len(token), self.longest.get(token[:2], 1))
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.pairs, self.good = np.zeros(0, np.int64), np.zeros(0, bool)
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def merge(self, data: bytes) -> list[int]:
        """Ids of the bytes by the merge order: always the pair of lowest rank, leftmost first."""
        ids = [self.single[b] for b in data]
        if len(ids) > 40:
            return self._merge_long(ids)
        rank, made, never = self.rank.get, self.made, len(self.made)
        ranks = [rank(a << 31 | b, never) for a, b in zip(ids, ids[1:])]
        while ranks and (best := min(ranks)) < never:
            i = ranks.index(best)
            ids[i] = made[best]
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank(ids[i - 1] << 31 | ids[i], never)
            if i < len(ranks):
                ranks[i] = rank(ids[i] << 31 | ids[i + 1], never)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        after = list(range(1, len(ids) + 1))
        before = list(range(-1, len(ids) - 1))
        rank, heap = self.rank, []

        def offer(i: int) -> None:
            j = after[i]
            if j < len(ids) and (got := rank.get(ids[i] << 31 | ids[j])) is not None:
                heapq.heappush(heap, (got, i, ids[i], ids[j]))

        for i in range(len(ids)):
            offer(i)
        while heap:
            best, i, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] == a else len(ids)
            if j >= len(ids) or ids[j] != b:
                continue  # one of the two has changed since
            ids[i], ids[j] = self.made[best], -1
            after[i] = after[j]
            if after[j] < len(ids):
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [x for x in ids if x >= 0]

    def greedy(self, data: bytes) -> list[int]:
        """The longest token at each place."""
        out, at, n = [], 0, len(data)
        find, longest = self.id_of.get, self.longest
        while at < n:
            for end in range(min(n, at + longest.get(data[at : at + 2], 1)), at, -1):
                got = find(data[at:end])
                if got is not None:
                    break
            out.append(got)
            at = end
        return out

    def _judge(self, pairs: np.ndarray) -> np.ndarray:
        """Whether each pair (first * 2**31 + second) stays as it is when merged from its bytes."""
        each, back = np.unique(pairs, return_inverse=True)
        at = np.searchsorted(self.pairs, each)
        known = at < len(self.pairs)
        known[known] = self.pairs[at[known]] == each[known]
        good = np.zeros(len(each), dtype=bool)
        good[known] = self.good[at[known]]
        new = np.flatnonzero(~known)
        for k in new:
            a, b = int(each[k]) >> 31, int(each[k]) & ALONE
            own = [a] if b == ALONE else [a, b]
            good[k] = self.merge(b"".join(self.bytes_of[x] for x in own)) == own
        if len(new):
            every = np.concatenate([self.pairs, each[new]]) if len(self.pairs) < CACHE_PAIRS else each[new]
            fine = np.concatenate([self.good, good[new]]) if len(self.pairs) < CACHE_PAIRS else good[new]
            order = np.argsort(every, kind="stable")
            self.pairs, self.good = every[order], fine[order]
        return good[back]

    def encode_words(self, new: list[str]) -> list[list[int]]:
        data = [w.encode("utf-8") for w in new]
        cut = [self.greedy(d) for d in data]
        n = np.array([len(c) for c in cut])
        flat = np.array([x for c in cut for x in c], dtype=np.int64)
        word = np.repeat(np.arange(len(cut)), n)
        last = np.append(word[1:] != word[:-1], True)
        pair = (flat << 31) | np.where(last, ALONE, np.append(flat[1:], ALONE))
        tested = ~last | np.repeat(n == 1, n)  # a word's last token is judged with the one before, or by itself
        bad = np.zeros(len(cut), dtype=bool)
        bad[word[tested][~self._judge(pair[tested])]] = True
        for k in np.flatnonzero(bad):
            cut[k] = self.merge(data[k])
        return cut

    def _encode_plain(self, texts: list[str]) -> list[bytes]:
        own = [words(t) for t in texts]
        out, known = [], self.known
        new = set().union(*own).difference(known)
        kept = {w: self.old[w] for w in new if w in self.old}
        todo = [w for w in new if w not in kept]
        if len(known) + len(new) > CACHE_WORDS:
            self.old = {w: v for w, v in known.items() if len(w) <= LONG_WORD}
            known = self.known = {}
            own_words = set().union(*own)
            kept |= {w: self.old[w] for w in own_words if w in self.old}
        known.update(kept)
        if todo:
            known.update((w, struct.pack(f"<{len(c)}I", *c)) for w, c in zip(todo, self.encode_words(todo)))
        get = known.__getitem__
        out = [b"".join(map(get, o)) for o in own]
        for w in todo:
            if len(w) > LONG_WORD:
                del known[w]
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit bytes."""
        if not self.split:
            return self._encode_plain(texts)
        parts = [self.split.split(t) if any(a in t for a in self.added) else [t] for t in texts]
        plain = iter(self._encode_plain([p for own in parts for p in own if p not in self.added]))
        return [b"".join(struct.pack("<I", self.added[p]) if p in self.added else next(plain) for p in own) for own in parts]

    def decode(self, ids: bytes) -> str:
        """Text of the ids; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


_open: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One per worker process and file."""
    if path not in _open:
        _open[path] = Codec(path)
    return _open[path]


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, ids`` (little-endian unsigned 32-bit) of every document."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            for part in pieces(batch):
                yield pa.RecordBatch.from_arrays([column(part, "doc_id"), pa.array(own.encode(texts_of(part)), pa.binary())], ["doc_id", "ids"])

    return doc_rows(docs).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids binary")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """``doc_id, ids, text`` of every row of ids (null ids: no id)."""
    small_batches(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            for part in pieces(batch):
                ids = column(part, "ids")
                yield pa.RecordBatch.from_arrays([column(part, "doc_id"), ids, pa.array([own.decode(x or b"") for x in ids.to_pylist()], pa.string())], ["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, ids binary, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: encode and decode in
    one pass, so that neither ids nor texts travel for the digests."""
    import hashlib

    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        decimal = {i: str(i) for i in own.bytes_of}
        sha = lambda s: hashlib.sha256(s.encode("utf-8")).hexdigest()
        for batch in batches:
            for part in pieces(batch):
                ids = own.encode(texts_of(part))
                yield pa.RecordBatch.from_arrays([
                    column(part, "doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([sha(",".join(map(decimal.__getitem__, np.frombuffer(x, "<u4").tolist()))) for x in ids]),
                    pa.array([sha(own.decode(x)) for x in ids]),
                ], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return doc_rows(docs).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")

import os
import random
import threading
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from titlelake.operators import lone_grams as lg


def brute_lost(texts, max_n=4):
    toks = [t.split() for t in texts if t and t.split()]
    cnt = [[Counter(tuple(t[i:i + n]) for i in range(len(t) - n + 1)) for n in range(1, max_n + 1)] for t in toks]
    out = []
    for i, t in enumerate(toks):
        others = [c for j, c in enumerate(cnt) if j != i]
        out.append((len(t), *(sum(max(0, c - max((o[n][g] for o in others), default=0)) for g, c in cnt[i][n].items()) for n in range(max_n))))
    return sorted(out)


def lost(parts, bits=lg.RANGE_BITS, steps=((0, 1, 2), (3,), (4,))):
    """What ``lone_counts`` does, without Spark: ``parts`` are the texts of tasks."""
    stored = Counter(c for part in parts for b in lg.chunked(iter([pa.record_batch([pa.array(part, pa.string())], ["t"])])) for c in b.column(0).to_pylist())
    chunks = pa.record_batch([pa.array(range(len(stored)), pa.int64()), pa.array(list(stored), pa.binary()), pa.array(list(stored.values()), pa.int64())],
                             names=["key", "texts", "k"])
    tables = []
    for orders in steps:
        sent = pa.Table.from_batches(list(lg.send(orders, bits)(iter([chunks])))).sort_by("h")
        tables += lg.meet(bits)(iter(sent.to_batches()))
    table = pa.Table.from_batches(tables)
    out = []
    for key in range(len(stored)):
        got = lg.count_lost(4)(table.filter(pa.compute.equal(table.column("key"), key))).to_pydict()
        k = got.pop("k")
        out += [row for row, m in zip(zip(*got.values(), strict=True), k, strict=True) for _ in range(m)]
    return sorted(out), len(stored)


def some_texts(n, words, size, seed):
    r = random.Random(seed)
    out = [" ".join(r.choice(words) for _ in range(r.randint(1, size))) for _ in range(n)]
    return [*out, *out[: n // 5], *(t + " end" for t in out[: n // 5]), "", "  ", None, " a b\x1cc ", "a a a a a", "a a a", "only\u0085here"]


@pytest.mark.parametrize("few", [0, 16])
@pytest.mark.parametrize("bits", [2, 10])
def test_lone_occurrences_match_brute_force(monkeypatch, few, bits):
    """Packed and plain rows, one and many chunks, equal chunks, and ranges that meet one by one."""
    monkeypatch.setattr(lg, "FEW", few)
    for tokens, met in ((1 << 20, 1 << 24), (40, 0)):
        monkeypatch.setattr(lg, "CHUNK_TOKENS", tokens)
        monkeypatch.setattr(lg, "MEET_BYTES", met)
        texts = some_texts(60, ["a", "b", "c", "the", "of", "wörd", "\U0001f600", "x" * 300], 25, 7)
        parts = [texts[:20], texts[20:], ["same text here", "and this"], ["same text here", "and this"], [None, " "], []]
        got, n = lost(parts, bits)
        assert got == brute_lost([t for p in parts for t in p])
        assert n == 4 if tokens > 40 else n > 8
        assert lost(parts, bits, steps=((0, 1, 2, 3, 4),))[0] == got


def test_plain_and_packed_rows_meet(monkeypatch):
    """A chunk of many hashes and one of few are packed in two ways."""
    monkeypatch.setattr(lg, "FEW", 20)
    texts = some_texts(80, [f"w{i}" for i in range(40)], 30, 3)
    assert lost([texts, ["w1 w2 w3 w1", "unseen w4"]], 2)[0] == brute_lost([*texts, "w1 w2 w3 w1", "unseen w4"])


def test_hashes_that_differ_in_the_last_bits_only_do_not_meet(monkeypatch):
    a, last = np.array([5 << 40, 9 << 40], np.uint64), [np.array([1 << 60, 0], np.uint64), np.array([2 << 60, 0], np.uint64)]
    for few in (0, 16):
        monkeypatch.setattr(lg, "FEW", few)
        rows = [r for key in range(3) for r in lg._rows(key, 1, 1, 10, a, last[key % 2], np.array([False, key == 2]), np.array([0, 1], np.int32), 2)]
        row, holder = lg._lone(rows, 10)
        assert [(rows[r][0], t) for r, t in zip(row, holder, strict=True)] == [(1, 0)]


def test_packing_returns_the_numbers():
    r = np.random.default_rng(1)
    for m in (1, 2, 3, 1000):
        v = np.sort(np.unique(r.integers(0, 1 << 64, m, dtype=np.uint64, endpoint=False)))
        v[-1] = (1 << 64) - 1
        assert (lg.unpack(lg.pack(v), len(v)) == v).all()
        assert len(lg.pack(v)) <= len(v) * (64 - len(v).bit_length() + 3) / 8 + 2
        steps = np.sort(r.integers(0, 5 * m, m))
        assert (lg.unpack_steps(*lg.pack_steps(steps)) == steps).all()
    assert lg.pack_steps(np.array([90000]))[0] == -1


def test_white_space_of_tokens_is_that_of_the_sql():
    """Arrow splits at the same 29 characters as ``STRIP_CLASS``."""
    import unicodedata
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    _, _, lens = lg.tokens(pa.array([f"a{c}b" for c in chars], pa.large_string()))
    assert [c for c, n in zip(chars, lens, strict=True) if n == 2] == [
        c for c in chars if c in "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85" or unicodedata.category(c)[0] == "Z"]


def test_self_bleu_of_whole_texts_holds_few_shuffled_bytes(spark):
    """Never more on disk than four times the table, beside what was there before."""
    from titlelake.catalog import QUERIES, load_all
    load_all()
    sf = "/root/testdata/sf0.01"
    dirs = list(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())

    def shuffled():
        total = 0
        for d in dirs:
            for top, _, names in os.walk(d):
                for f in names:
                    if f.startswith(("shuffle_", "temp_shuffle_")):
                        try:
                            total += os.path.getsize(os.path.join(top, f))
                        except OSError:  # just deleted
                            pass
        return total

    before, most, done = shuffled(), 0, threading.Event()

    def watch():
        nonlocal most
        while not done.wait(0.02):
            most = max(most, shuffled() - before)

    watcher = threading.Thread(target=watch)
    watcher.start()
    try:
        got = QUERIES["M8_self_bleu_whole_texts"](spark, sf).collect()
    finally:
        done.set()
        watcher.join()
    assert 0 < got[0][0] < 1
    assert 0 < most < 4 * os.path.getsize(f"{sf}/documents.parquet"), most

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from titlelake.llm import components, minhash_oph, suffix_dedup
from titlelake.llm.shingles import shingle_set, words


def brute_components(rows, size, percent=80):
    sets = [frozenset(shingle_set(t or "", size).tolist()) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return [(d, len(sets[i]), least.get(root(i))) for i, (d, _) in enumerate(rows)]


def check(spark, rows, size=4):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = minhash_oph.near_duplicates(docs, minhash_oph.Config(words=size)).collect()
    want = [(d, n, c, c == d) for d, n, c in brute_components(rows, size)]
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got)


def test_words():
    assert words("Ab\x0bÉ\x1cx  c\n") == [b"ab", "É\x1cx".encode(), b"c"]


def test_edge_rows(edge_docs, edge_rows, no_docs):
    got = minhash_oph.near_duplicates(edge_docs, minhash_oph.Config(words=4)).collect()
    want = [(d, n, c, c == d) for d, n, c in brute_components(edge_rows, 4)]
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got)
    assert minhash_oph.near_duplicates(no_docs).count() == 0
    kept = minhash_oph.drop_near_duplicates(edge_docs)
    assert kept.columns == edge_docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {d for d, n, c in brute_components(edge_rows, 5) if d == c}


@pytest.mark.parametrize("seed", [1, 2])
def test_families_around_the_threshold(spark, seed):
    """Copies of copies with edits: chains, members that are no copies of the centre, short texts."""
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghij") + rng.choice("abcdefghij") + str(rng.randint(0, 99))
    rows, texts = [], []
    for _ in range(5):
        base = [word() for _ in range(rng.choice([6, 30, 80, 150]))]
        family = [base]
        for _ in range(30):
            own = list(rng.choice(family))
            for _ in range(rng.randint(0, max(1, len(own) // 25))):
                at = rng.randrange(len(own))
                rng.choice([lambda: own.__setitem__(at, word()), lambda: own.insert(at, word()), lambda: own.pop(at) if len(own) > 4 else None])()
            family.append(own)
        texts += [" ".join(x) for x in family]
    rng.shuffle(texts)
    rows = [(i * 3, t) for i, t in enumerate(texts)]
    check(spark, rows)


def test_sets_whose_digests_share_a_half_are_told_apart(spark):
    rng = random.Random(5)
    texts = [" ".join(f"w{rng.randint(0, 999)}" for _ in range(12)) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate([*texts, *texts[:10], *(t + " more" for t in texts[:10]), "", None])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = minhash_oph.near_duplicates(docs, minhash_oph.Config(words=5, node_bits=3)).collect()
    want = [(d, n, c, c == d) for d, n, c in brute_components(rows, 5)]
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got)


def test_bins_agree_as_the_sets_do():
    signer = minhash_oph.Signer(minhash_oph.Config())
    rng = np.random.default_rng(5)
    agree = []
    for n in (5, 40, 400):
        hits = []
        for _ in range(150):
            x = rng.integers(0, 2**63, n + n // 4, dtype=np.uint64)
            a, b = np.sort(x[: n]), np.sort(x[n // 4 :])
            hits.append((signer.bins_of(a) == signer.bins_of(b)).mean())
        agree.append(abs(np.mean(hits) - (n - n // 4) / (n + n // 4)))
    assert max(agree) < 0.06


def test_components_of_chains_and_stars(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 180)] + [(500, 501), (501, 500), (7, 7)] + [(rng.randint(1000, 1100), rng.randint(1000, 1100)) for _ in range(70)]
    got = {r["node"]: r["comp"] for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    label = {x: x for e in edges for x in e}
    for _ in label:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: c for x, c in label.items() if x in linked}
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# suffix arrays

def brute_repeats(texts, length):
    data = [(t or "").encode() for t in texts]
    count = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        covered, end = bytearray(len(d)), 0
        for i in range(len(d) - length + 1):
            if count[d[i : i + length]] > 1:
                covered[max(i, end) : i + length] = b"\1" * (i + length - max(i, end))
                end = i + length
        kept = bytes(x for x, c in zip(d, covered) if not c)
        runs = sum(1 for i, c in enumerate(covered) if c and not (i and covered[i - 1]))
        out.append((len(d), sum(covered), runs, hashlib.sha256(kept).hexdigest()))
    return out


def test_repeats_of_edge_rows(edge_docs, edge_rows, no_docs):
    rows = [(d, t[:12_000] if t else t) for d, t in edge_rows]
    from pyspark.sql import functions as F

    docs = edge_docs.withColumn("text", F.substring("text", 1, 12_000))
    got = suffix_dedup.remove_repeats(docs, 400).drop("spans", "text").collect()
    want = [(d, *x) for (d, _), x in zip(rows, brute_repeats([t for _, t in rows], 400))]
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got)
    assert suffix_dedup.remove_repeats(no_docs).count() == 0


@pytest.mark.parametrize("blocks", [2000, 3])
def test_passages_over_shards(spark, monkeypatch, blocks):
    """One passage in many texts, with neighbours that some of them share, dealt over several shards."""
    monkeypatch.setattr(suffix_dedup, "SHARD_BLOCKS", blocks)
    rng = random.Random(9)
    noise = lambda n: "".join(rng.choice("abcdefgh é\n") for _ in range(n))
    passage, tails = noise(430), [noise(150) for _ in range(6)]
    texts = [noise(rng.randint(100, 500)) + passage + rng.choice(tails) + noise(200) for _ in range(40)]
    texts += [noise(50) + passage[:300] + noise(300), "xy" * 700, ("q" + passage[:90]) * 8, passage, noise(399)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = suffix_dedup.remove_repeats(docs).drop("spans", "text").collect()
    want = [(i, *x) for i, x in enumerate(brute_repeats(texts, 400))]
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got)


def test_blocks_do_not_depend_on_chunks(monkeypatch):
    rng = random.Random(2)
    data = bytes(rng.choice(b"abc") for _ in range(6_000)) + b"z" * 2_000
    whole = suffix_dedup.blocks_of(data, 400)
    monkeypatch.setattr(suffix_dedup, "CHUNK_STARTS", 700)
    cut = suffix_dedup.blocks_of(data, 400)
    assert [b[:4] for b in whole] == [b[:4] for b in cut]
    assert all(x[4] for x in cut if x[1] > 6_100)  # the anchor stands in many places of the periodic part


def test_repeats_at_chunk_borders(monkeypatch):
    """A periodic run at a border: a block that holds a string twice says so, wherever its anchor's places are."""
    monkeypatch.setattr(suffix_dedup, "CHUNK_STARTS", 700)
    rng, length, held = random.Random(3), 400, 0
    for _ in range(300):
        unit = bytes(rng.randrange(256) for _ in range(rng.randint(20, 130)))
        lead, tail = rng.randint(400, 699), rng.randint(1, 500)
        data = rng.randbytes(lead) + (unit * 60)[: rng.randint(420, 900)] + rng.randbytes(tail)
        for _, lo, hi, _, again in suffix_dedup.blocks_of(data, length):
            own = [data[i : i + length] for i in range(lo, hi + 1)]
            if len(set(own)) < len(own):
                held += 1
                assert again
    assert held > 20


def test_suffix_array_and_prefixes():
    rng = random.Random(1)
    for _ in range(30):
        own = bytes(rng.choice([97, 98, 0, 255][: rng.randint(1, 4)]) for _ in range(rng.randint(1, 200)))
        text, most = np.frombuffer(own, np.uint8), rng.choice([5, 60])
        sa, rank = suffix_dedup.suffix_array(text)
        want = sorted(range(len(own)), key=lambda i: own[i:])
        assert sa.tolist() == want
        begin = np.array(sorted({0, rng.randrange(len(own))}))
        got = suffix_dedup.common_prefixes(text, sa, rank, begin, most)
        shared = lambda a, b: next((k for k in range(min(len(a), len(b), most)) if a[k] != b[k]), min(len(a), len(b), most))
        assert got.tolist() == [0] + [shared(own[i:], own[j:]) for i, j in zip(want, want[1:])]


def test_text_keeps_whole_characters():
    assert suffix_dedup.whole_characters("aéxyz", [(2, 4)]) == "aéyz"
    assert suffix_dedup.whole_characters("aéé", [(0, 4)]) == "é"


def test_pipeline_form_keeps_columns(edge_docs):
    out = suffix_dedup.without_repeats(edge_docs)
    assert out.columns == edge_docs.columns
    rows = {r["doc_id"]: r for r in out.collect()}
    assert rows[1]["text"] == "" and rows[1]["n_chars"] == 0  # document 5 holds the same text
    assert rows[2]["text"] is None


def test_pipeline_stage_removes_passages_of_over_50_words(spark):
    import corpus_pipeline

    rng = random.Random(12)
    some = lambda n, size: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(*size))) for _ in range(n))
    long, short, only50, left, right = some(51, (4, 6)), some(51, (1, 2)), some(50, (4, 6)), some(30, (4, 6)), some(30, (4, 6))
    dense = "".join(chr(rng.randint(0x4E00, 0x9000)) for _ in range(200))  # 600 bytes without white space
    assert len(long) < 400 and len(short) < 160
    around = [(some(60, (3, 7)), some(80, (3, 7))) for _ in range(14)]
    inner = [long, long.replace(" ", "\n", 20), short, short, only50, only50, left + " " + right, left, right, dense, dense, some(70, (3, 7)), "", long + " " + short]
    texts = [f"{a} {x} {b}" for (a, b), x in zip(around, inner)]
    docs = spark.createDataFrame([(i, t, len(t)) for i, t in enumerate(texts)], "doc_id bigint, text string, n_chars bigint")
    got = {r["doc_id"]: r for r in corpus_pipeline.passage_dedup(spark, docs, "").collect()}
    removed = {0, 1, 2, 3, 13}
    for i, ((a, b), t) in enumerate(zip(around, texts)):
        want = (f"{a}  {b}" if i in removed else f"{a} {b}" if i in (9, 10) else t)
        if i == 13:  # two passages, the space between them is of neither
            want = f"{a}   {b}"
        if i in (9, 10):  # byte strings take the equal spaces around too
            assert got[i]["text"].replace(" ", "") == want.replace(" ", "")
        else:
            assert got[i]["text"] == want, i
        assert got[i]["n_chars"] == len(got[i]["text"])


def test_word_passages_against_brute_force(spark):
    rng = random.Random(13)
    pool = [[rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.randint(20, 90))] for _ in range(12)]
    texts = [" \t".join(w for _ in range(rng.randint(1, 6)) for w in rng.choice(pool)) for _ in range(40)] + ["", "x " * 200, None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: r["text"] for r in suffix_dedup.without_repeats(docs, 1 << 20, 51).collect()}
    own = [(t or "").split() for t in texts]
    count = Counter(tuple(w[i : i + 51]) for w in own for i in range(len(w) - 50))
    for d, w in enumerate(own):
        gone = {j for i in range(len(w) - 50) if count[tuple(w[i : i + 51])] > 1 for j in range(i, i + 51)}
        assert (got[d] or "").split() == [x for j, x in enumerate(w) if j not in gone], d


def test_query_tells_passages_of_over_50_words(spark, tmp_path):
    """Passages under 400 bytes: the contract's columns keep them, ``n_passages`` and ``text`` tell them."""
    from titlelake.llm.queries import op4_suffix_dedup

    rng = random.Random(14)
    some = lambda n: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 7))) for _ in range(n))
    passage, only50, long = some(52), some(50), some(150)
    assert len(passage) < 400 and len(only50) < 400
    inner = [passage, passage.replace(" ", "\n", 9), only50, only50, some(40), "", long, f"{passage} {some(60)} {long}"]
    around = [(some(60), some(60)) for _ in inner]
    texts = [f"{a} {x} {b}" for (a, b), x in zip(around, inner)] + [None, ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(op4_suffix_dedup(spark, str(tmp_path)).collect(), key=lambda r: r["doc_id"])
    assert [r["n_passages"] for r in got] == [1, 1, 0, 0, 0, 0, 1, 2, 0, 0]
    want = [(i, *x) for i, x in enumerate(brute_repeats(texts, 400))]
    assert [tuple(r[c] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) for r in got] == want
    for i in (0, 1, 6):  # byte strings take the equal spaces around too
        assert "".join(got[i]["text"].split()) == "".join(around[i]).replace(" ", "")
    assert all(got[i]["text"] == texts[i] for i in (2, 3, 4, 5)) and got[7]["n_removed"] == got[6]["n_removed"] < got[7]["n_bytes"]


def test_prefixes_over_blocks_and_repeats_only_in_a_shard():
    """Long periodic texts in many blocks: shared bytes run past blocks; starts whose string stands once are left out."""
    rng = random.Random(6)
    unit = bytes(rng.randrange(97, 123) for _ in range(13))
    own = [unit * 9, rng.randbytes(70), unit * 3 + rng.randbytes(20), b"z" * 90, unit[4:] * 5, b"z" * 31]
    text, begin = np.frombuffer(b"".join(own), np.uint8), np.cumsum([0, *map(len, own[:-1])])
    sa, rank = suffix_dedup.suffix_array(text)
    raw = text.tobytes()
    shared = lambda a, b, most: next((k for k in range(min(len(a), len(b), most)) if a[k] != b[k]), min(len(a), len(b), most))
    for most in (7, 40, 400):
        want = [0] + [shared(raw[i:], raw[j:], most) for i, j in zip(sa.tolist(), sa[1:].tolist())]
        assert suffix_dedup.common_prefixes(text, sa, rank, begin, most).tolist() == want
    shard = suffix_dedup.Shard(30)
    for i, data in enumerate(own):
        shard.add({"v": 1, "n": 1, "deal": 1, "salt": 0, "k1": i, "k2": i, "lo": 1000 * i, "data": data})
    count = Counter(d[i : i + 30] for d in own for i in range(len(d) - 29))
    want = {(k, 1000 * k + i) for k, d in enumerate(own) for i in range(len(d) - 29) if count[d[i : i + 30]] > 1}
    got = {(r["k1"], at) for r in shard.repeats() for at in range(r["lo"], r["hi"] - 29)}
    assert got == want and {r["k1"] for r in shard.rows} == {k for k, _ in want}

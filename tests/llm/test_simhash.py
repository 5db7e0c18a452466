import random
from itertools import combinations

import xxhash

from titlelake.llm import simhash_blocks
from titlelake.llm.simhash_blocks import Config


def brute_fingerprint(text, size=4):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    own = [w for w in low.split(" ") if w]
    if not own:
        return 0
    k = min(size, len(own))
    hs = [xxhash.xxh64_intdigest(" ".join(own[i : i + k]).encode(), seed=42) for i in range(len(own) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(rows):
    """``rows``: identifier, fingerprint."""
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        if (rows[i][1] ^ rows[j][1]).bit_count() <= 4:
            parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return [least.get(root(i)) for i in range(len(rows))]


def check(docs, rows, cfg=Config()):
    got = simhash_blocks.simhash_duplicates(docs, cfg).select("doc_id", "fingerprint", "component_id").collect()
    fps = [(d, brute_fingerprint(t)) for d, t in rows]
    want = [(d, f"{f:016x}", c) for (d, f), c in zip(fps, brute_components(fps))]
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got)


def test_edge_rows(edge_docs, edge_rows, no_docs):
    check(edge_docs, edge_rows)
    assert simhash_blocks.simhash_duplicates(no_docs).count() == 0


def test_long_texts_are_summed_in_parts():
    text = " ".join(f"w{i % 70_001}" for i in range(140_000))
    assert simhash_blocks.fingerprint(text, 4) == brute_fingerprint(text)


def test_every_choice_of_bits_shares_a_block():
    rng = random.Random(3)
    for nodes in (2, 1 << 13, 1 << 21, 1 << 40):
        masks = simhash_blocks.block_masks(nodes, 4)
        for _ in range(300):
            flip = sum(1 << b for b in rng.sample(range(64), 4))
            flip -= (1 << 64) * (flip >> 63)
            assert any(flip & m == 0 for m in masks)


def family(rng, n):
    """Fingerprints around centres: copies of copies, some at the most bits, some beyond."""
    out = []
    for _ in range(4):
        own = [rng.getrandbits(64)]
        for _ in range(n):
            own.append(rng.choice(own) ^ sum(1 << b for b in rng.sample(range(64), rng.choice([1, 2, 3, 4, 5, 6]))))
        out += own
    return sorted(set(out))


def test_links_by_blocks_and_by_values_agree_with_all_pairs(spark):
    fps = family(random.Random(5), 60)
    signed = [f - (1 << 64) * (f >> 63) for f in fps]
    nodes = spark.createDataFrame([(f,) for f in signed], "fp bigint")
    want = brute_components(list(enumerate(fps)))

    def classes(links):
        parent = {f: f for f in signed}

        def root(f):
            while parent[f] != f:
                f = parent[f]
            return f

        for a, b in links:
            assert ((a ^ b) & (1 << 64) - 1).bit_count() <= 4
            parent[root(a)] = root(b)
        least = {}
        for i, f in enumerate(signed):
            least.setdefault(root(f), i)
        return [least[root(f)] for f in signed]

    blocks = simhash_blocks.in_blocks(nodes, 4)
    assert classes(map(tuple, simhash_blocks.block_links(blocks, 4).collect())) == want
    assert classes(map(tuple, simhash_blocks.value_links(nodes, 4).collect())) == want


def test_crowded_blocks_keep_every_link(spark):
    """Texts of one family, with every block crowded and with none."""
    rng = random.Random(9)
    word = lambda: rng.choice("abcdefgh") + str(rng.randint(0, 400))
    base = [word() for _ in range(120)]
    texts = []
    for _ in range(150):
        own = list(base)
        for _ in range(rng.randint(0, 3)):
            own[rng.randrange(len(own))] = word()
        texts.append(" ".join(own))
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    check(docs, rows, Config(crowd=1))
    check(docs, rows, Config(crowd=10**6))

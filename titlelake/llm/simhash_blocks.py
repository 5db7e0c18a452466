"""Near duplicates by SimHash: pigeonhole blocks, a join on blocks, Hamming distance.

A text's fingerprint has a bit set where over half of its shingles' hashes
(XXH64, repeats counted) have it.  Equal fingerprints are one node from the
start, so copies never multiply.  Two fingerprints that differ in at most d bits
agree on at least b - d of any b blocks of their bits, so every choice of b - d
blocks is a join key and no close pair is missed.  b grows with the number
of different fingerprints, so that a key has about as many values as there are nodes
and chance meetings stay few.

A family of near copies can still fill one block with very many
fingerprints.  Up to ``crowd`` members, all pairs of a block are
verified.  The members of larger blocks are not paired: two fingerprints are at
most d apart exactly where some 64-bit value lies within d/2 of both, so each of
these members names the values within d/2 of itself (2,081 for d = 4) and the
members that name one value are linked in a chain.  That costs the same for
each member, however large its family is, and a value has at most as many members as it
has values around it, so no group is unbounded.

Cases: a null, empty or wordless text has the fingerprint zero and links like any
other; fewer words than a shingle make one shingle of the whole sequence;
texts of any length are read whole; equal texts are one node; repeated rows get equal results;
null identifiers lose ties against others, and a component of nulls alone has a null
identifier; an empty table gives an empty result; extra columns, whatever
their names, are never read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from titlelake.llm.common import column, doc_rows, pieces, small_batches, stored, texts_of
from titlelake.llm.components import components
from titlelake.llm.shingles import words

BITS = 64
SEED = 42


@dataclass
class Config:
    """``differ``: most differing bits of a link (even, for the values half way);
    ``crowd``: members of a block beyond which its pairs are found by those values."""

    words: int = 4
    differ: int = 4
    crowd: int = 256


def fingerprint(text: str, size: int) -> int:
    own = words(text)
    if not own:
        return 0
    k = min(size, len(own))
    line = b" ".join(own)
    ends = np.cumsum([len(w) + 1 for w in own]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    spans = zip(starts, ends[k - 1 :].tolist())
    votes, shingles = np.zeros(BITS, dtype=np.int64), len(own) - k + 1
    while part := [xxhash.xxh64_intdigest(line[a:b], SEED) for a, b in islice(spans, 1 << 16)]:
        votes += np.unpackbits(np.array(part, dtype=">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > shingles).tobytes(), "big")


def fingerprints(docs: DataFrame, cfg: Config = Config()) -> DataFrame:
    """``doc_id, fp``: the fingerprint of every row, as a signed 64-bit number."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                fp = np.array([fingerprint(t, cfg.words) for t in texts_of(part)], dtype=np.uint64)
                yield pa.RecordBatch.from_arrays([column(part, "doc_id"), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return doc_rows(docs).mapInArrow(sign, f"doc_id {kind}, fp bigint")


def block_masks(nodes: int, differ: int) -> list[int]:
    """Signed masks of the block choices that serve as join keys: the fewest blocks
    whose keys have as many values as there are nodes (twice ``differ`` blocks at most)."""
    for blocks in range(differ + 1, 2 * differ + 1):
        if BITS * (blocks - differ) // blocks >= math.log2(max(nodes, 2)):
            break
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    own = [(1 << edges[i + 1]) - (1 << edges[i]) for i in range(blocks)]
    masks = [sum(own[i] for i in some) for some in combinations(range(blocks), blocks - differ)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]


def distance(a: Column | str, b: Column | str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)) if isinstance(a, str) else a.bitwiseXOR(b))


def in_blocks(nodes: DataFrame, differ: int) -> DataFrame:
    """``fp, block, key, c``: the blocks of each node that hold other nodes too, and their size."""
    masks = block_masks(nodes.count(), differ)
    keys = F.array(*[F.struct(F.lit(i).cast("tinyint").alias("block"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks)])
    each = nodes.select("fp", F.explode(keys).alias("k")).select("fp", "k.block", "k.key")
    size = each.groupBy("block", "key").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    return stored(each.join(size, ["block", "key"]), "simhash-blocks")


def block_links(members: DataFrame, differ: int) -> DataFrame:
    """Verified pairs ``a, b`` of the members of each block given."""
    left = members.select("block", "key", F.col("fp").alias("a"))
    right = members.select("block", "key", F.col("fp").alias("b"))
    return left.join(right, ["block", "key"]).filter((F.col("a") < F.col("b")) & (distance("a", "b") <= differ)).select("a", "b")


def near_values(differ: int) -> np.ndarray:
    """All values with at most ``differ / 2`` bits set, to be XORed with a fingerprint."""
    flips = [sum(1 << i for i in some) for k in range(differ // 2 + 1) for some in combinations(range(BITS), k)]
    return np.array(flips, dtype=np.uint64).view(np.int64)


def value_links(nodes: DataFrame, differ: int) -> DataFrame:
    """Pairs ``a, b`` that connect the nodes (``fp``) just as all their pairs within ``differ`` would."""
    flips = near_values(differ)

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = column(batch, "fp").to_numpy(zero_copy_only=False)
            for at in range(0, len(fp), 64):
                own = fp[at : at + 64]
                near = (own[:, None] ^ flips[None, :]).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(near), pa.array(np.repeat(own, len(flips)))], ["value", "b"])

    near = nodes.mapInArrow(around, "value bigint, b bigint")
    chain = near.select("b", F.lag("b").over(Window.partitionBy("value").orderBy("b")).alias("a"))
    return chain.filter(F.col("a").isNotNull() & (distance("a", "b") <= differ)).select("a", "b").distinct()


def simhash_duplicates(docs: DataFrame, cfg: Config = Config()) -> DataFrame:
    """``doc_id, fp, fingerprint, component_id`` for every document."""
    if cfg.differ % 2 or cfg.differ < 2:
        raise ValueError("differ must be even and positive")
    small_batches(docs.sparkSession)
    signed = stored(fingerprints(docs, cfg), "simhash")
    nodes = stored(signed.groupBy("fp").agg(F.min("doc_id").alias("id")), "simhash-nodes")
    blocks = in_blocks(nodes, cfg.differ)
    crowded = blocks.filter(F.col("c") > cfg.crowd).select("fp").distinct()
    links = block_links(blocks.filter(F.col("c") <= cfg.crowd), cfg.differ).unionAll(value_links(crowded, cfg.differ))
    comps = stored(components(links), "simhash-comps")
    found = nodes.join(comps.withColumnRenamed("node", "fp"), "fp", "left").withColumn("comp", F.coalesce("comp", "fp"))
    least = found.groupBy("comp").agg(F.min("id").alias("component_id"))
    label = found.join(least, "comp").select("fp", "component_id")
    out = signed.join(label, "fp", "left")
    return out.select("doc_id", "fp", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")

"""Near duplicates by one-permutation MinHash with optimal densification.

One hash per shingle fills ``bands * rows`` bins; an empty bin borrows from
the first filled bin of its own fixed random order.  Equal bands make
buckets; each bucket is a star: its centre meets every other member, so a
bucket of n texts gives n - 1 pairs, not n * n.  Pairs are confirmed on the full
shingle sets, and links are closed to components.

A star alone could lose a link between two members that are no copies of the
centre.  What it leaves open is closed exactly, without all pairs: with I(x)
the overlap of x and centre c, two members overlap in at most
min(I(x), I(y)) shingles of c plus the shingles outside c that they share.
Only members of different components whose sizes allow a link by that bound,
from overlap alone or with shared outside shingles, are confirmed as pairs.
Equal shingle sets are one node from the start, so copies never multiply; a node is named by half of a
128-bit digest of its set, and where sets of different digests have that half in common they are named anew by both.

Cases: a null, empty or wordless text has no shingle, links with nothing and
is kept; fewer words than a shingle make one shingle of the whole sequence;
texts of any length are read whole; equal texts are one node; repeated rows
get equal results; null identifiers lose ties against others and a component
of nulls alone has a null identifier; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from titlelake.llm.common import column, doc_rows, pieces, same, small_batches, stored, text_key, texts_of
from titlelake.llm.components import components
from titlelake.llm.shingles import mix, shingle_set


@dataclass
class Config:
    """Two texts of the threshold's resemblance share no bucket with
    probability about (1 - 0.8**rows)**bands: 5e-8 as set here."""

    words: int = 5
    percent: int = 80
    bands: int = 32
    rows: int = 4
    seed: int = 7
    node_bits: int = 64  # of the first half of a digest; fewer make common halves likely, for tests


class Signer:
    def __init__(self, cfg: Config) -> None:
        self.cfg, self.bins = cfg, cfg.bands * cfg.rows
        if self.bins & (self.bins - 1):
            raise ValueError("bands * rows must be a power of two")
        self.shift = np.uint64(64 - self.bins.bit_length() + 1)
        rng = np.random.default_rng(cfg.seed)
        self.order = np.array([[i, *(j for j in rng.permutation(self.bins) if j != i)] for i in range(self.bins)])
        self.salt = mix(np.arange(1, cfg.bands + 1, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019))

    def bins_of(self, hashes: np.ndarray) -> np.ndarray:
        """Smallest hash of each bin (the leading bits number it), densified."""
        number = (hashes >> self.shift).astype(np.int64)
        first = np.searchsorted(number, np.arange(self.bins))
        filled = np.zeros(self.bins, dtype=bool)
        filled[number] = True
        source = self.order[np.arange(self.bins), filled[self.order].argmax(1)]
        return hashes[first[source]]

    def keys(self, hashes: np.ndarray) -> np.ndarray:
        """A bucket key for each band; the band's number is part of it."""
        rows = self.bins_of(hashes).reshape(self.cfg.bands, self.cfg.rows)
        key = self.salt.copy()
        for i in range(self.cfg.rows):
            key = mix(key ^ rows[:, i]) + self.salt
        return key.view(np.int64)


def digest(sets: list[np.ndarray], cfg: Config) -> list[pa.Array]:
    """``node, more``: the halves of a 128-bit digest of each set, signed; null for the empty set."""
    both = np.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], "S16").view(">i8").reshape(-1, 2) if sets else np.zeros((0, 2), ">i8")
    empty = np.array([not len(s) for s in sets], bool)
    halves = both.astype(np.int64)
    halves[:, 0] >>= 64 - cfg.node_bits
    return [pa.array(halves[:, i].copy(), pa.int64(), mask=empty) for i in range(2)]


def told_apart(df: DataFrame, shared: DataFrame) -> DataFrame:
    """``df`` with the nodes that stand in ``shared`` named by both halves of the digest."""
    both = df.join(shared.select(F.col("node").alias("__shared")), F.col("node") == F.col("__shared"), "left")
    return both.withColumn("node", F.when(F.col("__shared").isNotNull(), F.xxhash64("node", "more")).otherwise(F.col("node"))).drop("__shared")


def signatures(docs: DataFrame, cfg: Config) -> DataFrame:
    """``doc_id, n, node, more, keys``; all but the first two are null for a text without shingles."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(cfg)
        for batch in batches:
            for part in pieces(batch):
                sets = [shingle_set(t, cfg.words) for t in texts_of(part)]
                yield pa.RecordBatch.from_arrays([
                    column(part, "doc_id"), pa.array([len(s) for s in sets], pa.int64()),
                    *digest(sets, cfg),
                    pa.array([signer.keys(s) if len(s) else None for s in sets], pa.list_(pa.int64())),
                ], ["doc_id", "n", "node", "more", "keys"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return doc_rows(docs).mapInArrow(sign, f"doc_id {kind}, n bigint, node bigint, more bigint, keys array<bigint>")


def full_sets(docs: DataFrame, cfg: Config) -> DataFrame:
    """``node, more, n, hs``: the full shingle set of every row given."""

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, 1 << 20):
                sets = [s for s in (shingle_set(t, cfg.words) for t in texts_of(part)) if len(s)]
                yield pa.RecordBatch.from_arrays([
                    *digest(sets, cfg), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())),
                ], ["node", "more", "n", "hs"])

    return doc_rows(docs).mapInArrow(expand, "node bigint, more bigint, n bigint, hs array<bigint>")


def linked(inter: Column, a: Column, b: Column, percent: int) -> Column:
    """100 * intersection >= percent * union, in integers."""
    return 100 * inter >= percent * (a + b - inter)


def with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Attach both sets: first the centre's to the light pair rows, then by member."""
    left = sets.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("hs").alias("ha"))
    right = sets.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("hs").alias("hb"))
    return pairs.join(left, "a").join(right, "b")


def stars(reps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Candidate edges ``a`` (centre), ``b``, ``big`` and the nodes that have any.

    A bucket's centre is the member whose buckets are the fullest (an original
    outranks its edited copies), then the smallest identifier."""
    each = reps.select("node", "id", F.explode("keys").alias("key"))
    count = each.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    multi = stored(each.join(count, "key"), "buckets")
    fame = multi.groupBy("node").agg(F.sum("c").alias("fame"))
    ranked = multi.join(fame, "node").select("key", "node", "c", F.struct(-F.col("fame"), F.col("id").isNull(), "id", "node").alias("rank"))
    centre = ranked.groupBy("key").agg(F.min("rank").alias("r")).select("key", F.col("r.node").alias("a"))
    edges = multi.join(centre, "key").filter("a != node").groupBy("a", F.col("node").alias("b")).agg((F.max("c") > 2).alias("big"))
    return stored(edges, "edges"), multi.select("node", "id").distinct()


def open_pairs(seen: DataFrame, comps: DataFrame, percent: int) -> DataFrame:
    """Pairs ``a, b`` of members of one centre, of different components, that
    may link by the bound on their overlap (see the head of the module).

    ``seen``: ``a, b, na, nb, inter, outside`` of every pair of a star."""
    label = comps.select(F.col("node").alias("b"), F.col("comp"))
    home = comps.select(F.col("node").alias("a"), F.col("comp").alias("home"))
    own = seen.join(label, "b", "left").join(home, "a", "left").select(
        F.col("a").alias("c"), F.col("b").alias("x"), F.col("nb").alias("n"), "inter", "outside",
        F.coalesce("comp", "b").alias("comp"), F.coalesce("home", "a").alias("home"))
    several = own.groupBy("c").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("c")
    own = stored(own.join(several, "c", "left_semi"), "open")
    # a link needs (100 + p) * overlap >= p * (n + n')
    most = F.floor((100 + percent) * F.col("inter") / percent) - F.col("n")
    step = lambda n: F.floor(F.log(n.cast("double")) * 50)
    left = own.filter("comp != home").select("c", F.col("x").alias("a"), F.col("n").alias("na"), F.col("inter").alias("ia"), F.col("comp").alias("ca"), most.alias("most"))
    right = own.select("c", F.col("x").alias("b"), F.col("n").alias("nb"), F.col("inter").alias("ib"), F.col("comp").alias("cb"))
    sizes = left.filter(F.col("most") * 100 >= F.col("na") * percent).withColumn("s", F.explode(F.sequence(step(F.greatest(F.lit(1), F.floor(F.col("na") * percent / 100))), step(F.greatest(F.col("most"), F.lit(1))) + 1)))
    fits = (100 + percent) * F.least("ia", "ib") >= percent * (F.col("na") + F.col("nb"))
    by_size = sizes.join(right.withColumn("s", step(F.col("nb"))), ["c", "s"]).filter((F.col("ca") != F.col("cb")) & fits).select("a", "b")
    by_share = _sharing(own, percent)
    return by_size.unionAll(by_share).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _sharing(own: DataFrame, percent: int) -> DataFrame:
    """Pairs ``a, b`` that share a shingle outside their centre early enough.

    A pair that needs t shared outside shingles to link shares one among the rarest
    (count - t + 1) of each member's.  t depends on both sizes, so each member is listed for each class of
    partner sizes (steps of 5 percent) that its centre has, with what that class needs at least;
    shingles of one component alone, the rarest of all, then leave most members
    with no row.  The full sets decide about what is left."""
    step = lambda n: F.floor(F.log(n.cast("double")) * 20)
    ext = own.select("c", "x", "comp", F.explode("outside").alias("h"))
    held = ext.groupBy("c", "h").agg(F.count(F.lit(1)).alias("d"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    held = held.select("c", "h", F.when(F.col("lo") < F.col("hi"), F.col("d")).otherwise(0).alias("d"))
    ranked = ext.join(held, ["c", "h"]).groupBy("c", "x").agg(F.sort_array(F.collect_list(F.struct("d", "h"))).alias("hs"))
    mine = own.select("c", "x", "n", "inter", "comp", "home", step(F.col("n")).alias("s"))
    each = mine.join(ranked, ["c", "x"]).join(mine.select("c", F.col("s").alias("other")).distinct(), "c")
    least = F.greatest(F.floor(F.exp(F.col("other") / 20) - 0.001), F.lit(1))  # of the partner's class
    most = F.ceil(F.exp((F.col("other") + 1) / 20) + 0.001)
    each = each.filter((least * percent <= F.col("n") * 100) & (most * 100 >= F.col("n") * percent))
    need = F.greatest(F.ceil(percent * (F.col("n") + least) / (100 + percent) - 0.001) - F.col("inter"), F.lit(1))
    early = F.filter(F.slice("hs", 1, F.greatest(F.size("hs") - need + 1, F.lit(0)).cast("int")), lambda e: e["d"] > 0)
    each = each.select("c", "x", "comp", "home", "s", "other", F.explode(early).alias("e")).withColumn("h", F.col("e.h")).drop("e")
    left = each.filter("comp != home").select("c", "h", F.col("s").alias("sa"), F.col("other").alias("sb"), F.col("x").alias("a"), F.col("comp").alias("ca"))
    right = each.select("c", "h", F.col("other").alias("sa"), F.col("s").alias("sb"), F.col("x").alias("b"), F.col("comp").alias("cb"))
    return left.join(right, ["c", "h", "sa", "sb"]).filter("ca != cb").select("a", "b").distinct()


def near_duplicates(docs: DataFrame, cfg: Config = Config()) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every document."""
    small_batches(docs.sparkSession)
    signed = stored(signatures(docs, cfg), "signed")
    nodes_of = lambda df: stored(df.filter(F.col("node").isNotNull()).groupBy("node").agg(
        F.min("doc_id").alias("id"), F.first("keys").alias("keys"), F.min("more").alias("lo"), F.max("more").alias("hi")), "reps")
    reps = nodes_of(signed)
    shared = reps.filter("lo < hi").select("node")
    several = not shared.isEmpty()
    if several:
        signed = stored(told_apart(signed, shared), "signed")
        reps = nodes_of(signed)
    reps = reps.drop("lo", "hi")
    edges, nodes = stars(reps)
    ids = nodes.select(F.col("id").alias("want")).distinct()
    own = doc_rows(docs).withColumn("tk", text_key())
    chosen = own.join(ids, F.col("doc_id").eqNullSafe(F.col("want")), "left_semi").dropDuplicates(["doc_id", "tk"])
    sets = full_sets(chosen, cfg)
    sets = stored((told_apart(sets, shared) if several else sets).drop("more"), "sets")
    both = with_sets(edges, sets).withColumn("outside", F.array_except("hb", "ha"))
    inter = F.col("nb") - F.size("outside")
    keep = F.col("big") | linked(inter, F.col("na"), F.col("nb"), cfg.percent)
    seen = stored(both.filter(keep).select("a", "b", "na", "nb", "big", inter.alias("inter"), F.when(F.col("big"), F.col("outside")).alias("outside")), "seen")
    links = seen.filter(linked(F.col("inter"), F.col("na"), F.col("nb"), cfg.percent)).select("a", "b")
    comps = stored(components(links), "comps")
    rest = stored(open_pairs(seen.filter("big"), comps, cfg.percent), "rest")
    if not rest.isEmpty():
        inter = F.size(F.array_intersect("ha", "hb"))
        more = with_sets(rest, sets).filter(linked(inter, F.col("na"), F.col("nb"), cfg.percent)).select("a", "b")
        comps = stored(components(links.unionAll(more)), "comps")
    found = reps.select("node", "id").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    least = found.groupBy("comp").agg(F.min("id").alias("component_id"))
    by_node = found.join(least, "comp").select(F.col("node").alias("own"), "component_id")
    out = signed.join(by_node, signed["node"] == by_node["own"], "left")
    label = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), label.alias("component_id"), label.eqNullSafe(F.col("doc_id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, cfg: Config = Config()) -> DataFrame:
    """One document of each component, with all its columns; rows repeated in identifier and text are one document."""
    kept = near_duplicates(docs, cfg).filter("kept").select(F.col("doc_id").alias("kept_id")).distinct()
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col("kept_id")), "left_semi")

"""Exact maximum cosine by pivot cells (J8, M4): cells that cannot hold the maximum are never opened.

1. Both sides are reduced to their distinct unit vectors: a maximum does not
   change, and however many vectors are equal, none fills a block.
2. A few corpus vectors (the first by hash) are pivots.  Every corpus vector goes to
   its nearest pivot; sorted by pivot and by the angle to it, vectors are cut into blocks of at
   most ``block_bytes``, each a ring of one pivot: all its angles lie in [lo, hi].
3. By the triangle inequality of angles, a vector at the angle t from the pivot has no
   neighbour in a ring that is nearer than max(0, t - hi, lo - t).  Each
   prediction first meets the block of the best bound, and then only
   the blocks whose bound exceeds the similarity found there.

Blocks stand on ``SHELVES`` shelves.  Vectors and blocks meet by equi-joins on the shelf, as matrices of bounded
size on both sides: a vector is sent once to each shelf that has a block open for it, however many blocks
the corpus has, so what is shuffled grows with the tables and not with their product.  Pairs of vectors never become
rows, and products are taken for a bounded number of vectors at a time.  What reaches the driver is the pivots (``pivots`` vectors) and four numbers
for each block.  Where bounds separate nothing, all blocks are opened and the answer is the same.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from titlelake.session import cut_lineage

#: Added to a bound, against rounding of angles and products.
SLACK = 1e-9
#: A vector is shuffled this often at most in each of the two rounds.
SHELVES = 64
#: Numbers of one product that a task holds.
PRODUCT = 1 << 22


@dataclass
class Cells:
    """``blocks``: ``shelf, block, matrix`` rows; the arrays describe block 0, 1, ...: number, shelf, pivot, least and largest angle."""

    blocks: DataFrame
    pivots: np.ndarray
    number: np.ndarray
    shelf: np.ndarray
    pivot: np.ndarray
    lo: np.ndarray
    hi: np.ndarray

    def bounds(self, u: np.ndarray) -> np.ndarray:
        """Largest cosine that each vector can have in each block."""
        t = angles(u, self.pivots)[:, self.pivot]
        return np.cos(np.maximum(0.0, np.maximum(t - self.hi, self.lo - t))) + SLACK

    def plain(self) -> Cells:
        """Without the table, for tasks."""
        return Cells(None, self.pivots, self.number, self.shelf, self.pivot, self.lo, self.hi)


def angles(u: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(u @ pivots.T, -1.0, 1.0))


def _filled(batches: Iterator[pa.RecordBatch], width: int = 0) -> Iterator[pa.RecordBatch]:
    """The batches with rows, cut so that rows of ``width`` numbers keep within ``PRODUCT``."""
    for b in batches:
        step = max(1, PRODUCT // width) if width else max(1, b.num_rows)
        yield from (b.slice(i, step) for i in range(0, b.num_rows, step))


def _matrix(batch: pa.RecordBatch, name: str) -> np.ndarray:
    lists = batch.column(batch.schema.get_field_index(name))
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _numbers(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


def cells(units: DataFrame, pivots: int, block_bytes: int) -> Cells | None:
    """Cells of distinct unit vectors ``uk, u``; None without any."""
    chosen = np.array([r["u"] for r in units.orderBy("uk").limit(pivots).select("u").collect()])
    if not len(chosen):
        return None
    most = max(1, block_bytes // (8 * chosen.shape[1]))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _filled(batches):
            t = angles(_matrix(batch, "u"), chosen)
            cell = t.argmin(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(t[np.arange(len(cell)), cell])], ["uk", "u", "cell", "t"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []  # rows and angles of the open block
        own, size = -1, 0

        def block() -> pa.RecordBatch:
            u, t = (np.concatenate(x) for x in zip(*held))
            return pa.RecordBatch.from_arrays([pa.array([own], pa.int32()), pa.array([t.min()]), pa.array([t.max()]), pa.array([u.tobytes()], pa.binary())], ["cell", "lo", "hi", "matrix"])

        for batch in _filled(batches):
            u, t, cell = _matrix(batch, "u"), _numbers(batch, "t"), _numbers(batch, "cell")
            at = 0
            while at < len(u):
                if held and (cell[at] != own or size == most):
                    yield block()
                    held, size = [], 0
                own = int(cell[at])
                end = min(int(np.searchsorted(cell, own, side="right")), at + most - size)
                held.append((u[at:end], t[at:end]))
                at, size = end, size + end - at
        if held:
            yield block()

    near = units.mapInArrow(assign, "uk bigint, u array<double>, cell int, t double")
    # every row has its own (cell, angle, key), so no cell is too large for a range
    rings = near.repartitionByRange("cell", "t", "uk").sortWithinPartitions("cell", "t", "uk")
    blocks = rings.mapInArrow(cut, "cell int, lo double, hi double, matrix binary")
    blocks = cut_lineage(blocks.withColumn("block", F.monotonically_increasing_id())).withColumn("shelf", F.pmod(F.hash("block"), F.lit(SHELVES)))
    about = blocks.select("block", "shelf", "cell", "lo", "hi").orderBy("block").toPandas()
    return Cells(blocks.select("shelf", "block", "matrix"), chosen, about["block"].to_numpy(), about["shelf"].to_numpy(), about["cell"].to_numpy(), about["lo"].to_numpy(), about["hi"].to_numpy())


MEETINGS = "shelf int, n bigint, uks binary, us binary, open array<bigint>, mask binary"


def _meetings(found: Cells, uk: np.ndarray, u: np.ndarray, meets: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A row for each shelf: the vectors that meet a block of it, those blocks, and who meets which (``meets``: vectors x blocks)."""
    for shelf in np.unique(found.shelf[meets.any(0)]):
        at = np.flatnonzero((found.shelf == shelf) & meets.any(0))
        own = meets[:, at].any(1)
        mask = meets[np.ix_(own, at)]
        yield pa.RecordBatch.from_arrays([
            pa.array([shelf], pa.int32()), pa.array([int(mask.sum())], pa.int64()), pa.array([uk[own].tobytes()], pa.binary()), pa.array([u[own].tobytes()], pa.binary()),
            pa.array([found.number[at].tolist()], pa.list_(pa.int64())), pa.array([np.packbits(mask).tobytes()], pa.binary())],
            ["shelf", "n", "uks", "us", "open", "mask"])


def first_meetings(units: DataFrame, found: Cells) -> DataFrame:
    """``MEETINGS``: each vector with the block of its best bound."""
    plain = found.plain()

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _filled(batches, len(plain.number)):
            uk, u = _numbers(batch, "uk"), _matrix(batch, "u")
            meets = np.zeros((len(u), len(plain.number)), dtype=bool)
            meets[np.arange(len(u)), plain.bounds(u).argmax(1)] = True
            yield from _meetings(plain, uk, u, meets)

    return units.mapInArrow(choose, MEETINGS)


def further_meetings(units: DataFrame, found: Cells) -> DataFrame:
    """``MEETINGS``: the vectors (``uk, u, s``) with the blocks that may hold more than ``s``."""
    plain = found.plain()

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _filled(batches, len(plain.number)):
            uk, u, s = _numbers(batch, "uk"), _matrix(batch, "u"), _numbers(batch, "s")
            bounds = plain.bounds(u)
            first = bounds.argmax(1)
            open_ = bounds > s[:, None]
            open_[np.arange(len(u)), first] = False
            yield from _meetings(plain, uk, u, open_)

    return units.mapInArrow(choose, MEETINGS)


def best_of(meetings: DataFrame, found: Cells) -> DataFrame:
    """``uk, s``: the largest cosine in each block that a vector meets."""
    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _filled(batches):
            get = {c: batch.column(i) for i, c in enumerate(batch.schema.names)}
            for k in range(batch.num_rows):
                uk = np.frombuffer(get["uks"][k].as_buffer(), dtype=np.int64)
                u = np.frombuffer(get["us"][k].as_buffer()).reshape(len(uk), -1)
                matrix = np.frombuffer(get["matrix"][k].as_buffer()).reshape(-1, u.shape[1])
                width = get["open"][k].as_py()
                mask = np.unpackbits(np.frombuffer(get["mask"][k].as_buffer(), dtype=np.uint8), count=len(uk) * len(width)).reshape(len(uk), -1)
                own = np.flatnonzero(mask[:, width.index(get["block"][k].as_py())])
                step = max(1, PRODUCT // len(matrix))
                for i in range(0, len(own), step):
                    part = own[i : i + step]
                    yield pa.RecordBatch.from_arrays([pa.array(uk[part]), pa.array((u[part] @ matrix.T).max(1))], ["uk", "s"])

    pairs = meetings.join(found.blocks, "shelf").where(F.array_contains("open", F.col("block")))
    return pairs.select("uks", "us", "open", "mask", "block", "matrix").mapInArrow(multiply, "uk bigint, s double")


@dataclass
class Maxima:
    """``best``: ``uk, s``; ``met``: rows of ``n`` vectors that met a block; ``blocks``: how many there are."""

    best: DataFrame
    met: DataFrame
    blocks: int


def max_products(queries: DataFrame, corpus: DataFrame, pivots: int, block_bytes: int) -> Maxima | None:
    """The largest product of each query vector with the corpus' vectors; None if the corpus has none.

    Both sides: distinct unit vectors ``uk, u`` without NaN."""
    found = cells(corpus, pivots, block_bytes)
    if found is None:
        return None
    meetings = first_meetings(queries, found)
    first = cut_lineage(best_of(meetings, found).groupBy("uk").agg(F.max("s").alias("s")))
    more = further_meetings(queries.join(first, "uk").select("uk", "u", "s"), found)
    best = first.unionAll(best_of(more, found)).groupBy("uk").agg(F.max("s").alias("s"))
    return Maxima(best, meetings.select("n").unionAll(more.select("n")), len(found.number))

"""Whitening of embeddings; covariances by polarisation.

Entries become whole numbers x = floor(256 c).  Over the fit list (each
different x vector once, n of them, sums S) every centred entry n x - S is a
whole number too.  Spark sums the squares of every dimension and of
the sum of every pair of dimensions; since (a + b)^2 = a^2 + b^2 + 2ab, half of what
the square of a pair's sum has over its two squares is their cross product.  All
sums are exact, so nothing cancels, whatever the mean and however many rows.

What leaves a task is one number for each pair of dimensions; what reaches
the driver is the d by d matrix and d sums, a bound set by the dimension alone.  Its
eigenvectors (``eigh``) then map every row in one pass.

Cases: vectors that are null or hold null or non-finite entries are dropped,
as are those with an entry beyond a 64-bit number once scaled; the dimension is that of most
different vectors (ties: the larger), others are dropped; repeated rows are all
returned and count once in the fit; a component without variance (fewer different
vectors than components, constant dimensions) has a null ``whitened``; if no
component has any, ``identity_error`` is null; an empty table gives an empty
result; null identifiers are kept; extra columns, whatever their names, are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from titlelake.llm.common import column, small_batches, stored

SCALE = 256
#: Sums leave a task as high * 2**60 + low.
LOW = 60
LIMB = 21


@dataclass
class Whitening:
    """``axes``: a unit eigenvector in each row, by falling ``values``; ``trace``: all variance."""

    n: int
    sums: list[int]
    reach: int
    values: np.ndarray
    axes: np.ndarray
    trace: float

    @property
    def usable(self) -> np.ndarray:
        """Components with variance beyond what rounding gives."""
        top = self.values[0] if len(self.values) else 0.0
        return self.values > top * len(self.sums) * np.finfo(float).eps


def whole_vectors(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """``key, x``: the vectors that can be used, as whole numbers."""

    def scale(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.filter(pc.is_valid(column(batch, vector)))
            lists = column(own, vector)
            at = lists.offsets.to_numpy()
            c = pc.fill_null(lists.values.cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False) * SCALE
            bad = ~(np.abs(c) < 2.0**63)
            before = np.concatenate([[0], np.cumsum(bad)])
            good = before[at[1:]] == before[at[:-1]]
            x = np.floor(np.where(bad, 0, c)).astype(np.int64)
            out = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(x))
            yield pa.RecordBatch.from_arrays([column(own, key), out], [key, "x"]).filter(pa.array(good))

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, vector).mapInArrow(scale, f"{key} {kind}, x array<bigint>")


def matrix(lists: pa.Array, d: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def centred(x: np.ndarray, n: int, sums: list[int], reach: int) -> np.ndarray:
    """n x - S: 64-bit numbers where they and the sum of two fit, else Python's own."""
    kind = np.int64 if 2 * reach + max(map(abs, sums)) < 1 << 62 else object
    return n * x.astype(kind) - np.array(sums, dtype=kind)


def square_sums(w: np.ndarray, reach: int) -> np.ndarray:
    """Exact sum of squares of each column; ``reach`` bounds the entries."""
    if w.dtype == object:
        return (w * w).sum(0)
    if len(w) * reach * reach < 1 << 62:
        return np.einsum("ij,ij->j", w, w).astype(object)
    low = (1 << LIMB) - 1
    limbs = [w & low, (w >> LIMB) & low, w >> 2 * LIMB]
    total = np.zeros(w.shape[1], dtype=object)
    for i in range(3):
        for j in range(i, 3):
            total += np.einsum("ij,ij->j", limbs[i], limbs[j]).astype(object) * ((1 if i == j else 2) << LIMB * (i + j))
    return total


def pair_sums(fit: DataFrame, n: int, sums: list[int], reach: int) -> DataFrame:
    """``i, j, high, low``: sum of (y_i + y_j)^2 for i < j, and of y_i^2 for i = j, of y = n x - S."""
    d = len(sums)
    first, second = np.triu_indices(d)

    def squares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(first), dtype=object)
        for batch in batches:
            y = centred(matrix(column(batch, "x"), d), n, sums, reach)
            at = 0
            for i in range(d):
                w = y[:, i:] + y[:, i : i + 1]
                w[:, 0] = y[:, i]
                total[at : at + d - i] += square_sums(w, 2 * reach)
                at += d - i
        yield pa.RecordBatch.from_arrays([
            pa.array(first, pa.int32()), pa.array(second, pa.int32()),
            pa.array([int(t) >> LOW for t in total], pa.decimal128(38, 0)), pa.array([int(t) & (1 << LOW) - 1 for t in total], pa.decimal128(20, 0)),
        ], ["i", "j", "high", "low"])

    each = fit.mapInArrow(squares, "i int, j int, high decimal(38,0), low decimal(20,0)")
    return each.groupBy("i", "j").agg(F.sum("high").alias("high"), F.sum("low").alias("low"))


def fit_whitening(fit: DataFrame) -> Whitening | None:
    """Fit on a table of different vectors ``x`` of one length; None if it has none."""
    by_dim = fit.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("v").cast("decimal(38,0)")).alias("s"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    dims = sorted(by_dim.collect())  # one row for each dimension
    if not dims:
        return None
    n, sums = dims[0]["n"], [int(r["s"]) for r in dims]
    reach = max(max(abs(n * r["lo"] - s), abs(n * r["hi"] - s)) for r, s in zip(dims, sums))
    d = len(sums)
    got = pair_sums(fit, n, sums, reach).toPandas()  # d (d + 1) / 2 rows
    table = np.zeros((d, d), dtype=object)
    for i, j, high, low in got.itertuples(index=False):
        table[i, j] = table[j, i] = (int(high) << LOW) + int(low)
    own = table.diagonal().copy()
    cross = (table - own[:, None] - own[None, :]) // 2
    np.fill_diagonal(cross, own)
    covariance = (cross / n**3).astype(float)
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")
    return Whitening(n, sums, reach, values[order], vectors[:, order].T, float(own.sum() / n**3))


def whitener(model: Whitening, components: int):
    """Function from centred vectors to their first whitened components."""
    usable = model.usable[:components]
    onto = (model.axes[:components] / np.sqrt(np.where(usable, model.values[:components], 1.0))[:, None]).T
    return lambda y: (y / model.n).astype(float) @ onto


def project(rows: DataFrame, key: str, model: Whitening, components: int) -> DataFrame:
    """``key, component, deviation, whitened`` for every row and component."""
    d, n, sums, reach = len(model.sums), model.n, model.sums, model.reach
    k = min(components, d)
    missing, to_white = ~model.usable[:k], whitener(model, k)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = centred(matrix(column(batch, "x"), d), n, sums, reach)
            wide = y if d * reach * reach < 1 << 62 else y.astype(object)
            total = [int(t) for t in (wide * wide).sum(1)]
            deviation = pa.array([t if t < 10**38 else None for t in total], pa.decimal128(38, 0))
            again = pa.array(np.repeat(np.arange(batch.num_rows), k))
            yield pa.RecordBatch.from_arrays([
                column(batch, key).take(again), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), batch.num_rows)),
                deviation.take(again), pa.array(to_white(y).ravel(), mask=np.tile(missing, batch.num_rows)),
            ], [key, "component", "deviation", "whitened"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.mapInArrow(apply, f"{key} {kind}, component int, deviation decimal(38,0), whitened double")


def identity_error(fit: DataFrame, model: Whitening, components: int) -> float | None:
    """Largest absolute entry of the whitened vectors' covariance over the fit list less the identity."""
    d, n, sums, reach = len(model.sums), model.n, model.sums, model.reach
    names = [i for i in range(min(components, d)) if model.usable[i]]
    if not names:
        return None
    to_white = whitener(model, components)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = to_white(centred(matrix(column(batch, "x"), d), n, sums, reach))
            yield pa.RecordBatch.from_arrays([pa.array(z[:, i]) for i in names], [f"z{i}" for i in names])

    z = fit.mapInArrow(apply, ", ".join(f"z{i} double" for i in names))
    parts = [F.abs(F.covar_pop(f"z{i}", f"z{j}") - F.lit(float(i == j))) for i in names for j in names if i <= j]
    return z.agg(F.array_max(F.array(*parts)).alias("e")).first()["e"]


def whiten(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = 4) -> DataFrame:
    """``key, component, n, deviation, whitened, explained, identity_error`` for every usable row and component."""
    small_batches(rows.sparkSession)
    own = whole_vectors(rows, key, vector)
    each = stored(own.select("x").distinct(), "whitening-fit")
    sizes = each.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    d = sizes["d"] if sizes else 0
    fit = each.filter(F.size("x") == d)
    model = fit_whitening(fit) if d else None
    if model is None:
        empty = own.filter("false").select(key, F.lit(0).alias("component"), F.lit(0).cast("decimal(38,0)").alias("deviation"), F.lit(0.0).alias("whitened"))
        return empty.select(key, "component", F.lit(0).cast("long").alias("n"), "deviation", "whitened", F.lit(None).cast("double").alias("explained"), F.lit(None).cast("double").alias("identity_error"))
    error = identity_error(fit, model, components)
    share = [float(v / model.trace) if model.trace > 0 else None for v in model.values[:components]]
    explained = F.element_at(F.array(*[F.lit(s).cast("double") for s in share]), F.col("component"))
    out = project(own.filter(F.size("x") == d), key, model, components)
    return out.select(key, "component", F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(error).cast("double").alias("identity_error"))

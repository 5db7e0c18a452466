"""Toxicity by a factorization machine over hashed terms.

Terms are the distinct lower-cased words of a text and their beginnings of
four to six letters (abuse is inflected and compounded like any word), hashed
to 30 bits.  Spark counts the slots of a bounded sample of labelled rows by label and keeps the
slots that tell the classes apart best (log-likelihood ratio); the machine
then learns for each slot a weight and a vector, so that a pair of slots (an
insult and the mention of a group) adds the product of their vectors beyond
the two weights.  Only the kept slots of the sampled rows reach the driver.
Scoring a text is one pass over its distinct words.

Cases: a null or empty text has no term and gets the intercept's score; a
text of any length is read whole; rows repeat freely, and of a labelled identifier's rows
one is learnt from; an empty table gives an
empty result; without both classes in the sample every score is the share of
label 1 (0 without labels).  Labels that are null are not used, and where a
document has several labels the largest counts; slots of equal gain are ranked by
number; extra columns, whatever their names, are never read by a score.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from titlelake.llm.common import clear_stored, column, doc_rows, small_batches, stored, stored_so_far

WORD = re.compile(r"\w+")
BEGINNINGS = (4, 5, 6)
#: Distinct words remembered for each worker.
CACHE_WORDS = 200_000


@dataclass
class Config:
    """``sample_rows`` bounds the labelled rows that training sees, half of
    them at most with label 1; nothing else is bounded.  ``least_gain`` is the
    log-likelihood ratio that a slot must reach (chance gives 15 to one in 9,000)."""

    sample_rows: int = 12_000
    hash_bits: int = 30
    slots: int = 1024
    least_gain: float = 15.0
    factors: int = 4
    epochs: int = 12
    batch: int = 256
    rate: float = 0.1
    l2_weight: float = 1e-4
    l2_factor: float = 1e-3
    seed: int = 17


@dataclass
class Model:
    """``slots``: the kept hash slots, ascending; row i of ``weight`` and ``factor`` belongs to slot i."""

    bits: int
    bias: float
    slots: np.ndarray
    weight: np.ndarray
    factor: np.ndarray
    cache: dict = field(default_factory=dict, repr=False, compare=False)

    def __post_init__(self) -> None:
        self.ordered = self.slots.tolist()

    def __getstate__(self):
        return self.__dict__ | {"cache": {}}

    def terms(self, text: str) -> list[int]:
        """Places of the kept slots that occur in the text, each once."""
        found, cache = set(), self.cache
        for w in set(WORD.findall(text.lower())):
            at = cache.get(w)
            if at is None:
                if len(cache) >= CACHE_WORDS:
                    cache.clear()
                at = cache[w] = tuple(i for h in slots_of(w, self.bits) if (i := self._place(h)) >= 0)
            if at:
                found.update(at)
        return sorted(found)

    def _place(self, slot: int) -> int:
        i = bisect_left(self.ordered, slot)
        return i if i < len(self.ordered) and self.ordered[i] == slot else -1

    def score(self, texts: list[str]) -> np.ndarray:
        rows = [self.terms(t) for t in texts]
        return sigmoid(margins(self.bias, self.weight, self.factor, *ragged(rows))[0])


def slots_of(word: str, bits: int) -> list[int]:
    """Slots of the word and of its beginnings (marked, so that a short word is no beginning)."""
    terms = [word, *("^" + word[:n] for n in BEGINNINGS if len(word) >= n)]
    return [zlib.crc32(t.encode("utf-8", "surrogatepass")) >> (32 - bits) for t in terms]


def all_slots(text: str, bits: int) -> np.ndarray:
    """Distinct slots of a text, ascending."""
    return np.unique(np.array([h for w in set(WORD.findall(text.lower())) for h in slots_of(w, bits)], dtype="<i4"))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def ragged(rows) -> tuple[np.ndarray, np.ndarray, int]:
    """Places of all rows one after the other, the row of each, and the number of rows."""
    n = np.array([len(r) for r in rows], dtype=np.int64)
    flat = np.array([x for r in rows for x in r], dtype=np.int64)
    return flat, np.repeat(np.arange(len(rows)), n), len(rows)


def margins(bias, weight, factor, flat, row, n):
    """Bias, weights and pairs: half of (squared sum less sum of squares) of the vectors."""
    out = bias + np.bincount(row, weights=weight[flat], minlength=n)
    sums = np.zeros((n, factor.shape[1]))
    np.add.at(sums, row, factor[flat])
    squares = np.bincount(row, weights=(factor[flat] ** 2).sum(1), minlength=n)
    return out + 0.5 * ((sums**2).sum(1) - squares), sums


def ratio(pos: Column, neg: Column, n_pos: int, n_neg: int) -> Column:
    """Log-likelihood ratio of a slot's presence and the label."""
    def xlogx(x: Column) -> Column:
        x = x.cast("double")
        return F.when(x > 0, x * F.log(x)).otherwise(0.0)

    n = F.lit(float(n_pos + n_neg))
    all_pos, all_neg = F.lit(float(n_pos)), F.lit(float(n_neg))
    cells = xlogx(pos) + xlogx(neg) + xlogx(all_pos - pos) + xlogx(all_neg - neg)
    return 2 * (cells + xlogx(n) - xlogx(pos + neg) - xlogx(n - pos - neg) - xlogx(all_pos) - xlogx(all_neg))


def train(kept: np.ndarray, sparse: list[np.ndarray], labels: np.ndarray, share: float, cfg: Config) -> Model:
    """Fit on the kept slots (ascending) and, for each sampled row, the places of those it has.  ``share`` is
    the share of label 1 among all training rows: the intercept is moved from the sample's to it."""
    y = labels.astype(float)
    n_pos, n_neg = int(y.sum()), int((1 - y).sum())
    if not n_pos or not n_neg:
        p = min(max(share, 1e-6), 1 - 1e-6)
        return Model(cfg.hash_bits, float(np.log(p / (1 - p))), np.zeros(0, np.int64), np.zeros(0), np.zeros((0, cfg.factors)))
    model = Model(cfg.hash_bits, 0.0, kept, np.zeros(len(kept)), np.zeros((len(kept), cfg.factors)))
    rng = np.random.default_rng(cfg.seed)
    model.factor = rng.normal(0, 0.01, model.factor.shape)
    bias, g_bias = float(np.log(n_pos / n_neg)), 1e-8
    g_w, g_v = np.full(len(kept), 1e-8), np.full(model.factor.shape, 1e-8)
    for _ in range(cfg.epochs):
        order = rng.permutation(len(sparse))
        for at in range(0, len(order), cfg.batch):
            own = order[at : at + cfg.batch]
            flat, row, n = ragged([sparse[i] for i in own])
            z, sums = margins(bias, model.weight, model.factor, flat, row, n)
            err = (sigmoid(z) - y[own]) / n
            grad = err.sum()
            g_bias += grad**2
            bias -= cfg.rate * grad / np.sqrt(g_bias)
            dw = np.bincount(flat, weights=err[row], minlength=len(kept)) + cfg.l2_weight * model.weight
            dv = np.zeros_like(model.factor)
            np.add.at(dv, flat, err[row, None] * (sums[row] - model.factor[flat]))
            dv += cfg.l2_factor * model.factor
            g_w += dw**2
            g_v += dv**2
            model.weight -= cfg.rate * dw / np.sqrt(g_w)
            model.factor -= cfg.rate * dv / np.sqrt(g_v)
    p = min(max(share, 1e-6), 1 - 1e-6)
    model.bias = bias + float(np.log(p / (1 - p)) - np.log(n_pos / n_neg))
    return model


def sampled(docs: DataFrame, labels: DataFrame, cfg: Config, label: str) -> tuple[DataFrame, float]:
    """``doc_id, y, s`` (the slots of the text as bytes) of ``sample_rows`` labelled rows at most, and the share of
    label 1 among all.

    The draw is by hash of the identifier, for each class its own share, so it is the same on every run.  A
    hash limit lets few more identifiers through than wanted; the first of them are taken, and
    of an identifier's rows the one with the least slots."""
    own = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    counts = {r["y"]: r["n"] for r in own.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    half, scale = cfg.sample_rows // 2, 1 << 30
    wanted = {c: min(n, half if c == 1 else cfg.sample_rows - min(half, counts.get(1, 0))) for c, n in counts.items()}
    drawn = own.withColumn("draw", F.pmod(F.xxhash64(F.col("doc_id"), F.lit(cfg.seed)), F.lit(scale)))
    firsts = [drawn.filter((F.col("y") == c) & (F.col("draw") < int(min(scale, scale * (1.05 * m + 200) / counts[c])))).orderBy("draw", "doc_id").limit(m) for c, m in wanted.items()]
    chosen = reduce(DataFrame.unionAll, firsts, drawn.limit(0)).select("doc_id", "y")
    bits = cfg.hash_bits

    @F.pandas_udf("binary")
    def slots(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            yield pd.Series([all_slots(t, bits).tobytes() for t in part])

    # at most ``sample_rows`` rows of two numbers: a bounded broadcast
    rows = doc_rows(docs).join(F.broadcast(chosen), "doc_id").select("doc_id", "y", slots("text").alias("s"))
    return rows.groupBy("doc_id", "y").agg(F.min("s").alias("s")), share


def slot_counts(sample: DataFrame) -> DataFrame:
    """``slot, pos, neg``: rows of each label that have the slot."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = column(batch, "y").to_numpy(zero_copy_only=False)
            s = [np.frombuffer(x, dtype="<i4") for x in column(batch, "s").to_pylist()]
            every, place = np.unique(np.concatenate([*s, np.zeros(0, "<i4")]), return_inverse=True)
            n = np.bincount(place, minlength=len(every))
            pos = np.bincount(place, weights=np.repeat(y == 1, [len(x) for x in s]), minlength=len(every)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(every.astype(np.int32)), pa.array(pos), pa.array(n - pos)], ["slot", "pos", "neg"])

    each = sample.select("y", "s").mapInArrow(count, "slot int, pos bigint, neg bigint")
    return each.groupBy("slot").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def places(sample: DataFrame, kept: np.ndarray) -> DataFrame:
    """``doc_id, y, at``: which of the kept slots each sampled row has, by their number."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = [np.flatnonzero(np.isin(kept, np.frombuffer(x, dtype="<i4"))).astype("<i2").tobytes() for x in column(batch, "s").to_pylist()]
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), column(batch, "y"), pa.array(at, pa.binary())], ["doc_id", "y", "at"])

    return sample.mapInArrow(look, f"doc_id {sample.schema['doc_id'].dataType.simpleString()}, y int, at binary")


def fit(docs: DataFrame, labels: DataFrame, cfg: Config = Config(), label: str = "toxic") -> Model:
    """Learn from the labelled rows given: callers filter ``labels`` first.

    What reaches the driver is the kept slots and which of them each sampled row has: at most
    ``sample_rows`` rows of ``2 * slots`` bytes, however long the texts and however often they repeat."""
    if not 0 < cfg.slots <= 1 << 15:
        raise ValueError("slots must be at most 32,768")
    small_batches(docs.sparkSession)
    mark = stored_so_far()
    rows, share = sampled(docs, labels, cfg, label)
    sample = stored(rows, "toxicity-sample")
    by_label = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_pos, n_neg = by_label.get(1, 0), sum(by_label.values()) - by_label.get(1, 0)
    gain = ratio(F.col("pos"), F.col("neg"), n_pos, n_neg)
    best = slot_counts(sample).filter("pos + neg >= 3").withColumn("gain", gain).filter(F.col("gain") > cfg.least_gain)
    kept = np.sort(np.array([r["slot"] for r in best.orderBy(F.desc("gain"), "slot").limit(cfg.slots).select("slot").collect()], dtype=np.int64))
    got = places(sample, kept).toArrow().sort_by("doc_id")
    clear_stored(docs.sparkSession, mark)
    sparse = [np.frombuffer(x, dtype="<i2").astype(np.int64) for x in got.column("at").to_pylist()]
    return train(kept, sparse, (got.column("y").to_numpy() == 1).astype(int), share, cfg)


def score_column(model: Model, text: str = "text") -> Column:
    """Score of each text, 0 to 1."""

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            yield pd.Series(model.score([t or "" for t in part]))

    return score(F.coalesce(F.col(text), F.lit("")))


def held_out() -> Column:
    """Rows that training never sees: crc32 of the identifier as text, remainder 0 by 5."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, cfg: Config = Config()) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every document."""
    model = fit(docs, labels.filter(~held_out()), cfg)
    return docs.select("doc_id", held_out().alias("held_out"), score_column(model).alias("score")).withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, cfg: Config = Config(), learn_from: DataFrame | None = None) -> DataFrame:
    """The documents that are not predicted toxic, with all their columns.  The
    labelled texts come from ``learn_from``, or from ``docs``."""
    model = fit(docs if learn_from is None else learn_from, labels.filter(~held_out()), cfg)
    return docs.filter(score_column(model) < 0.5)

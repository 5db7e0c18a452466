"""Collocations by dynamic itemset counting over cyclic scans of shards.

The corpus is cut into shards that are scanned in a circle.  All words are
active from the first scan on.  A longer phrase becomes active as soon as
both its parts, all words but the last and all but the first, have reached the
threshold in what they were counted in so far, and is then counted for one full circle, so lengths
interleave: pairs are counted in the second shard while words are still
counted there, and a phrase counted in every shard once has its exact count.
A phrase at the threshold has parts at the threshold, so none is missed.

What is active is told by a table of ``slots`` bytes: the scan after which a
phrase reached the threshold, under two hashes of it.  The table's size is
fixed, however many phrases there are; a phrase whose slots others have
set is merely counted too, and also for one full circle, since a slot
once set stays.  So the table decides how much is counted, never what is found.
Phrases themselves are compared as strings, in Spark's aggregates alone.

Texts are read and cut into words once.  They become blocks of word numbers with the
block's words; a scan counts a block's active phrases with sorted arrays, and Spark adds
the counts of blocks to those of earlier scans.  Phrases that have gone full circle
below the threshold are dropped there.

Cases: null, empty and wordless texts have no word; a null language counts as ``und``; texts of
any length are read whole; repeated rows and copies all count; ties of score and
count are ranked by the phrase's bytes; an empty table gives an empty result; extra
columns, whatever their names, are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from titlelake.llm.common import column, discard, shared_path, small_batches, texts_of
from titlelake.llm.shingles import mix

#: Stands between pieces: no byte of UTF-8.
BORDER = b"\xff"
UNSET = 255
_TURN = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Config:
    """``slots`` (a power of two) bytes are broadcast with each scan; ``block_words`` bounds a block
    unless one text has more."""

    least: int = 30
    longest: int = 4
    absorb_percent: int = 80
    top: int = 2000
    shards: int = 3
    slots: int = 1 << 24
    block_words: int = 1 << 20


def _bytes_table() -> bytes:
    table = bytearray(range(256))
    for c in b"ABCDEFGHIJKLMNOPQRSTUVWXYZ":
        table[c] = c + 32
    for c in b".,;:!?\n\x0b\x0c\r":
        table[c] = BORDER[0]
    table[ord("\t")] = ord(" ")
    return bytes(table)


class _Numbers(dict):
    """Number of each word of a block, by first occurrence; the border is 0."""

    def __init__(self) -> None:
        super().__init__({BORDER: 0})

    def __missing__(self, word: bytes) -> int:
        out = self[word] = len(self)
        return out


def blocks_of(docs: DataFrame, cfg: Config) -> DataFrame:
    """``shard, lang, words, ids, n``: a block's words, joined by spaces, its texts as word numbers (0 ends a piece), and its word count."""
    table, shards, most = _bytes_table(), cfg.shards, cfg.block_words

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        numbers: dict[str, _Numbers] = {}
        held: dict[str, list[np.ndarray]] = {}
        made, waiting = TaskContext.get().partitionId(), 0

        def block(lang: str) -> pa.RecordBatch:
            nonlocal made
            made += 1
            ids, own = np.concatenate(held.pop(lang)), numbers.pop(lang)
            return pa.RecordBatch.from_arrays([
                pa.array([made % shards], pa.int32()), pa.array([lang]), pa.array([b" ".join(own)], pa.binary()),
                pa.array([ids.tobytes()], pa.binary()), pa.array([int(np.count_nonzero(ids))], pa.int64()),
            ], ["shard", "lang", "words", "ids", "n"])

        for batch in batches:
            for lang, text in zip(column(batch, "lang").to_pylist(), texts_of(batch)):
                line = text.encode("utf-8", "surrogatepass").translate(table)
                found = (line.replace(BORDER, b" \xff ") + b" \xff").split()
                number = numbers.setdefault(lang, _Numbers())
                ids = np.fromiter(map(number.__getitem__, found), dtype="<i4", count=len(found))
                held.setdefault(lang, []).append(ids)
                waiting += len(ids)
                if waiting >= most:
                    # the fullest language goes, so that few blocks are small
                    full = max(held, key=lambda x: sum(map(len, held[x])))
                    waiting -= sum(map(len, held[full]))
                    yield block(full)
        for lang in list(held):
            yield block(lang)

    own = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    return own.mapInArrow(cut, "shard int, lang string, words binary, ids binary, n bigint")


def hashes(lang: str, words: list[bytes]) -> tuple[np.uint64, np.ndarray]:
    """The language's start value and the words' hashes."""
    one = xxhash.xxh3_64_intdigest
    return np.uint64(one(lang.encode("utf-8", "surrogatepass"), 1)), np.fromiter(map(one, words), dtype=np.uint64, count=len(words))


def longer(prefix: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hash of a phrase from that of all but its last word and its last word's."""
    return mix(prefix * _TURN + last)


def look_up(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Scan after which the phrases reached the threshold, or ``UNSET``."""
    mask = np.uint64(len(table) - 1)
    return np.maximum(table[h & mask], table[(h >> np.uint64(32)) & mask])


def exact_keys(numbers: list[np.ndarray], words: int) -> np.ndarray:
    """One number for each tuple of word numbers, different for different tuples."""
    key, size = numbers[0].astype(np.int64), words
    for one in numbers[1:]:
        if size * words >= 1 << 62:
            values, key = np.unique(key, return_inverse=True)
            size = len(values)
        key, size = key * words + one, size * words
    return key


def active_counts(lang: str, words: list[bytes], ids: np.ndarray, table: np.ndarray, scan: int, cfg: Config) -> Iterator[tuple[int, pa.Array, np.ndarray, np.ndarray]]:
    """For each length: its number, the phrases active in this scan, their counts here, the scan that activated them."""
    spelled = pa.array(["", *(w.decode("utf-8") for w in words[1:])])
    if scan < cfg.shards:  # words are active from the start
        count = np.bincount(ids, minlength=len(words))[1:]
        yield 1, spelled.slice(1), count, np.full(len(count), -1)
    start, each = hashes(lang, words)
    # at: places of phrases of the length before whose both parts are set (of words: all); h: their hashes
    h = longer(np.full(1, start), each)[ids]
    since = look_up(table, longer(np.full(1, start), each))
    since[0] = UNSET
    since, at = since[ids], np.arange(len(ids))
    for length in range(2, cfg.longest + 1):
        # since[k] belongs to the place at[k]; a phrase here needs its two parts at places one apart
        pairs = np.flatnonzero((at[1:] == at[:-1] + 1) & (since[1:] < scan) & (since[:-1] < scan))
        at, h, act = at[pairs], h[pairs], np.maximum(since[pairs], since[pairs + 1]).astype(np.int64)
        if not len(at):
            return
        now = np.flatnonzero(scan <= act + cfg.shards)
        if len(now):
            numbers = [ids[at[now] + i] for i in range(length)]
            _, first, count = np.unique(exact_keys(numbers, len(words)), return_index=True, return_counts=True)
            spell = [spelled.take(pa.array(one[first])) for one in numbers]
            yield length, pc.binary_join_element_wise(*spell, " "), count, act[now][first]
        if length < cfg.longest:
            h = longer(h, each[ids[at + length - 1]])
            # slots set by others may tell of a phrase before its parts were set: it counts from then on
            since = np.maximum(look_up(table, h), act.astype(np.uint8))


def scanned(blocks: DataFrame, shared, scan: int, cfg: Config) -> DataFrame:
    """``key, act, c`` of the active phrases of the blocks given, where a key is language, tab, phrase (phrases
    have no tab): one short string to be compared.  ``shared`` broadcasts the slots."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(shared.value, dtype=np.uint8)
        for batch in batches:
            for lang, words, ids in zip(column(batch, "lang").to_pylist(), column(batch, "words").to_pylist(), column(batch, "ids").to_pylist()):
                for _, phrase, c, act in active_counts(lang, words.split(b" "), np.frombuffer(ids, dtype="<i4"), table, scan, cfg):
                    key = pc.binary_join_element_wise(pa.scalar(lang), phrase, "\t")
                    yield pa.RecordBatch.from_arrays([key, pa.array(act.astype(np.int16)), pa.array(c.astype(np.int64))], ["key", "act", "c"])

    return blocks.select("lang", "words", "ids").mapInArrow(count, "key string, act smallint, c bigint")


def named(rows: DataFrame, *more: Column) -> DataFrame:
    """``lang, phrase, length`` of rows with a ``key``, and the columns given."""
    phrase = F.substring_index("key", "\t", -1)
    lang = F.substr("key", F.lit(1), F.length("key") - F.length(phrase) - 1)
    return rows.select(lang.alias("lang"), phrase.alias("phrase"), (F.length(phrase) - F.length(F.replace(phrase, F.lit(" "), F.lit(""))) + 1).alias("length"), *more)


def slots_of(phrases: DataFrame, slots: int) -> DataFrame:
    """``word, bits``: the slots of the phrases given, 64 in a row: at most ``slots / 64`` rows."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = np.uint64(slots - 1)
        for batch in batches:
            hs = []
            for lang, phrase in zip(column(batch, "lang").to_pylist(), column(batch, "phrase").to_pylist()):
                start, each = hashes(lang, phrase.encode("utf-8", "surrogatepass").split(b" "))
                h = np.full(1, start)
                for one in each:
                    h = longer(h, one)
                hs.append(h[0])
            h = np.array(hs, dtype=np.uint64)
            both = np.unique(np.concatenate([h & mask, (h >> np.uint64(32)) & mask]))
            word, first = np.unique(both >> np.uint64(6), return_index=True)
            bits = np.bitwise_or.reduceat(np.uint64(1) << (both & np.uint64(63)), first) if len(both) else both
            yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int64)), pa.array(bits.view(np.int64))], ["word", "bits"])

    each = phrases.select("lang", "phrase").mapInArrow(place, "word bigint, bits bigint")
    return each.groupBy("word").agg(F.bit_or("bits").alias("bits"))


def mark(table: np.ndarray, reached: DataFrame, scan: int) -> bool:
    """Set the slots of the phrases given that are not set; tells whether there was any."""
    got = slots_of(reached, len(table)).toArrow()
    word, bits = got.column("word").to_numpy(), got.column("bits").to_numpy().view(np.uint64)
    own = np.flatnonzero(np.unpackbits(bits.astype("<u8").view(np.uint8), bitorder="little"))
    at = word[own >> 6] * 64 + (own & 63)
    new = at[table[at] == UNSET]
    table[new] = scan
    return len(new) > 0


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def phrase_counts(docs: DataFrame, cfg: Config = Config()) -> tuple[DataFrame, DataFrame]:
    """``lang, phrase, length, f`` of all phrases (words too) that occur ``least`` times or more, and
    ``lang, n``: all word occurrences."""
    spark: SparkSession = docs.sparkSession
    if not 1 <= cfg.shards <= UNSET // cfg.longest - 1:
        raise ValueError("too many shards")
    if cfg.slots & (cfg.slots - 1) or not 64 <= cfg.slots <= 1 << 32:
        raise ValueError("slots must be a power of two")
    small_batches(spark)
    home = shared_path(spark, "collocations")
    cut = blocks_of(docs, cfg)
    # small row groups: a reader holds one of them at a time
    cut.write.partitionBy("shard").option("parquet.block.size", 16 << 20).parquet(f"{home}/blocks")
    blocks = spark.read.schema(cut.schema).parquet(f"{home}/blocks")
    table = np.full(cfg.slots, UNSET, dtype=np.uint8)
    state, done, last, scan = None, [], -1, 0
    while scan <= last + cfg.shards:
        shared = spark.sparkContext.broadcast(table.tobytes())
        rows = scanned(blocks.filter(F.col("shard") == scan % cfg.shards), shared, scan, cfg)
        if state is not None:
            rows = rows.unionAll(state.filter(F.col("act") + cfg.shards >= scan))
        # a phrase has one activating scan, the same in all its rows
        summed = rows.groupBy("key").agg(F.min("act").alias("act"), F.sum("c").alias("c"))
        after = _written(summed, f"{home}/state-{scan}")
        whole = after.filter((F.col("act") + cfg.shards == scan) & (F.col("c") >= cfg.least))
        done.append(_written(named(whole, F.col("c").alias("f")), f"{home}/done-{scan}"))
        if mark(table, named(after.filter(F.col("c") >= cfg.least)).filter(F.col("length") < cfg.longest), scan):
            last = scan
        if state is not None:
            discard(spark, f"{home}/state-{scan - 1}")
        shared.destroy()
        state, scan = after, scan + 1
    discard(spark, f"{home}/state-{scan - 1}")
    found = done[0]
    for one in done[1:]:
        found = found.unionAll(one)
    total = _written(blocks.groupBy("lang").agg(F.sum("n").alias("n")), f"{home}/words")
    discard(spark, f"{home}/blocks")
    return found, total


def wide(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(20,0)")


def collocations(docs: DataFrame, cfg: Config = Config()) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's best phrases."""
    counts, total = phrase_counts(docs, cfg)
    cands = counts.filter("length > 1").select("lang", "phrase", "length", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    joined = lambda words: F.array_join(words, " ")
    # the cut with the lowest score; both parts occur as often as the phrase, so both are in the table
    cut = F.struct(F.col("k"), joined(F.slice("w", F.lit(1), F.col("k"))).alias("first"), joined(F.slice("w", F.col("k") + 1, F.col("length") - F.col("k"))).alias("rest"))
    cuts = cands.select("lang", "phrase", "length", "a", "w", F.explode(F.sequence(F.lit(1), F.col("length") - 1)).alias("k")).select("lang", "phrase", "a", cut.alias("cut")).select("lang", "phrase", "a", "cut.*")
    left = counts.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    right = counts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    both = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"])
    score = F.expr("(cast(2000000 as decimal(7,0)) * cast(a as decimal(20,0))) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    best = both.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))
    # the most frequent longer phrase around each shorter one
    shorter = F.expr("flatten(transform(sequence(2, cast(length as int) - 1), m -> transform(sequence(1, cast(length as int) - m + 1), i -> array_join(slice(w, i, m), ' '))))")
    around = cands.filter("length > 2").select("lang", F.col("a").alias("more"), F.explode(shorter).alias("phrase")).groupBy("lang", "phrase").agg(F.max("more").alias("more"))
    kept = best.join(around, ["lang", "phrase"], "left").filter(F.col("more").isNull() | (100 * wide("more") < cfg.absorb_percent * wide("a")))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = kept.select("lang", "phrase", "a", "b.l", "b.r", "b.score").withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= cfg.top)
    return ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

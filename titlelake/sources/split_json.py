"""JSON documents that are one array, read in splits (S6, S9): one large file is many tasks.

An array may be a single line of any length, so Spark's text reader deals
the file at a character instead: at ``}`` for objects, at ``,`` for scalars.  Whether such a
character ends an element is told by two numbers, whether a string is open and how many
brackets are:

1. a first pass gives, for each split, the change of both numbers, for a
   start outside a string and for one inside;
2. running through a file's splits gives both numbers at each split's start;
3. a second pass cuts the elements.  What an element that crosses splits has in each is a fragment;
   a split has one at its end and one at its start, and those that follow one another are put together.

Every element must be preceded by the array's bracket or one comma, the last must be followed by
the closing bracket and nothing else, and elements are parsed strictly, so malformed
documents fail.  What reaches the driver is one row of numbers for each split.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from titlelake.sources.split_csv import fixed_splits

ESCAPE = re.compile(rb"\\.", re.DOTALL)
WHOLE, START, INNER, END = range(4)
SPACE = "[ \\t\\r\\n]*"


def _chunks(spark: SparkSession, path: str, sep: str) -> DataFrame:
    fixed_splits(spark)
    at = F.col("_metadata.file_path")
    return spark.read.option("lineSep", sep).text(path).select(at.alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("chunk"))


def _outside(chunk: bytes, inside: bool) -> tuple[bool, int]:
    """Whether a string is open after the chunk, and the change of depth outside strings."""
    if b"\\" in chunk:
        chunk = ESCAPE.sub(b"", chunk)
    parts = chunk.split(b'"')
    open_ = parts[1::2] if inside else parts[0::2]
    depth = sum(p.count(b"{") + p.count(b"[") - p.count(b"}") - p.count(b"]") for p in open_)
    return inside ^ (len(parts) % 2 == 0), depth


def _after(chunk: bytes, inside: bool, depth: int, closes: bool) -> tuple[bool, int]:
    """State after the chunk and the separator that follows it."""
    inside, change = _outside(chunk, inside)
    return inside, depth + change - (closes and not inside)


def _states(spark: SparkSession, path: str, sep: str) -> dict[str, dict[int, tuple[bool, int]]]:
    """For each file, by path, the state at the start of each of its splits."""
    closes = sep == "}"

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, states = None, []

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now[0]]), pa.array([now[1]], pa.int64()), *(pa.array([v], k) for (i, d) in states for v, k in ((i, pa.bool_()), (d, pa.int64())))],
                                              ["path", "block", "i0", "d0", "i1", "d1"])

        for batch in batches:
            for path_, block, chunk in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if (path_, block) != now:
                    if now:
                        yield row()
                    now, states = (path_, block), [(False, 0), (True, 0)]
                states = [_after(chunk, *s, closes) for s in states]
        if now:
            yield row()

    rows = _chunks(spark, path, sep).mapInArrow(look, "path string, block bigint, i0 boolean, d0 bigint, i1 boolean, d1 bigint").collect()
    out: dict[str, dict[int, tuple[bool, int]]] = {}
    for r in sorted(rows, key=lambda r: (r["path"], r["block"])):
        own = out.setdefault(r["path"], {})
        if not own:
            state = (False, 0)
        own[r["block"]] = state
        state = (r["i1"], state[1] + r["d1"]) if state[0] else (r["i0"], state[1] + r["d0"])
    return out


def elements(spark: SparkSession, path: str, sep: str) -> DataFrame:
    """``file, place, first, last, text``: the elements as they stand, with the comma or bracket before them;
    ``place`` counts them within a file, ``first`` and ``last`` tell of its ends."""
    closes = sep == "}"
    states = _states(spark, path, sep)
    number = {p: i for i, p in enumerate(sorted(states))}
    shared = spark.sparkContext.broadcast((states, number))
    end = sep.encode() if closes else b""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, order = shared.value
        now, held, done = None, [], 0
        inside, depth = False, 0
        out: list[tuple] = []

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out))
            out.clear()
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], ["file", "block", "nth", "kind", "text"])

        def close() -> None:
            # every split has one last fragment, be it empty
            alone = done == 0 and now[1] > 0
            out.append((order[now[0]], now[1], done, INNER if alone else END, sep.encode().join(held)))

        for batch in batches:
            for path_, block, chunk in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if (path_, block) != now:
                    if now:
                        close()
                    now, held, done = (path_, block), [], 0
                    if block not in starts.get(path_, ()):
                        raise ValueError("the splits of the files changed between two passes over them")
                    inside, depth = starts[path_][block]
                held.append(chunk)
                inside, depth = _after(chunk, inside, depth, closes)
                if depth == 1 and not inside:
                    kind = START if done == 0 and block > 0 else WHOLE
                    out.append((order[path_], block, done, kind, sep.encode().join(held) + end))
                    held, done = [], done + 1
            if out:
                yield flush()
        if now:
            close()
        if out:
            yield flush()

    found = _chunks(spark, path, sep).mapInArrow(cut, "file int, block bigint, nth bigint, kind int, text binary")
    found = found.withColumn("text", F.col("text").cast("string"))
    whole = found.where(F.col("kind") == WHOLE).select("file", "block", "nth", ((F.col("block") == 0) & (F.col("nth") == 0)).alias("first"), F.lit(False).alias("last"), "text")
    # an element that crosses splits: the end of one, whole splits, the start of another
    by_place = Window.partitionBy("file").orderBy("block", "nth", "kind")
    parts = found.where(F.col("kind") != WHOLE).withColumn("run", F.sum((F.col("kind") == END).cast("long")).over(by_place))
    joined = parts.groupBy("file", "run").agg(
        F.min(F.struct("block", "nth")).alias("at"), F.array_sort(F.collect_list(F.struct("block", "nth", "kind", "text"))).alias("parts"), F.bool_or(F.col("kind") == START).alias("ends"))
    # a chunk that a split ends with was followed by the separator, unless an element ended with it or the file did
    text = F.aggregate("parts", F.struct(F.lit("").alias("text"), F.lit(False).alias("open")), lambda a, p: F.struct(
        F.concat(a["text"], F.when(a["open"], F.lit(sep)).otherwise(F.lit("")), p["text"]).alias("text"),
        (a["open"] | (p["kind"] != START) & (p["text"] != "")).alias("open")), lambda a: a["text"])
    # elements ended in the splits before
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    earlier = parts.where(F.col("kind").isin(END, INNER)).select("file", "block", F.coalesce(F.sum("nth").over(before), F.lit(0)).alias("before"))
    crossing = joined.select("file", "at.block", "at.nth", ((F.col("at.block") == 0) & (F.col("at.nth") == 0)).alias("first"), (~F.col("ends")).alias("last"), text.alias("text"))
    every = whole.unionAll(crossing).join(earlier, ["file", "block"])
    return every.select("file", (F.col("before") + F.col("nth")).alias("place"), "first", "last", "text")


def _fail(what: str) -> Column:
    return F.raise_error(F.lit(what)).cast("string")


def _body(first: str = "first") -> Column:
    """The text without what must stand before an element."""
    text = F.regexp_replace("text", "^\\x{FEFF}", "")
    opened = F.when(text.rlike("(?s)^" + SPACE + "\\[.*"), F.regexp_replace(text, "^" + SPACE + "\\[", "")).otherwise(_fail("the document's top level is no array"))
    return opened


def array_objects(spark: SparkSession, path: str) -> DataFrame:
    """``json``: the text of each object of the files' arrays; JSON nulls are left out."""
    parts = elements(spark, path, "}")
    after_comma = F.when(F.col("text").rlike("(?s)^" + SPACE + ",.*"), F.regexp_replace("text", "^" + SPACE + ",", "")).otherwise(_fail("an element of the array does not follow a comma"))
    body = F.when(F.col("first"), _body()).otherwise(F.when(F.col("last"), F.col("text")).otherwise(after_comma))
    nulls = "^(" + SPACE + "null" + SPACE + ",)+" + SPACE
    own = parts.select("last", "first", F.regexp_replace(body, nulls, "").alias("json"))
    rest = SPACE + "\\]" + SPACE
    only_nulls = "(null" + SPACE + "(," + SPACE + "null" + SPACE + ")*)?"
    closed = F.when(F.col("first"), F.col("json").rlike("^" + SPACE + only_nulls + rest + "$")).otherwise(
        F.col("json").rlike("^" + SPACE + "(," + SPACE + "null" + SPACE + ")*" + rest + "$"))
    text = F.when(F.col("last"), F.when(closed, F.lit(None).cast("string")).otherwise(_fail("the array does not end with its closing bracket"))).otherwise(F.col("json"))
    got = own.select(text.alias("json")).where(F.col("json").isNotNull())
    return got.select(F.when(F.col("json").rlike("(?s)^" + SPACE + "\\{.*"), F.col("json")).otherwise(_fail("an element of the array is no object")).alias("json"))


def array_scalars(spark: SparkSession, path: str) -> DataFrame:
    """``pos, value``: the elements of the files' arrays as strings (JSON nulls are null), by their place in the file."""
    parts = elements(spark, path, ",")
    body = F.when(F.col("first"), _body()).otherwise(F.col("text"))
    own = parts.select(F.col("place").cast("int").alias("pos"), "first", "last", body.alias("t"))
    closed = F.when(F.col("t").rlike("(?s)^.*\\]" + SPACE + "$"), F.regexp_replace("t", "\\]" + SPACE + "$", "")).otherwise(_fail("the array does not end with its closing bracket"))
    own = own.withColumn("t", F.when(F.col("last"), closed).otherwise(F.col("t")))
    own = own.where(~(F.col("first") & F.col("last") & F.col("t").rlike("^" + SPACE + "$")))
    # one value and nothing else: the text is the one entry of an array
    entry = F.from_json(F.concat(F.lit("["), "t", F.lit("]")), "array<string>", {"mode": "FAILFAST"})
    one = F.when(F.size(entry) == 1, F.get(entry, F.lit(0))).otherwise(_fail("an element of the array is no JSON value"))
    return own.select("pos", one.alias("value"))

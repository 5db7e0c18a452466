"""CSV with quoted line feeds, read in splits (S1-S3): one large file is many tasks.

A quoted field may hold line feeds, so a line is not a record.  Whether a line
starts one is told by the number of quote characters before it in the file, even or odd:

1. Spark's text reader deals lines to splits; a first pass counts, for each split,
   its lines with an odd number of quotes (and keeps each file's
   first line and whether its bytes are UTF-8);
2. running sums over a file's splits give the state at each split's start;
3. a second pass joins the lines of each record within its split.  What a record that crosses splits has in each
   is a fragment, and fragments are put together by an aggregate on the split that the record starts in.

Fields are cut by Spark's own CSV parser, a record at a time.  Each file's
header binds that file's fields, and each file has its own encoding.  What
reaches the driver is one row of numbers for each split, and each file's header.
"""

from __future__ import annotations

import codecs
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

OPTIONS = {"quote": '"', "escape": '"', "mode": "PERMISSIVE"}
#: Encodings in which a line feed and a quote are one byte that nothing else has.
BYTEWISE = ("utf-8", "iso8859-1", "cp1252", "ascii")
UTF8 = "utf-8"
FALLBACK = "iso8859-1"


def can_split(encoding: str) -> bool:
    return encoding == "auto" or codecs.lookup(encoding).name in BYTEWISE


def fixed_splits(spark: SparkSession) -> None:
    """Two passes must cut files alike, also when executors come and go in between."""
    if spark.conf.get("spark.sql.files.minPartitionNum", None) is None:
        spark.conf.set("spark.sql.files.minPartitionNum", str(spark.sparkContext.defaultParallelism))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, block, path, line`` in the order of each split."""
    fixed_splits(spark)
    at = F.col("_metadata.file_path")
    return spark.read.option("lineSep", "\n").text(path).select(
        F.xxhash64(at).alias("file"), F.col("_metadata.file_block_start").alias("block"), at.alias("path"), F.col("value").alias("line"))


def _odd(line: Column) -> Column:
    return (F.octet_length(line) - F.octet_length(F.replace(line, F.lit('"'), F.lit("")))) % 2


def _look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each split: odd lines, all valid, and of a file's first split its path and first line."""
    now, found = None, None
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.binary()]
    row = lambda: pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip([*now, *found], kinds)], ["file", "block", "odd", "utf8", "path", "line"])
    for batch in batches:
        if not batch.num_rows:
            continue
        files, blocks, odd, valid = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        change = np.flatnonzero((np.diff(files) != 0) | (np.diff(blocks) != 0)) + 1
        for a, b in zip([0, *change.tolist()], [*change.tolist(), batch.num_rows]):
            if (files[a], blocks[a]) != now:
                if now:
                    yield row()
                now, found = (files[a], blocks[a]), [0, True, batch.column(4)[a].as_py(), batch.column(5)[a].as_py()]
            found[0] += int(odd[a:b].sum())
            found[1] = bool(found[1] and valid[a:b].all())
    if now:
        yield row()


class Splits:
    """What the first pass finds.  ``start``: for each (file, block), whether a record is open there and the
    block that it started in; ``headers``: the different headers; ``of``: header number and encoding of each file."""

    def __init__(self, spark: SparkSession, path: str, encoding: str) -> None:
        at_start = F.col("block") == 0
        looked = _lines(spark, path).select(
            "file", "block", _odd(F.col("line")).cast("int").alias("odd"), F.is_valid_utf8("line").alias("utf8"),
            F.when(at_start, F.col("path")).alias("path"), F.when(at_start, F.col("line").cast("binary")).alias("line"))
        rows = looked.mapInArrow(_look, "file bigint, block bigint, odd bigint, utf8 boolean, path string, line binary").collect()
        self.start: dict[tuple[int, int], tuple[int, int]] = {}
        self.of: dict[int, tuple[int, str]] = {}
        self.headers: list[list[str]] = []
        splits: dict[int, list] = {}
        for r in rows:
            splits.setdefault(r["file"], []).append(r)
        files = [sorted(own, key=lambda r: r["block"]) for own in splits.values()]
        if len({(r["file"], r["block"]) for r in rows}) < len(rows):
            raise ValueError("two of the files have the same hash: read them apart")
        names: dict[tuple, int] = {}
        for own in sorted(files, key=lambda x: x[0]["path"]):
            first = own[0]
            kind = codecs.lookup(encoding).name if encoding != "auto" else UTF8 if all(r["utf8"] for r in own) else FALLBACK
            header = self._header(spark, first["path"], bytes(first["line"]), kind)
            if tuple(header) not in names:
                names[tuple(header)] = len(names)
                self.headers.append(header)
            self.of[first["file"]] = names[tuple(header)], kind
            open_, owner = 0, 0
            for r in own:
                self.start[r["file"], r["block"]] = open_, owner
                if r["odd"]:
                    open_, owner = (open_ + r["odd"]) % 2, r["block"]

    @staticmethod
    def _header(spark: SparkSession, path: str, line: bytes, encoding: str) -> list[str]:
        if line.count(b'"') % 2:  # a header over several lines: one short read
            head = spark.read.options(multiLine=True, encoding=encoding, **OPTIONS).csv(path).limit(1).collect()
            return [c or "" for c in head[0]] if head else []
        text = line.decode(encoding, "replace").rstrip("\r").removeprefix("﻿")
        if not text:
            return []
        fields = spark.range(1).select(F.from_csv(F.lit(text), ", ".join(f"c{i} string" for i in range(text.count(",") + 1)), OPTIONS).alias("h")).first()["h"]
        while len(fields) > 1 and fields[-1] is None:  # commas within quotes
            fields = fields[:-1]
        return [c or "" for c in fields]


RECORDS = "file bigint, header int, owner bigint, block bigint, record binary"


def records(spark: SparkSession, path: str, splits: Splits) -> DataFrame:
    """``header, record``: each record of the files, without their headers, as UTF-8 text."""
    shared = spark.sparkContext.broadcast((splits.start, splits.of))

    def join(batches: Iterator[pa.RecordBatch], crossing: bool) -> Iterator[pa.RecordBatch]:
        """The split's whole records, or (``crossing``) the fragments at its ends: only their lines are cut out then."""
        start, of = shared.value
        now, held, odd_so_far, owner, skip = None, [], 0, None, False

        def rows(texts: list[bytes], own: int | None) -> pa.RecordBatch:
            file, block = now
            header, encoding = of[file]
            if encoding != UTF8:
                texts = [t.decode(encoding, "replace").encode() for t in texts]
            n = len(texts)
            return pa.RecordBatch.from_arrays([
                pa.array([file] * n, pa.int64()), pa.array([header] * n, pa.int32()), pa.array([own] * n, pa.int64()),
                pa.array([block] * n, pa.int64()), pa.array(texts, pa.binary())], ["file", "header", "owner", "block", "record"])

        for batch in batches:
            if not batch.num_rows:
                continue
            files, blocks = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            change = np.flatnonzero((np.diff(files) != 0) | (np.diff(blocks) != 0)) + 1
            for a, b in zip([0, *change.tolist()], [*change.tolist(), batch.num_rows]):
                key = int(files[a]), int(blocks[a])
                if key != now:
                    if held and crossing:
                        yield rows([b"\n".join(held)], owner)
                    now, held = key, []
                    if key not in start:
                        raise ValueError("the splits of the files changed between two passes over them")
                    odd_so_far, before = start[key]
                    # what is open here started in another split
                    owner, skip = (before, False) if odd_so_far else (key[1], key[1] == 0)
                own = batch.column(2).slice(a, b - a)
                after = (odd_so_far + np.cumsum(pc.count_substring(own, '"').to_numpy(zero_copy_only=False) & 1)) & 1
                ends = np.flatnonzero(after == 0)
                odd_so_far = int(after[-1])
                if crossing:
                    if len(ends):
                        if owner != now[1]:  # the end of a record of another split
                            yield rows([b"\n".join([*held, *own.slice(0, int(ends[0]) + 1).to_pylist()])], owner)
                            owner = now[1]
                        held = own.slice(int(ends[-1]) + 1).to_pylist()
                    else:
                        held += own.to_pylist()
                    continue
                lines = own.to_pylist()
                whole, at = [], 0
                for end in ends.tolist():
                    text = lines[at] if end == at and not held else b"\n".join([*held, *lines[at : end + 1]])
                    at, held = end + 1, []
                    if owner != now[1]:  # a fragment
                        owner = now[1]
                    elif skip:
                        skip = False
                    else:
                        whole.append(text)
                held += lines[at:]
                if whole:
                    yield rows(whole, None)
        if held and crossing:
            yield rows([b"\n".join(held)], owner)

    lines = _lines(spark, path).select("file", "block", F.col("line").cast("binary").alias("line"))
    # a pass each, as one result for both would be read by two plans and made twice
    found = lines.mapInArrow(lambda batches: join(batches, False), RECORDS)
    parts = lines.mapInArrow(lambda batches: join(batches, True), RECORDS).groupBy("file", "header", "owner").agg(
        F.array_sort(F.collect_list(F.struct("block", "record"))).alias("parts"))
    text = lambda c: F.make_valid_utf8(c.cast("string"))
    crossing = F.array_join(F.transform("parts", lambda p: text(p["record"])), "\n")
    out = found.select("header", text(F.col("record")).alias("record"))
    out = out.unionAll(parts.select("header", crossing.alias("record")))
    ended = F.when(F.endswith("record", F.lit("\r")), F.expr("left(record, char_length(record) - 1)")).otherwise(F.col("record"))
    return out.select("header", ended.alias("record")).where(F.col("record") != "")


def read_split_csv(spark: SparkSession, path: str, columns: list[str] | None = None, encoding: str = "UTF-8") -> DataFrame:
    """The named columns (or those of the first file) as strings.

    A column that a file lacks is null there; records with more fields than
    their file's header are skipped, short ones are null-padded."""
    splits = Splits(spark, path, encoding)
    columns = columns if columns is not None else (splits.headers[0] if splits.headers else [])
    width = max([len(h) for h in splits.headers], default=0)
    fields = F.from_csv("record", ", ".join(f"c{i} string" for i in range(width + 1)), OPTIONS)
    # as a generator: a record is parsed once, not once for each field that is read from it
    cut = records(spark, path, splits).select("header", F.inline(F.array(fields))).select(
        "header", F.array(*[F.col(f"c{i}") for i in range(width + 1)]).alias("f"))
    of_header = lambda values: F.get(F.array(*[F.lit(v) for v in values]), F.col("header"))
    if not splits.headers:
        return cut.select(*[F.lit(None).cast("string").alias(c) for c in columns])
    size = of_header([len(h) for h in splits.headers])
    fits = ~F.exists(F.slice("f", size + 1, F.lit(width + 1) - size), lambda x: x.isNotNull())
    place = {c: [h.index(c) if c in h else -1 for h in splits.headers] for c in columns}
    return cut.where(fits).select(*[F.when(of_header(place[c]) >= 0, F.get("f", of_header(place[c]))).alias(c) for c in columns])

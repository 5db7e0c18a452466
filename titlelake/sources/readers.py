"""Readers (S1-S12). Every reader returns a DataFrame with an explicit
schema and does its filtering with Spark expressions (no driver-side row
loops)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from titlelake.functions.text import safe_strip
from titlelake.sources.split_csv import can_split, read_split_csv
from titlelake.sources.split_json import array_objects, array_scalars

OVERFLOW = "__overflow"


def read_trending_csv(spark: SparkSession, path: str, schema: T.StructType, encoding: str = "UTF-8") -> DataFrame:
    """Header CSV with quoted newlines and doubled-quote escapes. Each file's
    header binds its columns by name, whatever their order and however many
    there are; a column of the schema that a file lacks is null, and a value
    that does not parse is null. Rows with more fields than their file's header are
    skipped, short rows are null-padded.

    Files are read in splits (``titlelake.sources.split_csv``). ``encoding="auto"`` reads each file
    as UTF-8, or as ISO-8859-1 where its bytes are no UTF-8."""
    cut = read_csv_fields(spark, path, [f.name for f in schema.fields], encoding)
    return cut.select(*[F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in schema.fields])


def read_csv_fields(spark: SparkSession, path: str, columns: Sequence[str] | None = None, encoding: str = "UTF-8") -> DataFrame:
    """The named columns as strings (all of the first file's header without names); files of an encoding
    in which a line feed is no single byte are one task each."""
    if can_split(encoding):
        return read_split_csv(spark, path, None if columns is None else list(columns), encoding)
    return read_whole_csv(spark, path, columns, encoding)


def read_whole_csv(spark: SparkSession, path: str, columns: Sequence[str] | None = None, encoding: str = "UTF-8") -> DataFrame:
    """As ``read_csv_fields``, by Spark's multi-line reader: a file is a task and the first file's header binds all.

    A trailing sentinel column catches overflow fields: a row that fills it had too many fields
    and is dropped. (DROPMALFORMED would also drop short rows.)"""
    names = csv_header(spark, path, encoding)
    wide = T.StructType([T.StructField(f"__c{i}", T.StringType()) for i in range(len(names))] + [T.StructField(OVERFLOW, T.StringType())])
    df = (spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"')
          .option("mode", "PERMISSIVE").option("encoding", encoding).schema(wide).csv(path))
    at = {n: i for i, n in reversed(list(enumerate(names)))}
    return df.where(F.col(OVERFLOW).isNull()).select(*[
        (F.col(f"__c{at[c]}") if c in at else F.lit(None).cast("string")).alias(c) for c in (names if columns is None else columns)])


def csv_header(spark: SparkSession, path: str, encoding: str = "UTF-8") -> list[str]:
    """Column names of the header row (one short read of the first file)."""
    head = (spark.read.option("header", False).option("multiLine", True).option("quote", '"').option("escape", '"')
            .option("encoding", encoding).csv(path).limit(1).collect())
    return [c or "" for c in head[0]] if head else []


def transcode_csv(spark: SparkSession, src: str, dst: str, src_encoding: str = "ISO-8859-1") -> None:
    """Re-encode a CSV table as UTF-8 (all columns kept as text)."""
    from titlelake.sources.sinks import write_csv
    write_csv(read_csv_fields(spark, src, encoding=src_encoding), dst)


def read_csv_strings(spark: SparkSession, path: str, required: tuple = ("video_id", "title")) -> DataFrame:
    """S3: all-string CSV rows; fail when a required column is missing."""
    df = read_csv_fields(spark, path)
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"Input CSV must include columns {missing}")
    return df


def _one_object() -> Column:
    """Whether the line ``value`` is one JSON object and nothing else.

    The JSON parser stops after the first complete value, so a line with
    more behind it must be rejected by other means: as the one entry of an
    array the whole line has to parse, and to give exactly one object."""
    body = safe_strip("value")
    one = F.from_json(F.concat(F.lit("["), body, F.lit("]")), "array<map<string,string>>", {"mode": "PERMISSIVE"})
    return (body.startswith("{") & body.endswith("}") & F.coalesce(F.size(one) == 1, F.lit(False))
            & F.from_json("value", "map<string,string>").isNotNull())


def read_jsonl_tolerant(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines; blank, malformed and non-object lines are skipped."""
    objects = spark.read.text(path).where(F.trim("value") != "").where(_one_object())
    return objects.select(F.from_json("value", schema).alias("r")).where(F.col("r").isNotNull()).select("r.*")


def read_jsonl_strict(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines; blank lines skipped; a line that is not one object and nothing else fails the job."""
    lines = spark.read.text(path).where(safe_strip("value") != "")
    text = F.when(_one_object(), F.col("value")).otherwise(F.raise_error(F.lit("a line is not one JSON object")).cast("string"))
    return lines.select(F.from_json(text, schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def read_json_array(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """JSON documents that each hold a top-level array of objects; any
    other document, and a malformed one, fails the job. Read in splits
    (``titlelake.sources.split_json``); without a schema one is inferred from the objects."""
    objects = array_objects(spark, path)
    if schema is None:
        schema = object_schema(objects)
    return objects.select(F.from_json("json", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def object_schema(objects: DataFrame) -> T.StructType:
    """String columns for all keys of the ``json`` objects, in alphabetical order (one row of names reaches the driver)."""
    names = objects.select(F.explode(F.json_object_keys("json")).alias("k")).distinct().agg(F.sort_array(F.collect_list("k")).alias("ks"))
    return T.StructType([T.StructField(k, T.StringType()) for k in names.first()["ks"]])


def read_records(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Dispatch on suffix (.csv, .json, .jsonl)."""
    low = path.lower().rstrip("/")
    if low.endswith(".csv"):
        return read_csv_strings(spark, path, required=())
    if low.endswith(".jsonl"):
        return read_jsonl_strict(spark, path, schema) if schema else spark.read.option("mode", "FAILFAST").json(path)
    if low.endswith(".json"):
        return read_json_array(spark, path, schema)
    raise ValueError(f"no reader for {path!r}: the suffix must be .csv, .json or .jsonl")


def read_id_list(spark: SparkSession, path: str) -> DataFrame:
    """One id per line, stripped, blanks dropped, file order kept as
    ``pos`` = (file, split start, row order inside the split)."""
    df = spark.read.text(path).select(safe_strip("value").alias("id"),
                                      F.col("_metadata.file_path").alias("f"),
                                      F.col("_metadata.file_block_start").alias("b"),
                                      F.monotonically_increasing_id().alias("o"))
    return df.where(F.col("id") != "").select(F.struct("f", "b", "o").alias("pos"), "id")


def read_id_json_list(spark: SparkSession, path: str) -> DataFrame:
    """JSON arrays of ids -> (pos, id): non-blank, first occurrence kept, in the order of ``pos``. Malformed
    documents and others than arrays fail the job. Read in splits (``titlelake.sources.split_json``)."""
    ex = array_scalars(spark, path).select("pos", safe_strip("value").alias("id"))
    return ex.where(F.col("id") != "").groupBy("id").agg(F.min("pos").alias("pos")).select("pos", "id")


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Prediction records, nulls -> '', stripped."""
    from titlelake.schemas import PREDICTION
    df = read_jsonl_strict(spark, path, PREDICTION)
    return df.select(*[safe_strip(c).alias(c) for c in PREDICTION.fieldNames()])


def existing(spark: SparkSession, patterns: str | Sequence[str]) -> list[str]:
    """The paths or globs that match anything, in any file system Spark reaches."""
    found = []
    for p in [patterns] if isinstance(patterns, str) else patterns:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        hits = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).globStatus(path)
        if hits is not None and len(hits):
            found.append(p)
    return found


def read_run_metrics(spark: SparkSession, patterns: str | Sequence[str]) -> DataFrame:
    """Metrics JSON documents matched by one or several globs; globs and
    paths without a match are skipped, and no match at all gives no row. Run
    name = parent directory of each file."""
    paths = existing(spark, patterns)
    if not paths:
        return spark.createDataFrame([], "run string")
    df = spark.read.option("multiLine", True).option("allowNonNumericNumbers", True).json(paths)
    run = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1)
    return df.withColumn("run", run)


def resolve_column(df: DataFrame, *candidates: str) -> str | None:
    """First candidate present (case-insensitive), else None."""
    lower = {c.lower(): c for c in df.columns}
    for c in candidates:
        if c.lower() in lower:
            return lower[c.lower()]
    return None


def csv_to_parquet(spark: SparkSession, csv_path: str, parquet_path: str, schema: T.StructType,
                   encoding: str = "auto") -> DataFrame:
    """Convert a trending CSV to Parquet once (S1 + K7): later jobs then get
    column pruning, predicate pushdown and splittable files, which a
    multi-line CSV cannot offer. Returns the Parquet-backed DataFrame."""
    from titlelake.sources.sinks import replace_dataset
    replace_dataset(spark, read_trending_csv(spark, csv_path, schema, encoding), parquet_path)
    return spark.read.parquet(parquet_path)

r"""Quality rules with cross-document line frequency, in DataFrame functions only.

Base rules look at a text alone.  The method's own rule looks across documents:
lines are normalised (lower case, digits as 0, white space as one space) and
hashed; for each host the documents that hold a line are counted, copies of a text
once; lines above the limit are removed, and a document that loses more
than a share of its words is rejected.

Counts of a line are summed before they are shuffled, and the removal joins
light rows (hash and word count of a line), never texts.  Cases: a null or
empty text has no word and fails the base; a null host is a host of its own;
rows that repeat identifier and text get equal results; ties do not arise; an empty
table gives an empty result; texts of any length are taken whole.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from titlelake.llm.common import stored

# ASCII white space, as characters and as a class of patterns, and the symbols.
SPACE = " \t\n\x0b\x0c\r"
SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"


@dataclass
class Config:
    """A line is removed where more than ``most_documents`` documents of its host and more than ``most_share`` percent of them hold it."""

    least_words: int = 50
    most_repeated: int = 50
    most_documents: int = 20
    most_share: int = 2
    most_removed: int = 50


def words_of(text: Column) -> Column:
    own = F.trim(text, F.lit(SPACE))
    return F.when(own == "", F.array().cast("array<string>")).otherwise(F.split(own, SPACES))


def with_base(docs: DataFrame, cfg: Config) -> DataFrame:
    """The columns of ``docs`` (a ``text`` among them) and the base's columns."""
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x, F.lit(SPACE)) != "")
    out = docs.withColumn("ws", words_of(F.col("text"))).withColumn("ls", lines)
    out = out.withColumn("n_words", F.size("ws").cast("long")).withColumn("word_chars", F.length(F.array_join("ws", "")).cast("long"))
    out = out.withColumn("n_symbols", F.regexp_count("text", F.lit(SYMBOLS)).cast("long"))
    out = out.withColumn("n_dup_lines", (F.size("ls") - F.size(F.array_distinct("ls"))).cast("long"))
    # hashes of the three-word windows, by place
    window = F.transform("ws", lambda x, i: F.xxhash64(x, F.get("ws", i + 1), F.get("ws", i + 2)))
    out = out.withColumn("gs", F.slice(window, 1, F.greatest(F.size("ws") - 2, F.lit(0))))
    again = F.size(F.array_distinct("gs")) < F.size("gs")
    pairs = F.sort_array(F.transform("gs", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    out = out.withColumn("ps", F.when(again, pairs))
    # places of windows that stand beside an equal one in the order
    equal = F.zip_with(F.slice("ps", 1, F.size("ps") - 1), F.slice("ps", 2, F.size("ps") - 1), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
    places = F.sort_array(F.array_distinct(F.flatten(F.filter(equal, lambda x: x.isNotNull()))))
    start = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last"))
    covered = F.aggregate(places, start, lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i - a["last"])).alias("n"), i.alias("last")), lambda a: a["n"])
    out = out.withColumn("n_repeat_words", F.when(F.col("ps").isNull(), F.lit(0)).otherwise(covered).cast("long"))
    failed = (F.col("n_words") < cfg.least_words) | (100 * F.col("n_repeat_words") > cfg.most_repeated * F.col("n_words"))
    return out.withColumn("base_failed", failed).drop("ws", "ls", "gs", "ps")


def normalised_lines(text: Column) -> Column:
    """Lines with a word, normalised."""
    plain = F.lower(F.regexp_replace(F.regexp_replace(text, "[0-9]+", "0"), r"[ \t\x0B\f\r]+", " "))
    return F.filter(F.transform(F.split(plain, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def line_rows(docs: DataFrame, host: str) -> DataFrame:
    """``k1, k2, tk, host, ls``: hash and number of words of each line of each document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    ls = F.transform(normalised_lines(text), lambda x: F.struct(F.xxhash64(x).alias("h"), (F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + 1).alias("w")))
    return docs.select(F.xxhash64("doc_id", text).alias("k1"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("k2"), F.xxhash64(text).alias("tk"), F.col(host).alias("host"), ls.alias("ls"))


def frequent_lines(lines: DataFrame, cfg: Config) -> DataFrame:
    """``host, h, documents`` of the lines above the limits (the host null-safe, as a group)."""
    once = lines.groupBy("host", "tk").agg(F.first(F.array_distinct("ls.h")).alias("hs"))
    of_host = once.groupBy("host").agg(F.count(F.lit(1)).alias("all"))
    count = once.select("host", F.explode("hs").alias("h")).groupBy("host", "h").agg(F.count(F.lit(1)).alias("documents")).filter(F.col("documents") > cfg.most_documents)
    return count.join(of_host.withColumnRenamed("host", "of"), F.col("host").eqNullSafe(F.col("of"))).filter(
        F.col("documents") * 100 > F.col("all") * cfg.most_share).select("host", "h", "documents")


def removed_words(lines: DataFrame, frequent: DataFrame) -> DataFrame:
    """``k1, k2, n_removed_lines, n_removed_words`` of the documents that lose a line."""
    each = lines.select("k1", "k2", "host", F.explode("ls").alias("l")).select("k1", "k2", "host", "l.h", "l.w")
    # lines repeated within a document, and rows repeated in identifier and text, count once by row
    each = each.groupBy("k1", "k2", "host", "h").agg(F.sum("w").alias("w"), F.count(F.lit(1)).alias("c"))
    few = frequent.select(F.col("host").alias("in_host"), F.col("h").alias("line"))
    return each.join(few, (F.col("h") == F.col("line")) & F.col("host").eqNullSafe(F.col("in_host")), "left_semi").groupBy("k1", "k2").agg(
        F.sum("c").alias("n_removed_lines"), F.sum("w").alias("n_removed_words"))


def line_quality(docs: DataFrame, host: str = "source", cfg: Config = Config()) -> DataFrame:
    """``doc_id``, the base's columns, ``n_removed_words`` and ``kept`` of every document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select("doc_id", F.xxhash64("doc_id", text).alias("k1"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("k2"), text.alias("text"))
    base = with_base(keyed, cfg).drop("text")
    lines = stored(line_rows(docs, host), "lines")
    gone = removed_words(lines, frequent_lines(lines, cfg))
    rows = lines.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    out = base.join(gone, ["k1", "k2"], "left").join(rows, ["k1", "k2"], "left")
    removed = F.coalesce((F.col("n_removed_words") / F.coalesce("rows", F.lit(1))).cast("long"), F.lit(0).cast("long"))
    out = out.withColumn("n_removed_words", removed)
    kept = ~F.col("base_failed") & (100 * F.col("n_removed_words") <= cfg.most_removed * F.col("n_words"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_removed_words", kept.alias("kept"))

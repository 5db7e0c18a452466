"""SFT data preparation and formatting.

``prepare`` builds the examples (id inference P13, source selection P14,
quality gate F11, keep-first by id W3) and the seeded train/test split
(W7). The split puts the k smallest of ``sha1(seed:id)`` of each stratum in
the test set. No stratum is sorted: a histogram over (stratum, hash prefix)
finds the bucket where the k-th hash lies, only that bucket's hashes are
ranked, and the hash found becomes a cut that each row is compared with.
k = clamp(round_half_even(n * p), 1, n - 1), and a stratum of one row goes
to test.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from titlelake.functions import records as rc
from titlelake.functions.text import clean_prediction, safe_strip
from titlelake.operators.filters import guard_min_rows, sft_quality_keep
from titlelake.operators.joins import ordered_lookup

BUCKET_HEX = 4  # 65,536 hash-prefix buckets per stratum


@dataclass(frozen=True)
class SplitConfig:
    test_size: float = 0.1
    seed: int = 42
    stratify_source: bool = False


def _usable(records: DataFrame, row_index: str) -> DataFrame:
    """All rows that pass the quality gate: id, source, source_text, title, row_index."""
    cols = set(records.columns)
    col_or_null = lambda c: F.col(c) if c in cols else F.lit(None).cast("string")
    src = rc.select_source(col_or_null("full_transcript"), col_or_null("transcript"), col_or_null("description"))
    ex = records.select(rc.infer_id(col_or_null("video_id"), col_or_null("url"), F.col(row_index)).alias("id"),
                        src["source"].alias("source"), src["source_text"].alias("source_text"),
                        safe_strip(col_or_null("title")).alias("title"), F.col(row_index).alias("row_index"))
    return ex.where(sft_quality_keep("source", "source_text", "title") & F.col("id").isNotNull())


def _firsts(usable: DataFrame) -> DataFrame:
    """W3 on narrow rows: id, source and row_index of each id's first row.

    One number holds the position and which of the two sources (P14) the row has, so every
    reader of the firsts shares one hash aggregate and its exchange; no text is shuffled or held in a buffer."""
    code = F.min(F.col("row_index").cast("bigint") * 2 + (F.col("source") == "description").cast("int")).alias("__first")
    # the filter keeps the aggregate in every reader's plan, also where only the id is read
    first = usable.groupBy("id").agg(code).where(F.col("__first").isNotNull())
    return first.select("id", F.when(F.col("__first") % 2 == 0, "transcript").otherwise("description").alias("source"),
                        F.floor(F.col("__first") / 2).alias("row_index"))


def _with_texts(narrow: DataFrame, usable: DataFrame) -> DataFrame:
    """Narrow rows with their texts, which are joined once. ``row_index`` numbers the records."""
    own = narrow.withColumnsRenamed({"id": "__id", "row_index": "__row"}).drop("source")
    return usable.join(own, (F.col("id") == F.col("__id")) & (F.col("row_index") == F.col("__row"))).drop("__id", "__row")


def examples(records: DataFrame, row_index: str = "row_index") -> DataFrame:
    """Quality-gated examples (id, source, source_text, title, row_index),
    first row per id kept."""
    usable = _usable(records, row_index)
    return _with_texts(_firsts(usable), usable)


def split(ex: DataFrame, cfg: SplitConfig = SplitConfig()) -> DataFrame:
    """Examples + ``is_test`` and the O2 order keys ``order_key``."""
    if not 0.0 < cfg.test_size < 1.0:
        raise ValueError("test_size must be in (0, 1)")
    # keys that are never null: no reader's plan gets a filter of its own, so all share what is below
    keyed = ex.withColumns({"__st": F.coalesce(F.col("source"), F.lit("")) if cfg.stratify_source else F.lit(""),
                            "__h": F.coalesce(rc.hash_key(cfg.seed, F.col("id")), F.lit(""))})
    ids = keyed.select("__st", "__h", F.coalesce(F.substring("__h", 1, BUCKET_HEX), F.lit("")).alias("__b"))  # no text travels
    hist = ids.groupBy("__st", "__b").agg(F.count(F.lit(1)).alias("__c"))
    by_bucket = Window.partitionBy("__st").orderBy("__b")
    n = F.sum("__c").over(Window.partitionBy("__st"))
    k_raw = F.bround(n * F.lit(cfg.test_size), 0).cast("bigint")
    k = F.when(n <= 1, F.lit(1)).otherwise(F.least(F.greatest(k_raw, F.lit(1)), n - 1))
    need = k - (F.sum("__c").over(by_bucket) - F.col("__c"))  # test rows wanted from this bucket on
    hist = hist.withColumn("__need", need)
    edge = hist.where((F.col("__need") > 0) & (F.col("__need") <= F.col("__c")))
    nth = F.row_number().over(Window.partitionBy("__st", "__b").orderBy("__h"))
    cut = (ids.join(edge.select("__st", "__b", "__need"), ["__st", "__b"]).withColumn("__nth", nth)
           .where(F.col("__nth") == F.col("__need")).select("__st", F.col("__h").alias("__cut")))
    # One row per stratum: the sources are two fixed labels (P14), or there is one stratum.
    out = keyed.join(F.broadcast(cut), "__st")
    is_test = F.col("__h") <= F.col("__cut")
    order_key = F.when(is_test, rc.hash_key(cfg.seed, F.col("id"), "test")).otherwise(
        rc.hash_key(cfg.seed, F.col("id"), "train"))
    return out.select(*ex.columns, is_test.alias("is_test"), order_key.alias("order_key"))


def prepare(records: DataFrame, cfg: SplitConfig = SplitConfig(), row_index: str = "row_index",
            min_examples: int | None = 20):
    """(data, train_ids, test_ids), all lazy. ``data`` carries ``is_test`` and
    ``order_key``, by which a writer sorts (train then test, each in sha1 order:
    U3, O2); id lists carry their order key as ``pos``. Fewer than
    ``min_examples`` usable examples fail the job that reads the result (F15)."""
    usable = _usable(records, row_index)
    first = _firsts(usable)
    if min_examples:
        first = guard_min_rows(first, min_examples)
    s = split(first, cfg)
    data = _with_texts(s, usable).select("id", "source", "source_text", "title", "is_test", "order_key")
    train_ids = s.where(~F.col("is_test")).select(F.col("order_key").alias("pos"), "id")
    test_ids = s.where(F.col("is_test")).select(F.col("order_key").alias("pos"), "id")
    return data, train_ids, test_ids


def training_text(data: DataFrame, ids: DataFrame, system_prompt: str = rc.SYSTEM_PROMPT_TRAIN) -> DataFrame:
    """L10 (training): rows for the ordered id list (J6), rendered as
    ``ROLE:\\ncontent\\n`` chat text (P15-P17)."""
    rows = ordered_lookup(ids, data.select("id", "source", "source_text", "title"))
    src = F.lower(safe_strip("source"))
    msgs = rc.to_messages(src, F.coalesce(F.col("source_text"), F.lit("")), F.coalesce(F.col("title"), F.lit("")),
                          system_prompt)
    return rows.select("pos", "id", rc.messages_to_text(msgs).alias("text"))


def inference_prompts(data: DataFrame, ids: DataFrame, system_prompt: str = rc.SYSTEM_PROMPT_INFER) -> DataFrame:
    """L10 (inference): prompt without the assistant turn (P18) and the
    stripped reference (P19)."""
    rows = ordered_lookup(ids, data.select("id", "source", "source_text", "title"))
    src = F.lower(safe_strip("source"))
    msgs = rc.to_messages(src, F.coalesce(F.col("source_text"), F.lit("")), F.col("title"), system_prompt,
                          drop_blank_assistant=True)
    return rows.select("pos", "id", src.alias("source"), rc.generation_prompt(msgs).alias("prompt"),
                       rc.extract_reference(msgs).alias("reference"))


def chat_rows(data: DataFrame, system_prompt: str = rc.SYSTEM_PROMPT_TRAIN) -> DataFrame:
    """Legacy chat-row form: (id, source, messages)."""
    msgs = rc.to_messages("source", "source_text", "title", system_prompt)
    return data.select("id", "source", msgs.alias("messages"))


def collect_predictions(raw: DataFrame, data: DataFrame) -> DataFrame:
    """Cleaned predictions (P20) joined to their examples:
    (id, source, reference, prediction)."""
    p = raw.select(F.col("id"), clean_prediction("raw_output").alias("prediction"))
    d = data.select("id", F.lower(safe_strip("source")).alias("source"), safe_strip("title").alias("reference"))
    return d.join(p, "id")

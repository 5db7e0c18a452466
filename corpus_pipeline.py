"""A training-text pipeline over ``documents``: toxicity, near duplicates, repeated passages, personal data, packing.

Each stage reads what the one before it kept, as Parquet.  All stages but the last
return the columns of ``documents``; the last returns the packed pieces.  Near duplicates take
five-word shingles at a resemblance of 0.8, repeated passages ``PASSAGE_WORDS`` words or strings of 400 bytes
(texts without white space have few words).
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from titlelake.llm.common import stored
from titlelake.llm.minhash_oph import drop_near_duplicates
from titlelake.llm.packing_pow2 import digests, pack
from titlelake.llm.pii_surrogates import replace_entities
from titlelake.llm.suffix_dedup import without_repeats
from titlelake.llm.toxicity_fm import drop_toxic


#: Words of the shortest passage that may stand once only.
PASSAGE_WORDS = 51


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents not predicted toxic; the labels teach, and only those outside the held-out fifth."""
    source = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), learn_from=source)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return drop_near_duplicates(docs)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of over 50 words that stand anywhere else."""
    return without_repeats(docs, words=PASSAGE_WORDS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with surrogates for personal data."""
    return replace_entities(docs).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of power-of-two lengths, as digests."""
    return digests(pack(docs, public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("passage_dedup", passage_dedup), ("personal_data", personal_data), ("packing", packing)]
#: Hash models, components and token ids are beyond SQL: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

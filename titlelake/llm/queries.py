"""The registered queries of this subpackage, one for each operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from titlelake.llm import bottomk, bpe_speculate, collocations_dic, line_rules, minhash_oph, packing_pow2, pii_surrogates, records, secret_scan, simhash_blocks, suffix_dedup, toxicity_fm, whitening_polar
from titlelake.llm.queries_sql import OP2_SQL, OP7_SQL, OP12_SQL

TOKENIZER = "byte_bpe_50k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_fm.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_oph.near_duplicates(_table(spark, sf_dir, "documents"), minhash_oph.Config(words=4))


def op3_packing_pow2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing_pow2.digests(packing_pow2.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER)))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``n_passages`` and ``text`` also tell passages of over 50 words, most of which are shorter than the contract's 400 bytes."""
    return suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"), words=51).drop("spans")


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bottomk.compare_neighbours(_table(spark, sf_dir, "documents"))


def op6_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.encode_and_read_back(_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op7_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.line_quality(_table(spark, sf_dir, "documents"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_documents(_table(spark, sf_dir, "documents"))


def op9_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_surrogates.replace_entities(_table(spark, sf_dir, "documents"))


def op10_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_speculate.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op11_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_blocks.simhash_duplicates(_table(spark, sf_dir, "documents")).drop("fp")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations_dic.collocations(_table(spark, sf_dir, "documents"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = whitening_polar.whiten(_table(spark, sf_dir, "embeddings"))
    return out.withColumn("deviation", F.col("deviation").try_cast("long"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_toxicity_fm, op2_minhash_near_dedup, op3_packing_pow2, op4_suffix_dedup, op5_fingerprints, op6_token_records, op7_line_quality, op8_secret_scan, op9_pii_surrogates, op10_bpe_round_trip, op11_simhash_near_dedup, op12_collocations, op13_embedding_whitening)
}
ORACLES: dict[str, str] = {"op2_minhash_near_dedup": OP2_SQL, "op7_line_quality": OP7_SQL, "op12_collocations": OP12_SQL}

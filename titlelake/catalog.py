"""Registered queries: one per SURVEY §2 operator family, each a
``(spark, sf_dir) -> DataFrame`` over the driver tables, with the DuckDB
oracle SQL that computes the same rows.

Doubles are rounded to 6 places on both sides, dates and timestamps are
rendered as text, and every computed column carries the same alias in both
engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


def load_all() -> None:
    """Import the modules that register queries."""
    from titlelake.queries import (  # noqa: F401
        q_curate, q_clean, q_profile, q_functions, q_transcripts, q_sft, q_metrics, q_full, q_misc, q_io,
    )

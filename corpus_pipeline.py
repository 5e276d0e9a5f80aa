"""A corpus pipeline of five stages: toxicity, exact dedup, SimHash near-dedup with an exact check, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. Its result is written as Parquet and
read again as the next one's ``docs``. All but the last return the columns of ``docs``; the last one returns a row per
packed piece. Rows with null ids and repeated rows pass through as their operators define it.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm import decontam, exactdedup, neardup, packing, toxicity
from tidewright.llm.common import ROWS, materialize, release
from tidewright.llm.queries import TOXIC_AT, learned, table

_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def _small_batches(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """``stage`` with no more than ``ROWS`` rows sent to a Python worker at a time, as operators work on no more; the
    session's larger default would hold whole batches of texts in each worker and, once more, in its executor."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if not 0 < int(spark.conf.get(_BATCH)) <= ROWS:
            spark.conf.set(_BATCH, str(ROWS))  # stays, since the stage's result is computed later
        return stage(spark, docs, sf_dir)

    return run


@_small_batches
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine scores below the limit."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), learned(5, 0))
    release()  # what the fit took on the driver; it would stay beside all later stages
    return toxicity.score(docs, model, out="__toxicity").filter(F.col("__toxicity") < TOXIC_AT).select(*docs.columns)


@_small_batches
def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts."""
    return exactdedup.deduplicate(docs)


@_small_batches
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts with similar five-word shingles, by SimHash and an exact join beyond its radius;
    the one with the smallest id."""
    return neardup.deduplicate(docs)


@_small_batches
def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark").select("item_id", "text")).select(*docs.columns)


@_small_batches
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of packed sequences."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_leaks),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL has neither the factorization machine nor the tokenizer; tests hold ``run`` against a brute-force version.
ORACLE_SQL = None

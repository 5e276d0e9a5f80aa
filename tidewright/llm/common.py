"""Helpers that the text operators share: shared storage, folds, text pieces."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch, ship

__all__ = ["fold", "groups_by_size", "keep_rows", "lean", "lean_batches", "materialize", "pieces", "sampled", "ship", "small"]

#: Rows of a frame that an operator works on at a time.
ROWS = 1_024
_SPACE = re.compile(r"\s")

#: What `[\x20\x09-\x0D]` means in every contract: ASCII white space.
ASCII_SPACE = " \t-\r"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back, which cuts its lineage."""
    spark = df.sparkSession
    path = scratch(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fold(doc_id: str | Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; null for a null id."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(c.cast("string")), F.lit(parts))


def sampled(df: DataFrame, key: str, bound: int) -> DataFrame:
    """At most ``bound`` rows, chosen by a hash of ``key`` alike at every size; all rows if there are no more."""
    total = df.count()
    if total <= bound:
        return df
    keep = max(1, int(bound / total * 0.97 * 1_000_000))
    rank = F.pmod(F.xxhash64(F.col(key), F.lit("sample")), F.lit(1_000_000))
    return df.filter(rank < keep).orderBy(rank, *[c for c, t in df.dtypes if "map" not in t]).limit(bound)


def pieces(text: str, size: int = 1 << 20):
    """Cut a long text at white space into pieces of about ``size`` characters; nothing is lost but the cuts' space."""
    at, n = 0, len(text)
    while n - at > size:
        found = _SPACE.search(text, at + size)
        if not found:
            break
        yield text[at : found.start()]
        at = found.end()
    yield text[at:]


def groups_by_size(texts: list, most: int = 4 << 20):
    """Index ranges of ``texts`` that hold about ``most`` characters each (a longer text stands alone)."""
    begin, held = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if held and held + n > most:
            yield begin, i
            begin, held = i, 0
        held += n
    if begin < len(texts):
        yield begin, len(texts)


def release() -> None:
    """Give a worker's unused memory back to the system; workers are kept for later tasks, which may need it elsewhere."""
    gc.collect()
    with contextlib.suppress(Exception):
        pa.default_memory_pool().release_unused()
        ctypes.CDLL(None).malloc_trim(0)


def lean_batches(batches: Iterator) -> Iterator:
    """The batches, with memory given back after the last."""
    try:
        yield from batches
    finally:
        release()


def lean(function: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """``function`` on frames of at most ``ROWS`` rows, with the memory that it has used given back at the end."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        try:
            yield from function(b.iloc[a : a + ROWS] for b in batches for a in range(0, len(b), ROWS))
        finally:
            release()

    return run


def small(df: DataFrame, most: int) -> DataFrame:
    """``df`` with a broadcast hint if it has no more than ``most`` rows."""
    return F.broadcast(df) if df.count() <= most else df


def keep_rows(docs: DataFrame, decided: DataFrame, text: str, key: str, most: int = 400_000) -> DataFrame:
    """The rows of ``docs`` that ``decided`` (doc_id, h = xxhash64 of the text, kept; a row per row) keeps.

    Rows that share id and text are told apart by nothing; if one of them is kept, one row stays. What goes is matched by
    a broadcast of at most ``most`` pairs of longs, and by a shuffle beyond that.
    """
    per = materialize(decided.groupBy("doc_id", "h").agg(F.max("kept").alias("kept"), F.count("*").alias("n")).filter("not kept or n > 1"), "keep-rows")
    rows = docs.withColumns({"__id": F.col(key).cast("long"), "__h": F.xxhash64(F.col(text))})
    pairs = per.select(F.col("doc_id").alias("__of"), F.col("h").alias("__text"), "kept")
    same = F.col("__id").eqNullSafe(F.col("__of")) & (F.col("__h") == F.col("__text"))
    gone, twice = pairs.filter("not kept").drop("kept"), pairs.filter("kept").drop("kept")
    left = rows.join(small(gone, most), same, "left_anti")
    if twice.take(1):
        twice = small(twice, most)
        left = left.join(twice, same, "left_anti").union(left.join(twice, same, "left_semi").dropDuplicates(["__id", "__h"]))
    return left.select(*[F.col(f"`{c}`") for c in docs.columns])

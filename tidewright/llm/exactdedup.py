"""Exact deduplication by counting quotient filters.

Each partition builds a counting quotient filter of its texts' 64-bit fingerprints: a fingerprint's high bits are its
quotient, which names a block; in a block the remainders are kept sorted with a count each. Filters of all partitions
merge block by block, by merging sorted remainders and adding counts, so nothing is lost. Fingerprints whose count is
above one route their texts to byte verification: those texts, and no others, are grouped by their bytes.

Texts are equal when identical after each run of ASCII white space has become one space; null counts as empty.

Defined results: every row comes out once. Of equal texts the row with the smallest id stays; null ids come last, and of
rows that repeat one id with equal texts exactly one stays. A group whose ids are all null has a null ``keep_id``. An
empty table gives an empty result. Other columns of the input play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep_rows, lean, materialize, ship, small

#: Bits of a fingerprint.
BITS = 64
#: About so many fingerprints a block holds after the merge.
BLOCK = 20_000
#: Most fingerprints of repeated texts that are broadcast (8 bytes each); more are joined by a shuffle.
BROADCAST = 500_000
#: Most groups (about 120 bytes each) that are broadcast.
BROADCAST_GROUPS = 100_000
_SPACE = b" \t\n\r\x0b\x0c"


def normalise(text: str | None) -> bytes:
    """UTF-8 bytes with each run of ASCII white space as one space."""
    if not text:
        return b""
    data = text.encode("utf-8", "surrogatepass")
    out = b" ".join(data.split())
    if not out:
        return b" "
    return (b" " if data[0] in _SPACE else b"") + out + (b" " if data[-1] in _SPACE else b"")


def fingerprint(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "big", signed=True)


class CountingQuotientFilter:
    """Sorted remainders with counts, by quotient; the arrays of a block follow each other."""

    def __init__(self, quotient_bits: int):
        self.q = quotient_bits
        self.r = BITS - quotient_bits
        self.blocks: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def insert(self, fingerprints: np.ndarray) -> None:
        values, counts = np.unique(fingerprints.view(np.uint64), return_counts=True)
        quotient = (values >> np.uint64(self.r)) if self.q else np.zeros(len(values), np.uint64)
        remainder = values & np.uint64((1 << self.r) - 1)
        cuts = np.flatnonzero(np.r_[True, quotient[1:] != quotient[:-1]]) if len(values) else []
        for a, b in zip(cuts, [*cuts[1:], len(values)]):
            self.merge(int(quotient[a]), remainder[a:b], counts[a:b])

    def merge(self, block: int, remainders: np.ndarray, counts: np.ndarray) -> None:
        """Merge sorted remainders into a block; counts of equal ones add up."""
        if block in self.blocks:
            have, n = self.blocks[block]
            remainders, counts = np.r_[have, remainders], np.r_[n, counts]
            o = np.argsort(remainders, kind="stable")
            remainders, counts = remainders[o], counts[o]
            first = np.flatnonzero(np.r_[True, remainders[1:] != remainders[:-1]])
            remainders, counts = remainders[first], np.add.reduceat(counts, first)
        self.blocks[block] = (remainders, counts)

    def repeated(self, block: int) -> np.ndarray:
        remainders, counts = self.blocks[block]
        return remainders[counts > 1]


def _quotient_bits(rows: int) -> int:
    return max(0, int(np.ceil(np.log2(max(1, rows / BLOCK)))))


def repeated_fingerprints(rows: DataFrame, n: int) -> DataFrame:
    """Fingerprints (column ``fp``) that ``rows`` holds more than once, through merged counting quotient filters."""
    q = _quotient_bits(n)

    @lean
    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = CountingQuotientFilter(q)
        for b in batches:
            own.insert(b["fp"].to_numpy(np.int64))
        for block, (remainders, counts) in own.blocks.items():
            yield pd.DataFrame({"block": [block], "remainders": [remainders.astype("<u8").tobytes()], "counts": [counts.astype("<u4").tobytes()]})

    @lean
    def merged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # rows come sorted by block, so that one block at a time is in memory
        own, at = CountingQuotientFilter(q), None

        def out():
            found = own.repeated(at)
            own.blocks.clear()
            return pd.DataFrame({"fp": ((np.uint64(at) << np.uint64(own.r)) | found if own.q else found).view(np.int64)})

        for b in batches:
            for block, remainders, counts in zip(b["block"], b["remainders"], b["counts"]):
                if at is not None and block != at:
                    yield out()
                at = block
                own.merge(int(block), np.frombuffer(remainders, "<u8"), np.frombuffer(counts, "<u4").astype(np.int64))
        if at is not None:
            yield out()

    filters = rows.select("fp").mapInPandas(build, "block long, remainders binary, counts binary")
    return filters.repartition("block").sortWithinPartitions("block").mapInPandas(merged, "fp long")


def digests(docs: DataFrame, text: str, key: str) -> DataFrame:
    """Per row: doc_id (the key as a long), h (xxhash64 of the text as it is), text_sha256, fp."""

    @lean
    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            data = [normalise(t) for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "h": b["h"], "text_sha256": [hashlib.sha256(x).hexdigest() for x in data], "fp": [fingerprint(x) for x in data]})

    own = docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("h"), F.col(text).alias("text"))
    return own.mapInPandas(digest, "doc_id long, h long, text_sha256 string, fp long")


def exact_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    return _decided(docs, text, key).drop("h")


def deduplicate(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that stay, with all columns."""
    return keep_rows(docs, materialize(_decided(docs, text, key).select("doc_id", "h", "kept"), "exact-decided"), text, key)


def _decided(docs: DataFrame, text: str, key: str) -> DataFrame:
    ship(docs.sparkSession)
    rows = materialize(digests(docs, text, key).withColumn("row", F.monotonically_increasing_id()), "exact-digests")
    repeated = materialize(repeated_fingerprints(rows, rows.count()), "exact-repeated")
    repeated = small(repeated, BROADCAST)

    @lean
    def routed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            data = [normalise(t) for t in b["text"]]
            yield pd.DataFrame({"fp": [fingerprint(x) for x in data], "data": data})

    texts = docs.select(F.col(text).alias("text")).mapInPandas(routed, "fp long, data binary").join(repeated, "fp", "left_semi")
    # grouping by the bytes themselves; map-side sums keep a large group of copies from meeting in one task
    verified = texts.groupBy("data").agg(F.count("*").alias("n")).filter("n > 1").select(F.sha2("data", 256).alias("text_sha256"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("row")))
    groups = (
        rows.join(repeated, "fp", "left_semi").groupBy("text_sha256").agg(first.alias("first"), F.count("*").alias("group_size"))
        .join(verified, "text_sha256", "left_semi")
    )
    groups = materialize(groups.select("text_sha256", "group_size", F.col("first.doc_id").alias("keep"), F.col("first.row").alias("keep_row")), "exact-groups")
    # read back as a table, so that a large group's rows can be split over tasks where the join is one by shuffle
    joined = rows.join(small(groups, BROADCAST_GROUPS), "text_sha256", "left")
    alone = F.col("group_size").isNull()
    return joined.select(
        "doc_id",
        "h",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("row") == F.col("keep_row"))).alias("kept"),
        "text_sha256",
    )

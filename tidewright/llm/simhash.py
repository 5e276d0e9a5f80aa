"""Near-duplicate detection by SimHash with deletion-variant signatures.

A text's fingerprint has a bit set where more than half of its word shingles' hashes have it. Fingerprints link at
``RADIUS`` = 2 or fewer differing bits. Each is cut into two segments, fewer than one more than the radius would give:
two linked fingerprints then have a segment that differs in one bit at most. Every segment is indexed under its 32
one-wildcard variants (the position of the wildcard, and the segment without that bit), the variants are joined by
equality, and pairs are verified on all bits.

A bucket of two fingerprints is joined by its smallest and largest member, which one sum on the map side gives. Buckets of
up to ``BUCKET`` are listed and verified pair by pair. Members of larger buckets are linked without listing pairs: two
fingerprints are within two bits exactly if some value is within one bit of both, so each is joined to the values within
one bit of it, and those that share a value are linked to the smallest of them. No link is lost, and no bucket makes a
quadratic number of rows. Identical fingerprints are one node throughout.

Defined results: texts that are null, empty or only white space have fingerprint zero and are linked like any other;
shorter texts than a shingle count as one shingle. Null ids are kept; a group's id is the smallest id in it that is not
null, or null if there is none. Repeated rows come out once each. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep_rows, lean, materialize, ship, small
from .components import connected_components

WIDTH = 32
RADIUS = 2
BUCKET = 64
#: Most buckets of more than two members (two longs each) that are broadcast; more are joined by a shuffle.
BROADCAST = 400_000
#: Distinct fingerprints (with 64 variants each) that one task indexes, about.
NODES_PER_TASK = 16_384
#: Shingles whose hashes are in memory at a time.
CHUNK = 1 << 18


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """The 64-bit fingerprint of one text, unsigned."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    data = b" ".join(words)
    k = min(shingle, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.r_[0, ends[:-1] + 1][: len(words) - k + 1].tolist()
    ends = ends[k - 1 :].tolist()
    n = len(begins)
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for c in range(0, n, CHUNK):
        h = np.array([digest(data[a:b], seed) for a, b in zip(begins[c : c + CHUNK], ends[c : c + CHUNK])], np.uint64)
        ones += _ones(h)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def majority(h: np.ndarray) -> int:
    """The fingerprint, unsigned, of one text's shingle hashes."""
    ones = sum(_ones(h[c : c + CHUNK]) for c in range(0, len(h), CHUNK))
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def _ones(h: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit."""
    bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    out = np.zeros(64, np.int64)
    for a in range(0, len(bits), 255):  # sums of bytes, no wider than a byte
        out += np.add.reduce(bits[a : a + 255], axis=0, dtype=np.uint8)
    return out


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = 3, seed: int = 42) -> DataFrame:
    """Per row: doc_id, h (xxhash64 of the text), fp (the fingerprint's 64 bits as a signed long)."""
    ship(docs.sparkSession)

    @lean
    def compute(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fp = np.array([fingerprint(t, shingle, seed) for t in b["text"]], np.uint64)
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "h": b["h"], "fp": fp.view(np.int64)})

    own = docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("h"), F.col(text).alias("text"))
    return own.mapInPandas(compute, "doc_id long, h long, fp long")


def _segment(fp, which: int):
    return F.shiftrightunsigned(fp, which * WIDTH).bitwiseAND(F.lit((1 << WIDTH) - 1))


def _variants(nodes: DataFrame) -> DataFrame:
    """Rows (bucket, fp): every one-wildcard variant of both segments.

    A bucket's number holds the segment without its wildcard bit, the wildcard's position and the segment's place.
    """
    both = []
    for which in range(2):
        s = _segment(F.col("fp"), which)
        both += [s.bitwiseAND(F.lit(((1 << WIDTH) - 1) ^ (1 << i))) * 64 + (which * WIDTH + i) for i in range(WIDTH)]
    return nodes.select(F.explode(F.array(*both)).alias("bucket"), "fp")


def _near(a: str, b: str):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= RADIUS


def links(nodes: DataFrame) -> DataFrame:
    """Links (u, v) between the distinct fingerprints ``nodes.fp`` that have the same components as all pairs in reach."""
    nodes = nodes.repartition(max(1, -(-nodes.count() // NODES_PER_TASK)))  # small rows, so that their variants fit in memory
    sizes = materialize(_variants(nodes).groupBy("bucket").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).filter("n > 1"), "simhash-buckets")
    two = sizes.filter("n = 2").filter(_near("a", "b")).select(F.col("a").alias("u"), F.col("b").alias("v"))
    more = small(sizes.filter("n > 2").select("bucket", "n"), BROADCAST)
    members = materialize(_variants(nodes).join(more, "bucket"), "simhash-members")
    lists = members.filter(F.col("n") <= BUCKET).groupBy("bucket").agg(F.sort_array(F.collect_list("fp")).alias("fps"))
    pairs = (
        lists.select("fps", F.posexplode("fps").alias("i", "u"))
        .select("u", F.explode(F.filter(F.expr("slice(fps, i + 2, size(fps))"), lambda x: F.bit_count(F.col("u").bitwiseXOR(x)) <= RADIUS)).alias("v"))
    )
    hot = members.filter(F.col("n") > BUCKET).select("fp").distinct()
    around = hot.select("fp", F.explode(F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.shiftleft(F.lit(1).cast("long"), i)) for i in range(64)])).alias("value"))
    least = around.groupBy("value").agg(F.min("fp").alias("v"), F.count("*").alias("n")).filter("n > 1").select("value", "v")
    stars = around.join(least, "value").filter("fp <> v").select(F.col("fp").alias("u"), "v")
    return two.union(pairs).union(stars).distinct()


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = 3, seed: int = 42) -> DataFrame:
    """One row per row of ``docs``: doc_id, fp, component_id (the smallest id reachable through links)."""
    rows = materialize(fingerprints(docs, text, key, shingle, seed), "simhash-fingerprints")
    return grouped(rows)


def grouped(rows: DataFrame, linked: DataFrame | None = None) -> DataFrame:
    """``near_duplicates`` from rows of doc_id and fp; other columns stay, and ``root`` names the component.

    ``linked`` gives other links (u, v) of the values of ``fp`` than ``links``."""
    nodes = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    roots = connected_components(links(nodes.select("fp")) if linked is None else linked).withColumnRenamed("node", "fp")
    labelled = nodes.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = labelled.join(smallest, "root").select("fp", "root", "component_id")
    return rows.join(classes, "fp")


def deduplicate(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = 3, seed: int = 42) -> DataFrame:
    """``docs`` with one row of each component, that of the smallest id (null ids last)."""
    return first_of_groups(docs, near_duplicates(docs, text, key, shingle, seed), text, key)


def first_of_groups(docs: DataFrame, rows: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` with one row of each root of ``rows`` (doc_id, h, root for each row of ``docs``)."""
    rows = materialize(rows, "simhash-components")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")
    first = rows.groupBy("root").agg(F.min(rank).alias("first"), F.count("*").alias("n")).filter("n > 1").select("root", "first")
    decided = rows.join(first, "root", "left").select("doc_id", "h", (F.col("first").isNull() | (rank == F.col("first"))).alias("kept"))
    return keep_rows(docs, materialize(decided, "simhash-decided"), text, key)

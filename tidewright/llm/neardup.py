"""Near-duplicate texts by SimHash with deletion-variant signatures, and all further similar texts by an exact join.

Texts link when the Jaccard similarity of their sets of five-word shingles is 0.8 or more. SimHash fingerprints of these
shingles within ``simhash.RADIUS`` bits are found by ``simhash.links`` and checked first, on the texts' whole sets of 64-bit
shingle hashes. At a similarity of 0.8, 64-bit fingerprints differ in about 10 bits, and to find all such pairs by segments
would compare nearly all texts; so what lies beyond the radius comes from prefixes: put all shingles in one order, and two
sets of enough similarity share ``OVERLAP`` shingles or more among the first ``n - ceil(0.8 n) + OVERLAP`` of each (all, if
they are fewer), and the more the closer their sizes are. No link is lost, whatever the order; shingles that are frequent
in a sample come last, which only keeps the groups small. Pairs are checked only while nothing connects their texts yet.

Shared shingles are counted in groups of two texts, one map-side sum, and in those of up to ``BUCKET``, which are listed.
Members of larger ones are mostly copies with edits of one text, so they are told apart by what sets each apart from the
shingles that most of them hold: texts with few such differences are linked to the one with the fewest, and a pair beyond
that is listed only if it has enough of its differences in common and nothing connects it yet. What is far from its centre
is gathered around centres of its own in the next round. No pair is lost by this either.

Defined results: texts without words are all alike; texts of fewer words than a shingle have one shingle of them all.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import lean, materialize, ship, small
from .components import connected_components

SHINGLE = 5
THRESHOLD = 0.8
BUCKET = 64
#: Shingles that prefixes are longer by than one common shingle needs, so that similar sets share that many; one at least.
OVERLAP = 4
#: Rounds of families at most, before what is left is listed.
ROUNDS = 8
#: Most rows of longs that are broadcast.
BROADCAST = 400_000
#: Sampled texts and frequent shingles that the order of shingles is taken from; results do not depend on them.
SAMPLE, FREQUENT = 20_000, 100_000
_PARTS = 1 << 40
_EPSILON = 1e-9
_SCHEMA = "doc_id long, h long, fp long, sim long, n long, prefix array<long>"


def shingle_set(text: str | None, shingle: int = SHINGLE, sim: bool = False) -> tuple[int, np.ndarray, int]:
    """The 64-bit hash of the text's words, the sorted distinct hashes of its shingles, and with ``sim`` their SimHash
    (that of ``simhash.fingerprint`` with seed 0), else 0."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    data = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    k = min(shingle, len(words))
    if not k:
        return digest(data, 1), np.array([digest(b"")], np.uint64).view(np.int64), 0
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.r_[0, ends[:-1] + 1][: len(words) - k + 1]
    found = np.fromiter((digest(data[a:b]) for a, b in zip(begins.tolist(), ends[k - 1 :].tolist())), np.uint64, len(begins))
    return digest(data, 1), np.unique(found.view(np.int64)), simhash.majority(found) if sim else 0


def prefix(hashes: np.ndarray, frequent: tuple[np.ndarray, np.ndarray], threshold: float = THRESHOLD) -> np.ndarray:
    """The first shingles in the common order: by frequency in the sample, then by hash."""
    n = len(hashes)
    seen, counts = frequent
    often = np.zeros(n, np.int64)
    if len(seen):
        at = np.searchsorted(seen, hashes).clip(0, len(seen) - 1)
        often = np.where(seen[at] == hashes, counts[at], 0)
    return hashes[np.lexsort((hashes, often))[: n - int(np.ceil(threshold * n - 1e-9)) + OVERLAP]]


def _frequent(docs: DataFrame, text: str, key: str) -> tuple[np.ndarray, np.ndarray]:
    """Shingles held by more than three texts of a sample of about ``SAMPLE``, in order, and how many hold each.

    The sample is a filter by hash, so that it stays spread over the input's tasks."""
    share = int(min(1.0, SAMPLE / max(1, docs.count())) * _PARTS)
    rank = F.pmod(F.xxhash64(F.col(text), F.col(key).cast("long"), F.lit("sample")), F.lit(_PARTS))

    @lean
    def collect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for a in range(0, len(b), 256):
                yield pd.DataFrame({"sets": [shingle_set(t)[1] for t in b["text"][a : a + 256]]})

    rows = docs.filter(rank < share).select(F.col(text).alias("text"))
    counts = rows.mapInPandas(collect, "sets array<long>").select(F.explode("sets").alias("s")).groupBy("s").agg(F.count("*").alias("n"))
    got = counts.filter("n > 3").orderBy(F.desc("n"), "s").limit(FREQUENT).toPandas().sort_values("s")
    return got["s"].to_numpy(np.int64), got["n"].to_numpy(np.int64)


def indexed(docs: DataFrame, text: str = "text", key: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """Per row: doc_id, h (xxhash64 of the text), fp (hash of its words), sim (SimHash fingerprint), n (distinct shingles), prefix."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(_frequent(docs, text, key))

    @lean
    def compute(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for a in range(0, len(b), 1024):
                part = b.iloc[a : a + 1024]
                sets = [shingle_set(t, sim=True) for t in part["text"]]
                fp, sim = (np.array([s[i] for s in sets], np.uint64).view(np.int64) for i in (0, 2))
                yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64").to_numpy(), "h": part["h"].to_numpy(), "fp": fp, "sim": sim, "n": [len(s[1]) for s in sets], "prefix": [prefix(s[1], shared.value, threshold) for s in sets]})

    own = docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("h"), F.col(text).alias("text"))
    return own.mapInPandas(compute, _SCHEMA)


def _sets(docs: DataFrame, rows: DataFrame, wanted: DataFrame, text: str) -> DataFrame:
    """The whole shingle sets (fp, shingles) of the wanted texts, made again from one row's text each."""

    @lean
    def compute(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for a in range(0, len(b), 256):
                part = [shingle_set(t) for t in b["text"][a : a + 256]]
                yield pd.DataFrame({"fp": np.array([s[0] for s in part], np.uint64).view(np.int64), "shingles": [s[1] for s in part]})

    texts = rows.select("fp", "h").join(small(wanted, BROADCAST), "fp", "left_semi").groupBy("fp").agg(F.min("h").alias("h")).select("h").distinct()
    texts = small(materialize(texts, "neardup-texts"), BROADCAST)
    own = docs.select(F.xxhash64(F.col(text)).alias("h"), F.col(text).alias("text")).join(texts, "h", "left_semi").select("text")
    return materialize(own.mapInPandas(compute, "fp long, shingles array<long>").dropDuplicates(["fp"]), "neardup-sets")


def _fits(m, n, threshold: float):
    """Whether sets of these sizes can be similar enough."""
    return F.least(m, n) >= threshold * F.greatest(m, n) - 1e-9


def _need(m, n, threshold: float):
    """How many shingles the prefixes of two similar sets of these sizes share at least.

    Of the shingles that both hold, those outside the prefix that ends first are no more than the rest of its set."""
    rest = F.ceil(threshold * F.greatest(m, n) - 1e-9) - OVERLAP
    return F.ceil(threshold / (1 + threshold) * (m + n) - 1e-9) - F.greatest(F.lit(0), rest)


def candidates(rows: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """Pairs (u, v) of ``fp`` that can be similar, and the members (bucket, fp, n, hot) of buckets too large to list.

    A similar pair is among the pairs, or both of its texts are members of one large bucket."""
    index = rows.select("fp", "n", F.explode("prefix").alias("bucket"))
    ends = [f(F.struct("fp", "n")).alias(c) for c, f in (("a", F.min), ("b", F.max))]
    sizes = materialize(index.groupBy("bucket").agg(F.count("*").alias("rows"), *ends).filter("a.fp <> b.fp"), "neardup-buckets")
    more = small(sizes.filter("rows > 2").select("bucket", "rows"), BROADCAST)
    members = materialize(index.join(more, "bucket").distinct(), "neardup-members")
    two = sizes.filter("rows = 2").filter(_fits(F.col("a.n"), F.col("b.n"), threshold)).select(F.col("a").alias("u"), F.col("b").alias("v"))
    lists = members.filter(F.col("rows") <= BUCKET).groupBy("bucket").agg(F.sort_array(F.collect_list(F.struct("fp", "n"))).alias("all"))
    listed = (
        lists.select("all", F.posexplode("all").alias("i", "u"))
        .select("u", F.explode(F.filter(F.expr("slice(all, i + 2, size(all))"), lambda y: _fits(F.col("u.n"), y["n"], threshold))).alias("v"))
    )
    shared = two.union(listed).select(F.col("u.fp").alias("u"), F.col("v.fp").alias("v"), F.col("u.n").alias("m"), F.col("v.n").alias("n"))
    shared = shared.groupBy("u", "v", "m", "n").agg(F.count("*").alias("k"))
    hot = members.filter(F.col("rows") > BUCKET).select("bucket", "fp", "n")
    per = materialize(hot.groupBy("fp").agg(F.collect_set("bucket").alias("hots")), "neardup-hot")
    per = small(per, BROADCAST // BUCKET)
    # shingles of large buckets are not counted in k; a text has no more of them than its prefix is long
    for x in "uv":
        shared = shared.join(per.select(F.col("fp").alias(x), F.col("hots").alias("hots_" + x)), x, "left")
    none = F.array().cast("array<long>")
    uncounted = F.size(F.array_intersect(F.coalesce("hots_u", none), F.coalesce("hots_v", none)))
    pairs = materialize(shared.filter(F.col("k") + uncounted >= _need(F.col("m"), F.col("n"), threshold)).select("u", "v"), "neardup-pairs")
    hot = hot.join(per.select("fp", F.size("hots").alias("hot")), "fp").filter(F.col("hot") >= F.least(F.lit(OVERLAP), F.ceil(threshold * F.col("n") - 1e-9)))
    return pairs, materialize(hot.select("bucket", "fp", "n", "hot"), "neardup-hot")


def near_fingerprints(rows: DataFrame) -> DataFrame:
    """Pairs (u, v) of ``fp`` whose SimHash fingerprints are equal or linked by ``simhash.links``."""
    per = materialize(rows.groupBy("sim").agg(F.min("fp").alias("least"), F.max("fp").alias("most")), "neardup-fingerprints")
    same = rows.join(small(per.filter("least <> most"), BROADCAST), "sim").filter("fp <> least").select(F.col("fp").alias("u"), F.col("least").alias("v"))
    near = materialize(simhash.links(per.select(F.col("sim").alias("fp"))), "neardup-linked")
    u, v = (per.select(F.col("sim").alias(x), F.col("least").alias("of_" + x)) for x in "uv")
    near = near.join(u, "u").join(v, "v").select(F.col("of_u").alias("u"), F.col("of_v").alias("v"))
    both = same.union(near).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    return materialize(both.distinct(), "neardup-near")


def _apart(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """The pairs whose texts ``edges`` do not connect yet."""
    roots = small(materialize(connected_components(edges), "neardup-roots"), BROADCAST)
    for x in "uv":
        pairs = pairs.join(roots.select(F.col("node").alias(x), F.col("root").alias("root_" + x)), x, "left")
    return pairs.filter(F.coalesce("root_u", "u") != F.coalesce("root_v", "v")).select("u", "v")


def differences(hot: DataFrame, sets: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per text of ``hot`` (bucket, fp): fp, family, centre, near, s, elements.

    A family is all that large buckets connect. ``elements`` are the shingles that set the text apart from those that more
    than half of its family hold. Two texts are similar if their elements, less those that both have, are no more than a
    share of the sum of their sizes; ``s`` is the elements' number less that share of the text's own size. Without common
    elements they are so exactly if their ``s`` add up to zero or less, and then both are similar to the text of the
    smallest ``s``, the family's ``centre``; ``near`` says so. Other pairs have half the sum of their ``s`` in common."""
    share = (1 - threshold) / (1 + threshold)
    family = connected_components(hot.select(F.col("fp").alias("u"), F.col("bucket").alias("v"))).select(F.col("node").alias("fp"), F.col("root").alias("family"))
    own = materialize(hot.select("fp").distinct().join(family, "fp", "left").select("fp", F.coalesce("family", "fp").alias("family")).join(sets, "fp"), "neardup-families")
    members = small(own.groupBy("family").agg(F.count("*").alias("members")), BROADCAST)
    held = own.select("family", F.explode("shingles").alias("element")).groupBy("family", "element").agg(F.count("*").alias("k"))
    most = materialize(held.join(members, "family").filter("2 * k > members").select("family", "element"), "neardup-most")
    core = most.groupBy("family").agg(F.collect_list("element").alias("core"))
    core = F.broadcast(core) if most.count() <= BROADCAST else core
    core = own.join(core, "family", "left").withColumn("core", F.coalesce("core", F.array().cast("array<long>")))
    unlike = F.concat(F.array_except("shingles", "core"), F.array_except("core", "shingles"))
    own = core.select("fp", "family", F.size("shingles").alias("n"), unlike.alias("elements"))
    own = materialize(own.select("fp", "family", (F.size("elements") - share * F.col("n")).alias("s"), "elements"), "neardup-differences")
    centre = small(own.groupBy("family").agg(F.min(F.struct("s", "fp")).alias("c")), BROADCAST)
    near = F.col("s") + F.col("c.s") <= _EPSILON
    return materialize(own.join(centre, "family").select("fp", "family", F.col("c.fp").alias("centre"), near.alias("near"), "s", "elements"), "neardup-differences")


def _unlike(own: DataFrame, edges: DataFrame) -> DataFrame:
    """Per text of a family that is not near as a whole, and element that others of the family have too: family, element,
    fp, s, near, root, left (how many of the text's elements come from this one on, in the order of all)."""
    open_ = small(own.filter("not near").select("family").distinct(), BROADCAST)
    own = own.join(open_, "family", "left_semi")
    each = own.select("family", "fp", F.explode("elements").alias("element"))
    counts = each.groupBy("family", "element").agg(F.count("*").alias("k")).filter("k > 1")
    lists = each.join(counts, ["family", "element"]).groupBy("fp").agg(F.sort_array(F.collect_list(F.struct("k", "element"))).alias("all"))
    roots = small(materialize(connected_components(edges), "neardup-roots"), BROADCAST).withColumnRenamed("node", "fp")
    own = own.select("fp", "family", "s", "near").join(lists, "fp").join(roots, "fp", "left")
    index = own.select("family", "fp", "s", "near", F.coalesce("root", "fp").alias("root"), F.size("all").alias("size"), F.posexplode("all").alias("i", "e"))
    return index.select("family", F.col("e.element").alias("element"), "fp", "s", "near", "root", (F.col("size") - F.col("i")).alias("left"))


def links(docs: DataFrame, rows: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Links (u, v) between texts' ``fp`` that have the same components as all pairs of enough similarity."""
    near = near_fingerprints(rows)
    pairs, hot = candidates(rows, threshold)
    ends = [near.select("u"), near.select("v"), pairs.select("u"), pairs.select("v"), hot.select("fp")]
    sets = _sets(docs, rows, materialize(functools.reduce(DataFrame.union, ends).toDF("fp").distinct(), "neardup-wanted"), text)

    def verified(candidates: DataFrame) -> DataFrame:
        u, v = (sets.select(F.col("fp").alias(x), F.col("shingles").alias("s" + x)) for x in "uv")
        # the few pivots' sets are broadcast, so that one pivot's pairs need no task of their own
        few = candidates.select("v").distinct()
        v = F.broadcast(v.join(F.broadcast(few), "v", "left_semi")) if few.count() <= 1_000 else v
        common = F.size(F.array_intersect("su", "sv"))
        both = candidates.join(u, "u").join(v, "v").select("u", "v", common.alias("common"), (F.size("su") + F.size("sv")).alias("total"))
        return materialize(both.filter(F.col("common") / (F.col("total") - F.col("common")) >= threshold).select("u", "v"), "neardup-links")

    least = lambda x: x.groupBy(F.col("v").alias("u")).agg(F.min("u").alias("v"))
    swapped = lambda x: x.select(F.col("v").alias("u"), F.col("u").alias("v"))
    # first a text's pair with the smallest other by SimHash, then by prefixes, then all that are still apart
    tried = materialize(least(near), "neardup-tried")
    edges, left = verified(tried), swapped(near.union(pairs).distinct())
    for last in (False, True):
        left = materialize(_apart(left, edges).join(tried, ["u", "v"], "left_anti"), "neardup-left")
        tried = left if last else materialize(left.groupBy("u").agg(F.min("v").alias("v")), "neardup-tried")
        edges = edges.union(verified(tried))
    for i in range(ROUNDS):
        if not hot.take(1):
            break
        own = differences(hot, sets, threshold)
        edges = materialize(edges.union(own.filter("near and fp <> centre").select(F.col("fp").alias("u"), F.col("centre").alias("v"))), "neardup-links")
        index = materialize(_unlike(own, edges), "neardup-unlike")
        far = index.filter("not near").groupBy("family", "element").agg(F.count("*").alias("k"))
        pairs_left, rows_left = far.agg(F.sum(F.col("k") * (F.col("k") - 1) / 2), F.sum("k")).first()
        if not rows_left:
            break
        last = i == ROUNDS - 1 or pairs_left <= BUCKET * rows_left or not own.filter("near").take(1)
        others = index.select("family", "element", F.col("fp").alias("v"), F.col("s").alias("s_v"), F.col("near").alias("near_v"), F.col("left").alias("left_v"), F.col("root").alias("to"))
        able = (2 * F.least("left", "left_v") >= F.col("s") + F.col("s_v") - _EPSILON) & (F.col("root") != F.col("to"))
        # the others of those apart from their centre wait for a centre of their own, or are listed in the end
        found = index.filter("not near").join(others, ["family", "element"]).filter(able & ((F.col("near_v") | F.expr("fp > v")) if last else F.col("near_v")))
        edges = edges.union(verified(materialize(found.select(F.col("fp").alias("u"), "v").distinct(), "neardup-pairs")))
        if last:
            break
        hot = materialize(hot.join(own.filter("near").select("fp"), "fp", "left_anti"), "neardup-hot")
    return edges


def deduplicate(docs: DataFrame, text: str = "text", key: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one row of each component of similar texts, that of the smallest id (null ids last)."""
    rows = materialize(indexed(docs, text, key, threshold), "neardup-index")
    return simhash.first_of_groups(docs, simhash.grouped(rows.select("doc_id", "h", "fp"), links(docs, rows, text, threshold)), text, key)

"""Benchmark decontamination with SimHash windows, multi-index Hamming blocks and exact weighted-shingle similarity.

Everything is DataFrame functions. Texts and items are lower-cased and cut into words (runs of letters and digits); a
shingle is the hash of five words in a row (an item of fewer words is one shingle of them all). Windows of an item's size
are laid over a text at every word, also where they stick out at its ends by a quarter at most, and each gets a SimHash of its
shingles: a bit is set where more than half of them have it. Sizes are taken from a grid whose steps are a
tenth (every size up to ten shingles), so that windows of a few dozen sizes serve any number of items.

A window of enough similarity holds four fifths of an item's shingles, so windows are laid only where they hold one shingle
of any item at least; this loses none. A window's 63 bits are counted by running sums: a long holds several counters side
by side (``_LANES``), sums run over the shingles of a chunk of text by a window function, and a window's counters are the
difference of two sums. Chunks overlap by a window and are rows of their own, so a long text is never one task's.

The index holds every item's four blocks of 16 bits under all values within ``NEAR`` = 3 bits; a window looks up its four
blocks by equality. Two fingerprints within ``RADIUS`` = 15 bits have a block with 3 differing bits at most, so all of
them are found, whatever the item. Pairs within the radius are verified by the exact weighted similarity at the item's
own size: the sum of the smaller counts of all shingles over the sum of the larger ones, best of the places that the
window allows. Links of ``THRESHOLD`` or more are contamination. Only they leave the scan; nothing else is shuffled.

At similarity 0.8 two fingerprints differ in 9.7 bits on average (standard deviation 2.9), at 0.9 in 6.7; README.md has
the recall that was measured. The index is broadcast in pieces of at most ``INDEX_ITEMS`` items (2,788 rows of two longs
each), a scan of the texts for each piece.

Defined results: null, empty and short texts have no shingles and are clean; null and empty items match nothing, and so
does a null item id under another's text. Null ids are kept as a null id. Repeated rows give one match per id and item;
equal items match each under their own id, and several texts under one item id are items of their own. Of places that are
equally similar the first is told. Very long texts are scanned whole, in chunks. Columns of ``docs`` play no part but for
the text and the key.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, small

SHINGLE = 5
THRESHOLD = 0.8
#: Four blocks of 16 bits with up to NEAR differing bits each: 4 * (3 + 1) - 1 differing bits always leave one such block.
BLOCKS, WIDTH, NEAR = 4, 16, 3
RADIUS = BLOCKS * (NEAR + 1) - 1
BITS = 63
#: Most items whose index is broadcast at a time, and most rows of a table of matches that is broadcast.
INDEX_ITEMS, BROADCAST = 1_000, 400_000
#: Words of a chunk at which windows start.
CHUNK = 256
#: Most shingles of a window, by the bits of a counter: 63 = 9 longs of 7 counters = 21 longs of 3 counters.
_LANES = {9: 200, 21: 200_000}


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def shingles(words_: Column, k: int) -> Column:
    """The hash of every ``k`` words in a row."""
    n = F.size(words_)
    at = F.when(n >= k, F.sequence(F.lit(0), n - k)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(*[words_[i + j] for j in range(k)]))


def _long(value: int) -> Column:
    return F.lit(value).cast("long")


def simhash(hashes: Column) -> Column:
    """63 bits, each set where more than half of the hashes have it."""
    own = lambda i: F.size(F.filter(hashes, lambda h: F.getbit(h, i) == 1))
    bit = lambda i: F.call_function("shiftleft", _long(1), i)
    return F.aggregate(F.sequence(F.lit(0), F.lit(BITS - 1)), _long(0), lambda held, i: F.when(2 * own(i) > F.size(hashes), held.bitwiseOR(bit(i))).otherwise(held))


def similarity(a: Column, b: Column) -> Column:
    """Weighted Jaccard similarity of two arrays of shingles, each shingle weighing as often as it occurs."""
    count = lambda array, x: F.size(F.filter(array, lambda y: y == x))
    both = F.array_intersect(a, b)
    once = (F.size(F.array_distinct(a)) == F.size(a)) & (F.size(F.array_distinct(b)) == F.size(b))
    common = F.when(once, F.size(both)).otherwise(F.aggregate(both, F.lit(0), lambda s, x: s + F.least(count(a, x), count(b, x))))
    return common / (F.size(a) + F.size(b) - common).cast("double")


def grid(most: int) -> list[int]:
    """Window sizes, in shingles, up to the first that is no smaller than ``most``."""
    sizes = [1]
    while sizes[-1] < most:
        sizes.append(max(sizes[-1] + 1, round(sizes[-1] * 1.1)))
    return sizes


def _nearest(n: Column, sizes: list[int]) -> Column:
    """The grid size next to ``n``."""
    return reduce(lambda rest, s: F.when(n <= (s[0] + s[1]) // 2, s[0]).otherwise(rest), reversed(list(zip(sizes, sizes[1:]))), F.lit(sizes[-1]))


def _text_hash(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("h"), F.length(text).alias("n")]


def _key(size: Column, place: Column, value: Column) -> Column:
    """One long that names a window size, a block's place and its value."""
    return F.shiftleft(F.shiftleft(size.cast("long"), 2).bitwiseOR(place.cast("long")), WIDTH).bitwiseOR(value)


def _block(fp: Column, place: Column) -> Column:
    return F.call_function("shiftrightunsigned", fp, place * WIDTH).bitwiseAND(_long((1 << WIDTH) - 1))


def items_of(items: DataFrame, item_text: str = "text", item_key: str = "item_id") -> DataFrame:
    """Benchmark rows with words: item (an own number), item_id, k (words of a shingle), size (of windows), own, goal."""
    w = items.select(F.col(item_key).cast("long").alias("item_id"), words(F.col(item_text)).alias("w")).filter(F.size("w") > 0)
    k = F.least(F.size("w"), F.lit(SHINGLE))
    own = reduce(lambda rest, i: F.when(k == i, shingles(F.col("w"), i)).otherwise(rest), range(1, SHINGLE), shingles(F.col("w"), SHINGLE))
    w = materialize(w.select(F.monotonically_increasing_id().alias("item"), "item_id", k.alias("k"), own.alias("own")), "decontam-words")
    sizes = grid(w.agg(F.coalesce(F.max(F.size("own")), F.lit(1))).first()[0])
    return materialize(w.select("*", _nearest(F.size("own"), sizes).alias("size"), simhash(F.col("own")).alias("goal")), "decontam-items")


def index_of(items: DataFrame) -> DataFrame:
    """The index of items' fingerprints: key (size, place and value of a block), item, goal."""
    masks = [sum(1 << b for b in bits) for n in range(NEAR + 1) for bits in combinations(range(WIDTH), n)]
    near = items.select("item", "goal", "size", F.explode(F.array(*map(F.lit, range(BLOCKS)))).alias("place"))
    near = near.select("item", "goal", "size", "place", F.explode(F.expr(f"array({','.join(f'{m}L' for m in masks)})")).alias("mask"))
    return near.select(_key(F.col("size"), F.col("place"), _block(F.col("goal"), F.col("place")).bitwiseXOR(F.col("mask"))).alias("key"), "item", "goal")


def _hits(texts: DataFrame, goals: DataFrame, k: int, chunk: int, reach: int) -> DataFrame:
    """Per text (h, n) with a shingle of any item: the chunks at which windows start that hold one."""
    seen = texts.filter(F.size("w") >= k).select("h", "n", F.posexplode(shingles(F.col("w"), k)).alias("pos", "shingle"))
    held = seen.join(F.broadcast(goals.select(F.explode("own").alias("shingle")).distinct()), "shingle", "left_semi")
    ends = F.array(F.floor(F.col("pos") / chunk).cast("int"), F.floor(F.greatest(F.col("pos") - reach, F.lit(0)) / chunk).cast("int"))
    return held.select("h", "n", F.explode(ends).alias("chunk")).distinct()


def _running(texts: DataFrame, hits: DataFrame, k: int, chunk: int, reach: int, lane: int) -> DataFrame:
    """The chunks hit: h, n, chunk, first (a position), total (shingles of the text), all (per shingle: pos, x, running sums)."""
    told = small(materialize(hits.groupBy("h", "n").agg(F.collect_list("chunk").alias("chunks")), "decontam-chunks"), BROADCAST // 8)
    rows = texts.select("h", "n", "text").join(told, ["h", "n"]).select("h", "n", "chunks", words(F.col("text")).alias("w"))
    rows = rows.select("h", "n", "chunks", shingles(F.col("w"), k).alias("s"))
    rows = rows.select("h", "n", "s", F.explode("chunks").alias("chunk"))
    first = F.greatest(F.col("chunk") * chunk - reach, F.lit(0))
    last = F.least(F.col("chunk") * chunk + chunk + reach, F.size("s")) - 1
    # an outer generator, as Spark derives a filter from others that would compute the shingles twice
    rows = rows.select("h", "n", "chunk", "s", F.explode_outer(F.when(first <= last, F.sequence(first, last))).alias("pos")).filter("pos is not null")
    rows = rows.select("h", "n", "chunk", "pos", F.get("s", F.col("pos")).alias("x"), F.size("s").alias("total"))
    rows = rows.groupBy("h", "n", "chunk", "pos").agg(F.min("x").alias("x"), F.min("total").alias("total"))  # copies of a text are one
    ones = _long(sum(1 << i for i in range(0, BITS, lane)))
    order = Window.partitionBy("h", "n", "chunk").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    sums = [F.sum(F.shiftrightunsigned("x", i).bitwiseAND(ones)).over(order).alias(f"p{i}") for i in range(lane)]
    rows = rows.select("h", "n", "chunk", "pos", "x", "total", *sums)
    own = F.struct("pos", "x", *[f"p{i}" for i in range(lane)])
    return rows.groupBy("h", "n", "chunk").agg(F.min("pos").alias("first"), F.min("total").alias("total"), F.sort_array(F.collect_list(own)).alias("all"))


def _windows(rows: DataFrame, sizes: list[int], chunk: int, lane: int) -> DataFrame:
    """All windows that start in a chunk: h, n, first, all, size, i (where the window starts in ``all``), fp."""
    rows = rows.select("*", F.explode(F.array(*map(F.lit, sizes))).alias("size"))
    out = F.floor(F.col("size") / 4).cast("int")  # how far a window may stick out of the text
    begin = F.when(F.col("chunk") == 0, -out).otherwise(F.col("chunk") * chunk)
    end = F.least(F.col("chunk") * chunk + chunk - 1, F.col("total") - F.col("size") + out)
    rows = rows.select("*", F.explode_outer(F.when(begin <= end, F.sequence(begin, end))).alias("start")).filter("start is not null")
    rows = rows.select("*", (F.greatest(F.col("start"), F.lit(0)) - F.col("first")).alias("lo"), (F.least(F.col("start") + F.col("size"), F.col("total")) - F.col("first")).alias("hi"))
    a, b = F.get("all", F.col("lo")), F.get("all", F.col("hi") - 1)
    ones = sum(1 << i for i in range(0, BITS, lane))
    # a counter's top bit is set exactly if more than half of the window's shingles counted
    bias = ((1 << lane - 1) - 1 - F.shiftright(F.col("hi") - F.col("lo"), 1)).cast("long") * _long(ones)
    spread = lambda i: F.shiftrightunsigned(a["x"], i).bitwiseAND(_long(ones))
    bits = [F.shiftleft(F.shiftrightunsigned(b[f"p{i}"] - (a[f"p{i}"] - spread(i)) + bias, lane - 1).bitwiseAND(_long(ones)), i) for i in range(lane)]
    fp = F.coalesce(reduce(Column.bitwiseOR, bits), _long(0))  # never null, which spares a filter that computes it twice
    return rows.select("h", "n", "first", "all", "size", (F.col("start") - F.col("first")).alias("i"), fp.alias("fp"))


def _scan(docs: DataFrame, text: str, goals: DataFrame, k: int, lane: int, threshold: float) -> DataFrame:
    """Links of all texts to items of ``k``-word shingles: h, n, item, start, similarity, distance (with repeats)."""
    sizes, most, off = goals.agg(F.sort_array(F.collect_set("size")), F.max(F.size("own")), F.max(F.abs(F.size("own") - F.col("size")))).first()
    chunk, reach = max(CHUNK, 2 * sizes[-1]) if lane > min(_LANES) else CHUNK, max(most, sizes[-1]) + off
    texts = docs.select(*_text_hash(F.col(text)), F.col(text).alias("text"))
    hits = _hits(texts.select("h", "n", words(F.col("text")).alias("w")), goals, k, chunk, reach)
    rows = _running(texts, materialize(hits, "decontam-hits"), k, chunk, reach, lane)
    keyed = _windows(rows, sizes, chunk, lane).select("*", F.explode(F.array(*map(F.lit, range(BLOCKS)))).alias("place"))
    keyed = keyed.select("*", _key(F.col("size"), F.col("place"), _block(F.col("fp"), F.col("place"))).alias("key"))
    near = keyed.join(F.broadcast(index_of(goals)), "key").withColumn("off", F.col("fp").bitwiseXOR(F.col("goal")))
    # a pair meets at every block that is near enough; it is taken at the first
    met = reduce(lambda rest, p: F.when(F.bit_count(_block(F.col("off"), F.lit(p))) <= NEAR, p).otherwise(rest), reversed(range(BLOCKS)), F.lit(None).cast("int"))
    near = near.withColumn("distance", F.bit_count("off")).filter((F.col("distance") <= RADIUS) & (met == F.col("place")))
    near = near.join(F.broadcast(goals.select("item", "own")), "item")
    # the item's own size may differ from the window's by half a step: all places of the one within the other
    m = F.size("own")
    first, last = F.least(F.col("i"), F.col("i") + F.col("size") - m), F.greatest(F.col("i"), F.col("i") + F.col("size") - m)
    lo, hi = F.greatest(first, F.lit(0)), F.least(last + m, F.size("all"))
    piece = F.transform(F.slice("all", lo + 1, hi - lo), lambda x: x["x"])
    near = near.select("h", "n", "item", "distance", "own", (F.col("first") + lo).alias("lo"), (first - lo).alias("from"), (last - lo).alias("to"), piece.alias("piece"))
    near = near.filter(F.arrays_overlap("own", "piece")).select("*", F.explode_outer(F.sequence("from", "to")).alias("at"))
    begin = F.greatest(F.col("at"), F.lit(0))
    window = F.slice("piece", begin + 1, F.greatest(F.lit(0), F.least(F.col("at") + F.size("own"), F.size("piece")) - begin))
    near = near.select("h", "n", "item", (F.col("lo") + F.col("at")).alias("start"), similarity(F.col("own"), window).alias("similarity"), "distance")
    return near.filter(F.col("similarity") >= threshold)


def contaminated_texts(docs: DataFrame, items: DataFrame, text: str = "text", item_text: str = "text", item_key: str = "item_id", threshold: float = THRESHOLD) -> DataFrame:
    """Per distinct text (hash h, length n) and item that it holds: item_id, start (word), similarity, distance."""
    goals = items_of(items, item_text, item_key)
    lane = reduce(lambda rest, l: F.when(F.col("size") <= _LANES[l], l).otherwise(rest), sorted(_LANES, reverse=True), F.lit(max(_LANES)))
    goals = goals.withColumn("lane", lane)
    kinds = goals.groupBy("k", "lane").agg(F.count("*").alias("n")).orderBy("k", "lane").collect()  # ten at most
    found = None
    for kind in kinds:
        parts = -(-kind["n"] // INDEX_ITEMS)
        for part in range(parts):
            own = goals.filter((F.col("k") == kind["k"]) & (F.col("lane") == kind["lane"]))
            own = own.filter(F.pmod(F.xxhash64("item"), F.lit(parts)) == part) if parts > 1 else own
            one = _scan(docs, text, own, kind["k"], kind["lane"], threshold)
            found = one if found is None else found.union(one)
    if found is None:
        found = docs.select(*_text_hash(F.col(text)), _long(0).alias("item"), F.lit(0).alias("start"), F.lit(0.0).alias("similarity"), F.lit(0).alias("distance")).limit(0)
    best = F.max(F.struct("similarity", (-F.col("start")).alias("start"), (-F.col("distance")).alias("distance"))).alias("m")
    found = found.groupBy("h", "n", "item").agg(best).join(goals.select("item", "item_id"), "item")
    return found.select("h", "n", "item_id", (-F.col("m.start")).alias("start"), "m.similarity", (-F.col("m.distance")).alias("distance"))


def matches(docs: DataFrame, items: DataFrame, text: str = "text", key: str = "doc_id", **how) -> DataFrame:
    """Contaminated documents: doc_id, item_id, start, similarity, distance; the best window of each pair."""
    found = small(materialize(contaminated_texts(docs, items, text, **how), "decontam-found"), BROADCAST)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), *_text_hash(F.col(text))).join(found, ["h", "n"])
    best = F.max(F.struct("similarity", (-F.col("start")).alias("start"), (-F.col("distance")).alias("distance"))).alias("m")
    return rows.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", (-F.col("m.start")).alias("start"), "m.similarity", (-F.col("m.distance")).alias("distance"))


def clean(docs: DataFrame, items: DataFrame, text: str = "text", **how) -> DataFrame:
    """``docs`` without the rows whose texts hold a benchmark item."""
    found = materialize(contaminated_texts(docs, items, text, **how), "decontam-found").select(F.col("h").alias("__h"), F.col("n").alias("__n")).distinct()
    found = small(found, BROADCAST)
    h, n = _text_hash(docs[text])
    return docs.join(found, (h == F.col("__h")) & (n == F.col("__n")), "left_anti")

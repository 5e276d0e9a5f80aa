"""Shortest-pack-first packing of tokenised documents over a histogram of lengths.

A document's ids (and the closing id) are cut into full sequences and one rest. The rests' lengths are counted in a
histogram of at most ``width`` bins; the packer runs over that histogram alone, longest length first: rests of a length go
to the open packing patterns that are shortest so far, whole counts at a time, and open new patterns where the shortest
has no room. What comes out is a table of patterns with their counts. Rests are numbered within their length
(per-partition counts with running offsets, so that no length meets in one task), each pattern owns a range of those
numbers for each of its places, and a join of rank with range puts every rest in its sequence.

Defined results: a null or empty text is a document of the closing id alone. Null ids and repeated rows are packed like
others, each row once. An empty table gives an empty result. Other columns of the input play no part.
"""

from __future__ import annotations

import sys
import zlib
from array import array
from bisect import insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Bounded, Vocabulary, common, default_path, words
from .common import lean, materialize, ship

WIDTH = 2048
CLOSING = 1
#: Most words that a worker remembers (about 200 bytes each).
WORDS = 1_000_000
#: Pieces of one length that a single task numbers, about.
PART = 20_000


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit bytes, by the tokenizers library with a bounded memo of words."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model, self.signs = self.tokenizer.model, dict(enumerate(Vocabulary._byte_signs()))
        self.memo = Bounded(self._word, WORDS)

    def _encode(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _word(self, word: str) -> bytes:
        """One match of the tokenizer's pattern, by its model alone."""
        signs = word.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.signs)
        ids = array("I", [t.id for t in self.model.tokenize(signs)])
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        if any(s in text for s in self.special) or not common(text):
            return self._encode(text)
        return b"".join(map(self.memo.__getitem__, words(text)))


_ENCODERS: dict[str, Encoder] = {}


def cut(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = WIDTH, closing: int = CLOSING, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """Pieces of at most ``width`` ids: doc_id, start, length, ids_crc32, doc_tokens; with_ids adds the ids."""
    ship(docs.sparkSession)
    path, tail = tokenizer, np.asarray([closing], "<u4").tobytes()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids

    @lean
    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from tidewright.llm import packing

        where = path or default_path("byte_bpe_50k.json")
        encode = packing._ENCODERS.get(where) or packing._ENCODERS.setdefault(where, packing.Encoder(where))
        step = 4 * width
        for b in batches:
            out = []
            for doc, t in zip(b["doc_id"].astype("Int64"), b["text"]):
                data = encode(t) + tail
                for a in range(0, len(data), step):
                    piece = data[a : a + step]
                    out.append((doc, a // 4, len(piece) // 4, zlib.crc32(piece), len(data) // 4) + ((np.frombuffer(piece, "<u4").astype(np.int64),) if with_ids else ()))
            yield pd.DataFrame(out, columns=names).astype({"doc_id": "Int64"})

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<long>" * with_ids
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInPandas(pieces, schema)


def shortest_pack_first(histogram: dict[int, int], width: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths of one sequence, in order) with how often each is used, for ``histogram`` (length: count)."""
    open_: dict[int, list[list]] = {}  # room -> [pattern, count]
    rooms: list[int] = []
    done: list[tuple[tuple[int, ...], int]] = []

    def put(room: int, pattern: tuple[int, ...], n: int):
        if not room:
            done.append((pattern, n))
            return
        if room not in open_:
            insort(rooms, room)
            open_[room] = []
        open_[room].append([pattern, n])

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        made = []  # a pattern takes this length once and may take it again, so new ones open at once
        while left:
            if not rooms or rooms[-1] < length:
                fits = width // length
                full, rest = divmod(left, fits)
                if full:
                    made.append((width - fits * length, (length,) * fits, full))
                if rest:
                    made.append((width - rest * length, (length,) * rest, 1))
                break
            room = rooms[-1]  # the shortest pack
            pattern, n = open_[room][-1]
            use = min(n, left)
            if use == n:
                open_[room].pop()
                if not open_[room]:
                    del open_[room]
                    rooms.pop()
            else:
                open_[room][-1][1] = n - use
            put(room - length, (*pattern, length), use)
            left -= use
        for room, pattern, n in made:
            put(room, pattern, n)
    return done + [(p, n) for group in open_.values() for p, n in group]


def slots(patterns: list[tuple[tuple[int, ...], int]], sequence: int = 0) -> tuple[pd.DataFrame, int]:
    """For each place of each pattern: length, the first rank it takes and how many, its first sequence and its offset."""
    taken: dict[int, int] = {}
    rows = []
    for pattern, n in patterns:
        offset = 0
        for length in pattern:
            first = taken.get(length, 0)
            rows.append((length, first, first + n, sequence, offset))
            taken[length] = first + n
            offset += length
        sequence += n
    return pd.DataFrame(rows, columns=["length", "first", "until", "sequence", "offset"], dtype="int64"), sequence


def _ranked(rests: DataFrame, parts: int) -> DataFrame:
    """Number the rows of each length from 0, in parts that run side by side."""
    from pyspark.sql import Window

    order = ["doc_id", "start", "ids_crc32", "doc_tokens"]
    rows = rests.withColumn("part", F.pmod(F.xxhash64(*order), F.lit(parts)))
    counts = rows.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    own = F.row_number().over(Window.partitionBy("length", "part").orderBy(*order)) - 1
    return rows.withColumn("own", own).join(offsets, ["length", "part"]).withColumn("rank", F.col("own") + F.col("base")).drop("part", "own", "base")


def pack(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = WIDTH, closing: int = CLOSING, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row per piece: those of ``cut``, with sequence_id and offset."""
    spark = docs.sparkSession
    cuts = materialize(cut(docs, text, key, width, closing, tokenizer, with_ids), "packing-pieces")
    histogram = {r["length"]: r["n"] for r in cuts.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `width` rows
    parts = max(8, -(-max(histogram.values(), default=0) // PART))
    whole = histogram.pop(width, 0)
    table, _ = slots(shortest_pack_first(histogram, width), whole)
    schema = "length long, first long, until long, sequence long, offset long"
    places = spark.createDataFrame(table.values.tolist(), schema) if len(table) else spark.createDataFrame([], schema)
    # a place's range is cut into blocks of ranks, so that the join is one of equality
    block = 4096
    places = places.withColumn("block", F.explode(F.sequence(F.floor(F.col("first") / block), F.floor((F.col("until") - 1) / block)))).withColumnRenamed("offset", "place")
    ranked = _ranked(cuts, parts)
    full = ranked.filter(F.col("length") == width).withColumn("sequence_id", F.col("rank")).withColumn("offset", F.lit(0).cast("long"))
    rests = ranked.filter(F.col("length") < width).withColumn("block", F.floor(F.col("rank") / block))
    placed = rests.join(places, ["length", "block"]).filter("rank >= first and rank < until")
    placed = placed.withColumn("sequence_id", F.col("sequence") + F.col("rank") - F.col("first")).withColumn("offset", F.col("place"))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids
    return full.select(*names).union(placed.select(*names))

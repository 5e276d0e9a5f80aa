"""Token counts by heap-and-linked-list byte-pair merging.

A text is cut at special strings (each is one token) and by the tokenizer's pattern; within each match the adjacent pair
of lowest rank is merged again and again, and the count is the initial symbols minus the merges. No identifiers are made.
Counts of distinct matches are remembered in a bounded memo.

Defined results: a null or empty text has 0 bytes and 0 tokens; repeated rows and any ids, null too, are counted alike;
other columns stay as they are. Very long texts are read match by match.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Bounded, Vocabulary, default_path, words
from .common import ship


class Counter:
    """Counts tokens with one vocabulary."""

    def __init__(self, path: str):
        self.vocabulary = v = Vocabulary(path)

        def count(word: str) -> int:
            data = word.encode("utf-8", "surrogatepass")
            return len(data) - v.merges(data)

        self.memo = Bounded(count)

    def __call__(self, text: str | None) -> int:
        if not text:
            return 0
        parts, total = self.vocabulary.parts(text)
        get = self.memo.__getitem__
        for part in parts:
            total += sum(map(get, words(part)))
        return total


_COUNTERS: dict[str, Counter] = {}


def count_tokens(docs: DataFrame, text: str = "text", out: str = "n_tokens", tokenizer: str | None = None) -> DataFrame:
    """``docs`` with the number of tokens of each text in the long column ``out``."""
    ship(docs.sparkSession)
    path = tokenizer

    @F.pandas_udf("long")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from tidewright.llm import tokencount

        where = path or default_path("byte_bpe_50k.json")
        counter = tokencount._COUNTERS.get(where) or tokencount._COUNTERS.setdefault(where, tokencount.Counter(where))
        for b in batches:
            yield pd.Series([counter(t) for t in b], dtype="int64")

    return docs.withColumn(out, counted(F.col(text)))

"""Toxicity by a factorization machine over hashed terms.

A text's terms are the distinct lower-cased runs of word characters and the stems of longer ones (their first 4 to 7
characters), hashed into 2**20 numbers. The machine has a weight and a vector for every number; nothing is left out by a
test of its own. It adds to the linear sum the products of the vectors of all pairs of terms that a text holds, over the
root of their number, so that two terms together can say more than their weights add up to, also two that say nothing
alone. Weights start from each term's own association with the label and are fitted under a lasso penalty, vectors under
one that lets them vanish as a whole; numbers that no learned row has keep a weight and a vector of zero. Terms of a
single learned row cannot be told from its label and are not fitted.

Defined results: a null or empty text has the score of the bias alone; with no labelled rows, or only one label, every
score is the smoothed share of toxic rows. Null ids and null labels are never learned from; several labels of one id
count as the largest. Repeated rows score alike, and so do texts with the same terms; very long texts are read whole, piece
by piece. Other columns of the input stay as they are, but for one named like the result, which is replaced.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import Bounded
from .common import lean, lean_batches, materialize, pieces, release, sampled, ship

HASH_BITS = 20
#: Most labelled rows that the model is fitted on.
TRAIN_ROWS = 20_000
FACTORS = 8
#: Lasso penalty of weights, penalty of vectors, rate, share of a term's association that its weight starts from.
L1, L2, RATE, WARM = 1e-3, 3e-4, 0.15, 0.3
#: Standard errors that chance makes; associations are reduced by them before weights start from them.
CHANCE = 2.5
#: Steps of mini-batches to take at least.
STEPS = 1_000
#: Lengths of the stems that are terms of their own.
STEMS = (4, 5, 6, 7)
#: Texts that are scored at a time.
ROWS = 128
#: Distinct words that a worker remembers.
MEMO = 50_000
_TERM = re.compile(r"\w+")
_MASK = (1 << HASH_BITS) - 1
_STEM = zlib.crc32(b"^")


def hashed(word: str) -> tuple[int, ...]:
    """The hashed terms of one lower-cased word: itself and its stems, each checksum carried on from the one before."""
    data = word.encode("utf-8", "surrogatepass")
    out, c, at = [zlib.crc32(data) & _MASK], _STEM, 0
    for k in STEMS:
        if len(word) <= k:
            break
        end = k if len(data) == len(word) else len(word[:k].encode("utf-8", "surrogatepass"))
        c = zlib.crc32(data[at:end], c)
        out.append(c & _MASK)
        at = end
    return tuple(out)


def terms(text: str | None, memo) -> set[int]:
    out: set[int] = set()
    for piece in pieces(text or ""):
        out.update(*map(memo.__getitem__, set(_TERM.findall(piece.lower()))))
    return out


def _sums(values: np.ndarray, of: np.ndarray, rows: int) -> np.ndarray:
    """Sums of the rows of ``values`` by ``of``, which is in order."""
    out = np.zeros((rows, values.shape[1]))
    if len(of):
        first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
        out[of[first]] = np.add.reduceat(values, first, axis=0)
    return out


class FactorizationMachine:
    """Logistic factorization machine on sets of features, fitted by Adagrad on mini-batches with proximal penalties."""

    def __init__(self, features: int, factors: int = FACTORS, seed: int = 7, scaled: bool = False):
        r = np.random.default_rng(seed)
        self.bias, self.w, self.v = 0.0, np.zeros(features), r.normal(0, 0.01, (features, factors))
        self.scaled = scaled  # whether the sum over pairs is taken over the root of the set's size

    def margin(self, ids: np.ndarray, starts: np.ndarray | None, rows: int, of: np.ndarray) -> np.ndarray:
        """Of ``rows`` sets; ids are the features in order of set, ``of`` each one's set."""
        return self._margin(self.w, self.v, ids, rows, of)[0]

    def _margin(self, w: np.ndarray, v: np.ndarray, ids: np.ndarray, rows: int, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Margins, scales of the sums over pairs, sums of vectors; ids are places in ``w`` and ``v``."""
        scale = np.maximum(np.bincount(of, minlength=rows), 1) ** -0.5 if self.scaled else np.ones(rows)
        own = v[ids]
        s = _sums(own, of, rows)
        pairs = (s**2).sum(1) - np.bincount(of, np.einsum("ij,ij->i", own, own), rows)
        return self.bias + np.bincount(of, w[ids], rows) + 0.5 * scale * pairs, scale, s

    def start(self, sets: list[np.ndarray], labels: np.ndarray) -> None:
        """Begin from each feature's association with the label, in standard errors beyond chance."""
        n = np.zeros(len(self.w))
        p = np.zeros(len(self.w))
        for x, label in zip(sets, labels):
            n[x] += 1
            p[x] += label
        share = labels.mean()
        self.bias = float(np.log(share / (1 - share)))
        z = (p - n * share) / np.sqrt(np.maximum(n, 1) * share * (1 - share))
        self.w[:] = WARM * np.sign(z) * np.maximum(np.abs(z) - CHANCE, 0)

    def fit(self, sets: list[np.ndarray], labels: np.ndarray, steps: int = STEPS, rate: float = RATE, l1: float = L1, l2: float = L2, seed: int = 7) -> None:
        r = np.random.default_rng(seed)
        self.start(sets, labels)
        gb, gw, gv = 1e-3, np.full(self.w.shape, 1e-3), np.full(len(self.v), 1e-3)
        batch = max(8, min(128, len(labels) // 20))
        for _ in range(max(4, -(-steps * batch // len(labels)))):
            order = r.permutation(len(labels))
            for a in range(0, len(order), batch):
                take = order[a : a + batch]
                ids = np.concatenate([sets[i] for i in take])
                of = np.repeat(np.arange(len(take)), [len(sets[i]) for i in take])
                by = np.argsort(ids, kind="stable")  # sets are in order, so this merges runs
                place, row = ids[by], of[by]
                first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]][: len(place)])
                u = place[first]
                at = np.empty(len(ids), np.int64)
                at[by] = np.repeat(np.arange(len(u)), np.diff(np.r_[first, len(ids)]))
                w, v = self.w[u], self.v[u]  # of this batch's features alone
                m, scale, s = self._margin(w, v, at, len(take), of)
                e = (1 / (1 + np.exp(-m.clip(-30, 30))) - labels[take]) / len(take)
                g = e.sum()
                gb += g * g
                self.bias -= rate * g / np.sqrt(gb)
                g = np.bincount(at, e[of], len(u))
                gw[u] += g * g
                step = rate / np.sqrt(gw[u])
                x = w - step * g
                self.w[u] = np.sign(x) * np.maximum(np.abs(x) - step * l1, 0)
                if not len(u):
                    continue
                # a feature's own vector is part of its sets' sums and is taken out once for all of them
                pull = e * scale
                g = np.add.reduceat((pull[:, None] * s)[row], first, axis=0) - np.bincount(at, pull[of], len(u))[:, None] * v
                gv[u] += (g * g).mean(1)
                step = 0.5 * rate / np.sqrt(gv[u])[:, None]
                x = v - step * g
                self.v[u] = x * np.maximum(0, 1 - step * l2 / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12))


class Model:
    """A machine over the numbers that have a weight or a vector; ``kept`` holds them in order."""

    def __init__(self, share: float):
        self.share = share
        self.kept = np.empty(0, np.int64)
        self.machine: FactorizationMachine | None = None

    @functools.cached_property
    def places(self) -> np.ndarray:
        """Each number's place in ``kept``, -1 for others; made where texts are scored."""
        out = np.full(1 << HASH_BITS, -1, np.int32)
        out[self.kept] = np.arange(len(self.kept))
        return out

    def features(self, numbers: np.ndarray) -> np.ndarray:
        """Places of the numbers in ``kept``, the others left out."""
        at = self.places[numbers]
        return at[at >= 0]

    def score(self, texts: list, memo) -> np.ndarray:
        if self.machine is None:
            return np.full(len(texts), self.share)
        out = [self._score(texts[a : a + ROWS], memo) for a in range(0, len(texts), ROWS)]  # bounds what is in memory
        return np.concatenate(out) if out else np.empty(0)

    def _score(self, texts: list, memo) -> np.ndarray:
        found = [self.features(np.fromiter(terms(t, memo), np.int64)) for t in texts]
        of = np.repeat(np.arange(len(texts)), [len(x) for x in found])
        return 1 / (1 + np.exp(-self.machine.margin(np.concatenate(found), None, len(texts), of).clip(-30, 30)))


def _sets(lists: list[pa.ListArray], order: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The numbers that two or more of the lists hold, and each list's places in them, by ``order``."""
    held = np.zeros(1 << HASH_BITS, np.int64)
    parts = []
    for x in lists:
        numbers = x.flatten().to_numpy()
        np.add.at(held, numbers, 1)
        parts += np.split(numbers, x.value_lengths().to_numpy().cumsum()[:-1]) if len(x) else []
    fitted = held > 1
    places = fitted.cumsum(dtype=np.int32)
    return np.flatnonzero(fitted), [places[x[fitted[x]]] - 1 for x in (parts[i] for i in order)]


def train(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "toxic", text: str = "text", key: str = "doc_id", most_rows: int = TRAIN_ROWS) -> Model:
    """Fit on labelled documents where ``learn``, a condition on column ``doc_id``, holds."""
    ship(docs.sparkSession)
    own = labels.select(F.col(key).cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).filter(F.col("label").isNotNull()).filter(learn)
    own = sampled(materialize(own.groupBy("doc_id").agg(F.max("label").alias("label")), "toxicity-labels"), "doc_id", most_rows)

    @lean
    def collect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo = Bounded(hashed, MEMO)
        for b in batches:
            yield pd.DataFrame({"label": b["label"], "h": b["h"], "terms": [sorted(terms(t, memo)) for t in b["text"]]})

    texts = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    # at most `most_rows` rows of two numbers are broadcast; equal texts of one label teach once, which bounds ids on many rows
    rows = texts.join(F.broadcast(own), "doc_id").select("label", F.xxhash64("text").alias("h"), "text")
    rows = rows.mapInPandas(collect, "label int, h long, terms array<int>").dropDuplicates(["h", "label"])
    rows = sampled(materialize(rows, "toxicity-terms"), "h", most_rows)
    got = rows.toArrow()  # at most `most_rows`; numbers of 32 bits, which sets are cut from without a copy
    labels_ = got["label"].to_numpy().astype(np.float64)
    model = Model((labels_.sum() + 1) / (len(labels_) + 2))
    if not labels_.sum() or labels_.all():
        return model
    order = np.lexsort((labels_, got["h"].to_numpy()))
    model.kept, sets = _sets(got["terms"].chunks, order)
    del got
    release()  # the rows' memory, before the fit, which is long
    machine = FactorizationMachine(len(model.kept), scaled=True)
    machine.fit(sets, labels_[order])
    model.machine = machine
    return model


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "toxicity") -> DataFrame:
    """``docs`` with the double column ``out``: how likely the text is toxic."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        memo = Bounded(hashed, MEMO)
        for b in lean_batches(batches):
            yield pd.Series(shared.value.score(b.tolist(), memo))

    return docs.withColumn(out, predict(F.col(text)))

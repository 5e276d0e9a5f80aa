"""Quality scores by a sparse rule ensemble.

Statistics of a text (shares of kinds of characters, of repeated words and lines, lengths) are computed once per text.
On a bounded sample of labelled rows small boosted trees are grown over these statistics; every path from a root to a
node is a conjunctive rule; a lasso logistic regression over the rules keeps few of them. The kept rules are compiled
into Spark column expressions over the statistics, so scoring needs nothing but the statistics.

Defined results: a null or empty text has statistics of zero and is scored by the same rules; with no labelled rows, or
only one label, every score is the smoothed share of label 1. Null ids and null labels are never learned from; several
labels of one id count as the largest. Repeated rows score alike; other columns of the input stay as they are.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, sampled, ship

#: Most labelled rows that the rules are fitted on.
TRAIN_ROWS = 20_000
TREES, DEPTH, BINS, LEAF = 40, 3, 32, 8
#: Most rules that are kept.
RULES = 60

STATISTICS = [
    "bytes", "words", "mean_word", "upper", "digit", "space", "beyond_ascii", "exclaim", "pipe", "signs", "stops", "distinct_words",
    "top_word", "repeats", "lines", "repeated_lines", "mean_line", "bare_lines",
]
_KIND = {
    "upper": range(65, 91), "digit": range(48, 58), "space": (9, 10, 11, 12, 13, 32), "beyond_ascii": range(128, 256),
    "exclaim": (33,), "pipe": (124,), "signs": tuple(b"#$%&*@^~_=<>{}[]\\/+"), "stops": (44, 46, 59, 58, 63),
}
_WEIGHTS = np.zeros((256, len(_KIND)))
for _j, _k in enumerate(_KIND.values()):
    _WEIGHTS[list(_k), _j] = 1


def statistics(text: str | None) -> list[float]:
    """The values of STATISTICS for one text."""
    data = (text or "").encode("utf-8", "surrogatepass")
    n = len(data)
    if not n:
        return [0.0] * len(STATISTICS)
    kinds = (np.bincount(np.frombuffer(data, np.uint8), minlength=256) @ _WEIGHTS / n).tolist()
    words = data.split()
    w = len(words)
    seen = Counter(words)
    repeats = sum(map(bytes.__eq__, words, words[1:]))
    lines = [x for x in data.split(b"\n") if x.strip()]
    m = len(lines)
    bare = sum(x.rstrip()[-1:] not in (b".", b"!", b"?", b":") for x in lines)
    return [
        float(n), float(w), sum(map(len, words)) / w if w else 0.0, *kinds, len(seen) / w if w else 0.0,
        max(seen.values()) / w if w else 0.0, repeats / w if w else 0.0, float(m), 1 - len(set(lines)) / m if m else 0.0, n / m if m else 0.0, bare / m if m else 0.0,
    ]


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, above, threshold): each statistic is above its threshold, or not."""

    terms: tuple[tuple[int, bool, float], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for j, above, t in self.terms:
            out &= (x[:, j] > t) == above
        return out

    def column(self, struct: str) -> Column:
        out = F.lit(True)
        for j, above, t in self.terms:
            c = F.col(f"{struct}.{STATISTICS[j]}")
            out = out & ((c > F.lit(t)) if above else (c <= F.lit(t)))
        return out


def simplified(terms: list[tuple[int, bool, float]]) -> Rule:
    """One bound at most in each direction of a statistic."""
    low: dict[int, float] = {}
    high: dict[int, float] = {}
    for j, above, t in terms:
        if above:
            low[j] = max(t, low.get(j, t))
        else:
            high[j] = min(t, high.get(j, t))
    return Rule(tuple(sorted([(j, True, t) for j, t in low.items()] + [(j, False, t) for j, t in high.items()])))


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = 5) -> list[Rule]:
    """Boost small trees on the logistic loss; return the rules of all paths, each once, in order of appearance."""
    r = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], 1)
    margin = np.full(len(y), np.log(y.mean() / (1 - y.mean())))
    rules: dict[Rule, None] = {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        rows = np.flatnonzero(r.random(len(y)) < 0.7) if len(y) > 200 else np.arange(len(y))
        stack = [(rows, np.arange(len(y)), [], depth)]
        while stack:
            fit, own, terms, left = stack.pop()
            best = (1e-3, None)
            if left and len(fit) >= 2 * LEAF:
                G, H = g[fit].sum(), h[fit].sum()
                base = G * G / (H + 1)
                for j, c in enumerate(cuts):
                    if not len(c):
                        continue
                    b = binned[fit, j]
                    n = np.bincount(b, minlength=len(c) + 1).cumsum()[:-1]
                    gl, hl = np.bincount(b, g[fit], len(c) + 1).cumsum()[:-1], np.bincount(b, h[fit], len(c) + 1).cumsum()[:-1]
                    gain = np.where((n >= LEAF) & (len(fit) - n >= LEAF), gl**2 / (hl + 1) + (G - gl) ** 2 / (H - hl + 1) - base, 0)
                    if gain.max() > best[0]:
                        best = (gain.max(), (j, int(gain.argmax())))
            if best[1] is None:
                margin[own] += 0.3 * g[fit].sum() / (h[fit].sum() + 1)
                continue
            j, k = best[1]
            for above in (False, True):
                path = [*terms, (j, above, float(cuts[j][k]))]
                rules.setdefault(simplified(path))
                stack.append((fit[(binned[fit, j] > k) == above], own[(binned[own, j] > k) == above], path, left - 1))
    return list(rules)


def lasso(z: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 400) -> tuple[float, np.ndarray]:
    """Logistic regression with an l1 penalty by accelerated proximal steps; the bias is not penalised."""
    n = len(y)
    a = np.c_[np.ones(n), z]
    # the largest eigenvalue of the Gram matrix by power steps bounds the curvature
    v = np.ones(a.shape[1])
    for _ in range(30):
        v = a.T @ (a @ v)
        v /= np.linalg.norm(v) or 1
    step = 4 * n / max(1e-9, float(v @ (a.T @ (a @ v))))
    w = np.zeros(a.shape[1])
    w[0] = np.log(y.mean() / (1 - y.mean()))
    u, t = w.copy(), 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(a @ u).clip(-30, 30)))
        new = u - step * (a.T @ (p - y)) / n
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - step * penalty, 0)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        u, w, t = new + (t - 1) / t_new * (new - w), new, t_new
    return float(w[0]), w[1:]


class Model:
    """Rules with weights; ``score`` compiles them into a column expression."""

    def __init__(self, bias: float, rules: list[tuple[Rule, float]]):
        self.bias, self.rules = bias, rules

    def margins(self, x: np.ndarray) -> np.ndarray:
        return self.bias + sum((w * r.holds(x) for r, w in self.rules), np.zeros(len(x)))

    def score(self, struct: str) -> Column:
        terms = [F.when(r.column(struct), F.lit(w)).otherwise(F.lit(0.0)) for r, w in self.rules] or [F.lit(0.0)]
        while len(terms) > 1:  # a balanced sum
            terms = [terms[i] + terms[i + 1] if i + 1 < len(terms) else terms[i] for i in range(0, len(terms), 2)]
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-(terms[0] + F.lit(self.bias))))


def fit(x: np.ndarray, y: np.ndarray, most: int = RULES) -> Model:
    if not len(y) or y.min() == y.max():
        p = (y.sum() + 1) / (len(y) + 2)
        return Model(float(np.log(p / (1 - p))), [])
    rules = grow(x, y)
    z = np.stack([r.holds(x) for r in rules], 1).astype(np.float64) if rules else np.zeros((len(y), 0))
    _, first = np.unique(z, axis=1, return_index=True)
    rules, z = [rules[i] for i in sorted(first)], z[:, sorted(first)]
    spread = z.std(0)
    keep = spread > 0
    rules, z, spread = [r for r, k in zip(rules, keep) if k], z[:, keep], spread[keep]
    if not rules:
        p = y.mean()
        return Model(float(np.log(p / (1 - p))), [])
    inner = np.arange(len(y)) % 5 == 0
    best = None
    for penalty in (0.03, 0.01, 0.003, 0.001, 0.0003):
        b, w = lasso(z[~inner] / spread, y[~inner], penalty)
        m = b + (z[inner] / spread) @ w
        loss = np.logaddexp(0, -np.where(y[inner] > 0, m, -m)).mean()
        if (w != 0).sum() <= most and (best is None or loss < best[0] * 0.999):
            best = (loss, penalty)
    b, w = lasso(z / spread, y, best[1] if best else 0.03)
    order = np.argsort(-np.abs(w), kind="stable")[:most]
    return Model(b, [(rules[i], float(w[i] / spread[i])) for i in order if w[i] != 0])


def with_statistics(docs: DataFrame, text: str = "text", out: str = "statistics") -> DataFrame:
    ship(docs.sparkSession)

    @F.pandas_udf(", ".join(f"{s} double" for s in STATISTICS))
    def compute(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame(np.asarray([statistics(t) for t in b], np.float64).reshape(-1, len(STATISTICS)), columns=STATISTICS)

    return docs.withColumn(out, compute(F.col(text)))


def train(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "quality", text: str = "text", key: str = "doc_id", most_rows: int = TRAIN_ROWS) -> Model:
    """Fit on labelled documents where ``learn``, a condition on column ``doc_id``, holds."""
    own = labels.select(F.col(key).cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).filter(F.col("label").isNotNull()).filter(learn)
    own = sampled(materialize(own.groupBy("doc_id").agg(F.max("label").alias("label")), "quality-labels"), "doc_id", most_rows)
    texts = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    # at most `most_rows` rows of two numbers are broadcast
    rows = with_statistics(texts.join(F.broadcast(own), "doc_id"), "text", "s").select("doc_id", "label", "s.*").toPandas()
    rows = rows.sort_values(["doc_id", *STATISTICS])
    return fit(rows[STATISTICS].to_numpy(np.float64), rows["label"].to_numpy(np.float64))


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "quality", statistics: str = "statistics") -> DataFrame:
    """``docs`` with the texts' statistics and the double column ``out``."""
    return with_statistics(docs, text, statistics).withColumn(out, model.score(statistics))

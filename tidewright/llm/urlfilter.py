"""URL filtering by fixed rules and mined association rules.

Fixed rules name a host and a path; a rule fits its host and all subdomains where the path starts with its path, and the
longest rule wins. Urls that no rule fits are judged by association rules: Spark's FP-growth mines combinations of url
tokens (labels of the host, words of the path and the names of query fields) that go with blocked urls, among the urls
that a fixed rule labels. Rules below the wanted support or confidence go, and so do rules that a shorter one implies. The
rest are posted under their rarest token in an inverted index; a url looks up its tokens and is blocked when all tokens
of a posted rule are its own.

Defined results: a url that is null or without ``://`` has an empty host and path, no tokens, no rule and verdict allow.
With no labelled or no blocked urls nothing is mined. Of fixed rules of equal length the one last by name wins. Long urls
are read whole. Repeated rows are judged alike; other columns stay as they are,
but for those named like results, which are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship  # noqa: F401  (the executors need no code of ours here)

MIN_SUPPORT = 0.01
MIN_CONFIDENCE = 0.9
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLOCK, ALLOW = "block", "allow"


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


def after_scheme(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(after_scheme(url), r"(?s)^[^/?#]*", 0), _UPPER, _LOWER), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(after_scheme(url), r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens(url: Column, host_: Column, path_: Column) -> Column:
    """Distinct tokens of a url, by kind: host labels, words of the path without numbers, names of query fields."""
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\?([^#]*)", 1)
    kinds = [("h", F.split(host_, r"[.:@]")), ("p", F.split(path_, r"[/.]")), ("q", F.transform(F.split(query, "&"), lambda x: F.split_part(x, F.lit("="), F.lit(1))))]

    def named(kind: str, words: Column) -> Column:
        return F.transform(F.filter(words, lambda w: (w != "") & ~w.rlike(r"^[0-9]+$")), lambda w: F.concat(F.lit(kind + "="), w))

    return F.array_distinct(F.concat(*[named(kind, words) for kind, words in kinds]))


def by_rules(host_: Column, path_: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """The name and the verdict of the longest rule that fits, or null."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):  # later ones win
        fits = ((host_ == r.host) | host_.endswith("." + r.host)) & path_.startswith(r.path)
        name, verdict = F.when(fits, r.name).otherwise(name), F.when(fits, r.verdict).otherwise(verdict)
    return name, verdict


@dataclass
class Mined:
    """Token sets that go with blocked urls."""

    rules: list[tuple[tuple[str, ...], float, float]]  # tokens, confidence, support

    def matched(self, tokens_: Column, rarity: dict[str, int]) -> Column:
        """Whether any rule's tokens are all in ``tokens_``, by an inverted index under each rule's rarest token."""
        postings: dict[str, list[tuple[str, ...]]] = {}
        for rule, _, _ in self.rules:
            postings.setdefault(min(rule, key=lambda t: (rarity.get(t, 0), t)), []).append(rule)
        if not postings:
            return F.lit(False)
        entries = [x for t, rules in sorted(postings.items()) for x in (F.lit(t), F.array(*[F.array(*map(F.lit, r)) for r in rules]))]
        index = F.create_map(*entries)
        return F.exists(tokens_, lambda t: F.coalesce(F.exists(index[t], lambda rule: F.size(F.array_except(rule, tokens_)) == 0), F.lit(False)))


def mine(labelled: DataFrame, tokens_: str = "tokens", verdict: str = "verdict", support: float = MIN_SUPPORT, confidence: float = MIN_CONFIDENCE) -> tuple[Mined, dict[str, int]]:
    """Rules for blocking from rows of tokens and a verdict, and how many rows hold each token of a rule."""
    from pyspark.ml.fpm import FPGrowth

    label = "verdict="
    baskets = labelled.select(F.array_append(F.array_distinct(tokens_), F.concat(F.lit(label), F.col(verdict))).alias("items"))
    if not labelled.filter(F.col(verdict) == BLOCK).take(1):
        return Mined([]), {}
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(baskets)
    found = (
        model.associationRules.filter(F.array_contains("consequent", label + BLOCK))
        .filter(~F.exists("antecedent", lambda t: t.startswith(label)))
        .select(F.sort_array("antecedent").alias("tokens"), "confidence", "support")
        .orderBy(F.size("antecedent"), F.desc("support"), "tokens")
    )
    # shorter ones come first, so that those they imply go; how many are left depends on support alone
    kept: list[tuple[tuple[str, ...], float, float]] = []
    under: dict[str, list[frozenset[str]]] = {}
    for r in found.toLocalIterator():
        own = frozenset(r["tokens"])
        if not any(k <= own for t in own for k in under.get(t, ())):
            kept.append((tuple(r["tokens"]), r["confidence"], r["support"]))
            under.setdefault(r["tokens"][0], []).append(own)
    kept.sort(key=lambda k: (-k[2], k[0]))
    wanted = sorted({t for k, _, _ in kept for t in k})
    one = model.freqItemsets.filter(F.size("items") == 1).select(F.col("items")[0].alias("t"), "freq").filter(F.col("t").isin(wanted)) if wanted else None
    return Mined(kept), {r["t"]: r["freq"] for r in one.collect()} if one is not None else {}


def judge(pages: DataFrame, rules: list[Rule], url: str = "url", support: float = MIN_SUPPORT, confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """``pages`` with host, path, rule, verdict and by_mined (whether the verdict is the mined rules')."""
    rest = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict", "by_mined")]
    own = pages.select(*[F.col(f"`{c}`") for c in rest], host(F.col(url)).alias("host"), path(F.col(url)).alias("path"))
    name, verdict = by_rules(F.col("host"), F.col("path"), rules)
    own = own.withColumns({"rule": name, "verdict": verdict, "__tokens": tokens(F.col(url), F.col("host"), F.col("path"))})
    labelled = own.filter(F.col("verdict").isNotNull()).select(F.col("__tokens").alias("tokens"), "verdict")
    mined, rarity = mine(labelled, support=support, confidence=confidence)
    matched = F.when(mined.matched(F.col("__tokens"), rarity), F.lit(BLOCK)).otherwise(F.lit(ALLOW))
    return own.select(*[F.col(f"`{c}`") for c in rest], "host", "path", "rule", F.coalesce("verdict", matched).alias("verdict"), F.col("rule").isNull().alias("by_mined"))

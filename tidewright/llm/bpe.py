"""Byte-level byte-pair encoding from a public tokenizer file, for counting and for ids."""

from __future__ import annotations

import json
import re
from heapq import heapify, heappop, heappush

# In texts of Latin letters, digits and common signs the class below equal the Unicode classes of the tokenizer's
# pattern, and the standard regular expressions are several times as fast as those with Unicode properties.
_L, _N, _S = r"A-Za-zªµºÀ-ÖØ-öø-ɏ", r"0-9²³¹¼-¾", r"\t-\r \x85\xa0"
_FAST = re.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
_OTHER = re.compile("[^\x00-ɏ‐-‧‰-⁞]")
#: Characters above which a text's pieces are taken one by one, not as a list.
LONG = 1 << 22


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Vocabulary:
    """Merges, byte symbols and special strings of a byte-level BPE tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or spec["model"]["type"] != "BPE" or spec.get("normalizer"):
            raise ValueError("a byte-level BPE tokenizer without a normalizer is needed")
        signs = self._byte_signs()
        number = {s: b for b, s in enumerate(signs)}
        #: (left << 32 | right) -> rank; a merged symbol's number is 256 + rank
        self.rank: dict[int, int] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.rank[number[a] << 32 | number[b]] = rank
            number.setdefault(a + b, 256 + rank)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self._cut = re.compile("|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None

    @staticmethod
    def _byte_signs() -> list[str]:
        """The printable sign that stands for each byte: itself where printable, else the next free one from 256 on."""
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(plain)]
        out = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
        return [out[b] for b in range(256)]

    def merges(self, data: bytes) -> int:
        """How many merges byte-pair encoding makes in ``data``.

        Symbols form a doubly linked list; a heap holds the rank of each adjacent pair with the place of its left
        symbol. Entries whose pair has changed since are skipped when popped.
        """
        n = len(data)
        if n < 2:
            return 0
        rank, symbol = self.rank, list(data)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            r = rank.get(symbol[i] << 32 | symbol[i + 1])
            if r is not None:
                heap.append(r << 32 | i)
        heapify(heap)
        made = 0
        while heap:
            r, i = divmod(heappop(heap), 1 << 32)
            j = after[i]
            if symbol[i] < 0 or j >= n or rank.get(symbol[i] << 32 | symbol[j]) != r:
                continue
            symbol[i], symbol[j] = 256 + r, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (x := rank.get(symbol[i] << 32 | symbol[k])) is not None:
                    heappush(heap, x << 32 | i)
            k = before[i]
            if k >= 0 and (x := rank.get(symbol[k] << 32 | symbol[i])) is not None:
                heappush(heap, x << 32 | k)
            made += 1
        return made

    def parts(self, text: str) -> tuple[list[str], int]:
        """The stretches of ``text`` between special strings, and how many of those it holds."""
        if not self._cut or not any(s in text for s in self.special):
            return [text], 0
        found = self._cut.findall(text)
        return self._cut.split(text), len(found)


_SLOW = None


def _slow():
    global _SLOW
    if _SLOW is None:
        import public_tokenizers
        import regex

        _SLOW = regex.compile(public_tokenizers.PATTERN)
    return _SLOW


def common(text: str) -> bool:
    """Whether the fast pattern holds for ``text``."""
    return _OTHER.search(text) is None


def words(text: str):
    """What the tokenizer merges within: the matches of its pattern, in order."""
    pattern = _FAST if common(text) else _slow()
    if len(text) > LONG:
        return (m.group() for m in pattern.finditer(text))
    return pattern.findall(text)


class Bounded(dict):
    """A memo that is emptied when it holds ``most`` entries; ``make`` computes what is missing."""

    def __init__(self, make, most: int = 400_000, longest: int = 64):
        super().__init__()
        self.make, self.most, self.longest = make, most, longest

    def __missing__(self, key):
        value = self.make(key)
        if len(key) <= self.longest:
            if len(self) >= self.most:
                self.clear()
            self[key] = value
        return value

"""Field names: cleaning policies, collision suffixes, versioned names."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass

POLICIES = ("lower_alpha", "lower_snake", "preserve")
#: Generated columns, in the order in which they end a row.
ETL_COLUMNS = ("schema_registry", "schema_drifts", "source_file", "ingestion_timestamp")
SHORTEST_SUFFIX, LONGEST_SUFFIX = 6, 16

_VERSIONED = re.compile(r"(?s)(.+)_v([0-9]+)_([a-z]+(?:_[a-z]+)*)\Z")
_NOT_ALPHA = re.compile(rb"[^a-z]")
_NOT_SNAKE = re.compile(rb"[^a-z0-9]+")


def fnv1a(data: bytes) -> int:
    """The 64-bit FNV-1a hash."""
    h = 0xCBF29CE484222325
    for b in data:
        h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return h


def clean(name: str, policy: str, keep: str | None = None) -> str:
    """``name`` under a policy; ``keep`` is a name that no policy rewrites."""
    if policy == "preserve" or name == keep:
        return name
    lowered = bytes(b + 32 if 65 <= b <= 90 else b for b in name.encode("utf-8", "surrogatepass"))
    if policy == "lower_alpha":
        return _NOT_ALPHA.sub(b"", lowered).decode() or "field"
    out = _NOT_SNAKE.sub(b"_", lowered).strip(b"_").decode() or "field"
    return "field_" + out if out[0].isdigit() else out


def suffixed(name: str, base: str, length: int) -> str:
    """``base`` followed by letters that the hash of the source ``name`` gives, least significant first."""
    letters, h = "", fnv1a(name.encode("utf-8", "surrogatepass"))
    while len(letters) < length:
        h, digit = divmod(h, 26)
        letters += chr(97 + digit)
        if not h:
            h = fnv1a(letters.encode())
    return base + letters


def clean_siblings(names: Sequence[str], policy: str, keep: str | None = None) -> list[str]:
    """Clean the names of one level; every member of a group that collides gets a suffix of its own."""
    if policy == "preserve":
        return list(names)
    bases = [clean(n, policy, keep) for n in names]
    shared = {b for b, n in Counter(bases).items() if n > 1}
    if not shared:
        return bases
    out: list[str] = [""] * len(names)
    taken: set[str] = set()
    for i in sorted(range(len(names)), key=lambda i: (names[i].encode("utf-8", "surrogatepass"), i)):
        tries = [suffixed(names[i], bases[i], n) for n in range(SHORTEST_SUFFIX, LONGEST_SUFFIX + 1)]
        if bases[i] not in shared:
            tries.insert(0, bases[i])
        pick = next((t for t in tries if t not in taken), tries[-1])
        while pick in taken:
            pick += "z"
        taken.add(pick)
        out[i] = pick
    return out


@dataclass(frozen=True)
class Version:
    base: str
    number: int
    semantic: str


def version_of(name: str) -> Version | None:
    """The parts of a versioned name such as ``amount_v2_string``; the rightmost marker counts."""
    found = _VERSIONED.match(name)
    if len(name) < 7 or not found or "_v" in found[3] or int(found[2]) < 2 or int(found[2]) >= 1 << 31:
        return None
    return Version(found[1], int(found[2]), found[3])


def versioned(base: str, number: int, semantic: str) -> str:
    return f"{base}_v{number}_{semantic}"


def family(name: str) -> str:
    """The name that all versions of a field share."""
    found = version_of(name)
    return found.base if found else name


def unflattened(name: str) -> str | None:
    """The source name behind an output name of a flattened value."""
    for tail in ("_flattened", "flattened"):
        if name.endswith(tail):
            return name[: -len(tail)]
    return None

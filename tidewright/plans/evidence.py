"""Schema evidence over all rows, the same for every partitioning.

A worker turns each value into a *kind tree*: a scalar becomes its kind, an array the distinct trees of its elements, an
object the trees of its fields; values without evidence (null, empty containers) vanish. Per block of input and per root
key it sends trees in the order of their first row and drops repeats. Whether a value counts as list, struct or scalar
depends on the shapes seen before it, so a repeat may be dropped only while no new shape has come up under its key; each
worker forgets what it has sent whenever a row brings one. The driver then replays the trees in input order through one
``Evidence``, which gives what reading all rows in sequence would give.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

from ..functions import names
from ..functions.scalars import BITS, Parsers, resolve
from ..functions.types import LField, LType, list_of, scalar, struct
from ..options import Options

# A kind tree is a kind's bit (int), ("L", trees) or ("S", ((key, tree), ...)).


def packed(t) -> str:
    """A tree as a flat JSON list, in prefix order: a bit, or a container's kind, its size and its parts."""
    out, todo = [], [t]
    while todo:
        x = todo.pop()
        if isinstance(x, tuple):
            kind, inner = x
            out += (kind, len(inner))
            todo += reversed(inner if kind == "L" else [part for pair in inner for part in pair])
        else:
            out.append(x)
    return json.dumps(out, separators=(",", ":"))


def unpacked(text: str):
    """The tree that ``packed`` wrote; nothing is evaluated, and no depth is too large."""
    tokens = iter(json.loads(text))
    levels = [("L", 1, [])]  # kind, number of parts, parts so far
    for x in tokens:
        kind, _, parts = levels[-1]
        if isinstance(x, str) and not (kind == "S" and len(parts) % 2 == 0):
            n = next(tokens)
            levels.append((x, n if x == "L" else 2 * n, []))
            continue
        parts.append(x)
        while len(levels) > 1 and len(levels[-1][2]) == levels[-1][1]:
            kind, _, parts = levels.pop()
            levels[-1][2].append((kind, tuple(parts) if kind == "L" else tuple(zip(parts[::2], parts[1::2]))))
    return levels[0][2][0]


def _deepest(v, arrow: int, parquet: int, o: Options) -> bool:
    """Whether ``v``, standing at these depths, holds a container below the limits."""
    todo = [(v, arrow, parquet)]
    while todo:
        x, arrow, parquet = todo.pop()
        arrow, parquet = arrow + 1, parquet + isinstance(x, dict)
        if arrow > o.arrow_max_depth or parquet > o.parquet_max_depth:
            return True
        todo += [(y, arrow, parquet) for y in (x.values() if isinstance(x, dict) else x) if isinstance(y, (list, dict))]
    return False


def flattens(v, arrow: int, parquet: int, o: Options) -> bool:
    """Whether a field's value goes to its ``_flattened`` text instead."""
    return isinstance(v, (list, dict)) and _deepest(v, arrow, parquet, o)


def tree(v, parsers: Parsers, o: Options, arrow: int = 0, parquet: int = 0):
    """The kind tree of a value, or None without evidence. The depths are those of the value's parent."""
    if v is None:
        return None
    if isinstance(v, list):
        seen = dict.fromkeys(t for x in v if (t := tree(x, parsers, o, arrow + 1, parquet)) is not None)
        return ("L", tuple(seen)) if seen else None
    if isinstance(v, dict):
        fields = fields_of(v, parsers, o, arrow + 1, parquet + 1)
        return ("S", fields) if fields else None
    return BITS[parsers.kind_of(v)]


def fields_of(row: dict, parsers: Parsers, o: Options, arrow: int = 0, parquet: int = 0) -> tuple:
    """The (key, tree) pairs of an object whose own depths these are."""
    out = []
    for k, v in row.items():
        if isinstance(v, (list, dict)):
            if not v:
                continue
            if _deepest(v, arrow, parquet, o):
                out.append((k + "_flattened", BITS["utf8"]))
                continue
        if (t := tree(v, parsers, o, arrow, parquet)) is not None:
            out.append((k, t))
    return tuple(out)


@dataclass
class Node:
    """What is known of one path: shapes seen anywhere, and evidence as it was counted."""

    shapes: set[str] = field(default_factory=set)
    counted: set[str] = field(default_factory=set)
    mask: int = 0
    evident: bool = False
    item: Node | None = None
    fields: dict[str, Node] = field(default_factory=dict)

    def child(self, key: str) -> Node:
        return self.fields.setdefault(key, Node())

    def element(self) -> Node:
        self.item = self.item or Node()
        return self.item

    def shape(self, t) -> bool:
        """Note the containers of a tree; whether any of them is new at its path."""
        if isinstance(t, int):
            return False
        kind, inner = t
        new = kind not in self.shapes
        self.shapes.add(kind)
        if kind == "L":
            return any([self.element().shape(x) for x in inner]) or new
        return any([self.child(k).shape(x) for k, x in inner]) or new

    def count(self, t, default_key: str) -> None:
        """Add a tree's evidence under the shapes seen so far: a list takes in anything, then a struct."""
        self.evident = True
        kind, inner = (None, None) if isinstance(t, int) else t
        way = "L" if "L" in self.shapes else "S" if "S" in self.shapes else kind
        if way == "L":
            self.counted.add("L")
            for x in inner if kind == "L" else (t,):
                self.element().count(x, default_key)
        elif way == "S":
            self.counted.add("S")
            for k, x in inner if kind == "S" else ((default_key, t),):
                self.child(k).count(x, default_key)
        else:
            self.mask |= t

    def type(self, o: Options) -> LType:
        if "L" in self.counted:
            if self.item is None or "L" in self.item.counted:  # a list of lists is one of texts
                return list_of(scalar("utf8"))
            return list_of(self.item.type(o))
        if "S" in self.counted:
            return struct(named(self.fields, o))
        return scalar(resolve(self.mask))


def named(nodes: dict[str, Node], o: Options) -> list[LField]:
    """The evident fields of one level under their clean names."""
    live = {k: n for k, n in nodes.items() if n.evident}
    return [LField(name, n.type(o)) for name, n in zip(names.clean_siblings(list(live), o.field_name_policy, o.scalar_object_key), live.values())]


class Evidence:
    """The sequential fold over rows' trees."""

    def __init__(self, o: Options):
        self.o, self.root = o, Node()

    def add(self, pairs: Iterable[tuple[str, object]]) -> bool:
        """Add one row's (key, tree) pairs; whether it brought a new shape."""
        pairs = list(pairs)
        new = [self.root.child(k).shape(t) for k, t in pairs]
        for k, t in pairs:
            self.root.child(k).count(t, self.o.scalar_object_key)
        return any(new)

    def fields(self) -> list[LField]:
        for k, n in self.root.fields.items():
            if n.evident and k in names.ETL_COLUMNS:
                raise ValueError(f"the source field {k!r} has the name of a generated column")
        return named(self.root.fields, self.o)


def distinct_trees(rows: Iterable[dict], parsers: Parsers, o: Options) -> Iterator[tuple[int, str, object]]:
    """(row number, root key, tree) of one block's rows: first occurrences, anew after each new shape of a key."""
    shapes: dict[str, Node] = {}
    sent: dict[str, set] = {}
    for i, row in enumerate(rows):
        for k, t in fields_of(row, parsers, o):
            known = sent.get(k)
            if known is None:
                known, shapes[k] = sent.setdefault(k, set()), Node()
            if t in known:
                continue
            if not isinstance(t, int) and shapes[k].shape(t):
                known.clear()
            known.add(t)
            yield i, k, t

"""Turning source values into rows of a planned schema."""

from __future__ import annotations

import math
from collections.abc import Callable

from ..errors import IntegrityError
from ..functions import names
from ..functions.scalars import INT_HIGH, INT_LOW, Parsers, text_of
from ..functions.types import LField, LType
from ..options import Options


class Mismatch(Exception):
    """A value does not fit its planned field."""


def _is_int(v) -> bool:
    return isinstance(v, int) and not isinstance(v, bool)


class Level:
    """The fields of one struct level: which source key feeds which field, and how values become theirs."""

    def __init__(self, fields: tuple[LField, ...], o: Options, parsers: Parsers, counts: dict[str, int]):
        self.o, self.parsers, self.counts, self.fields = o, parsers, counts, fields
        self.convert: list[Callable] = [self._converter(f) for f in fields]
        self.by_name: dict[str, list[int]] = {}
        families: dict[str, list[int]] = {}
        for i, f in enumerate(fields):
            families.setdefault(names.family(f.name), []).append(i)
        self.siblings: list[list[int] | None] = [s if len(s := families[names.family(f.name)]) > 1 else None for f in fields]
        for i, f in enumerate(fields):
            for n in dict.fromkeys((f.name, names.family(f.name), names.unflattened(f.name))):
                if n:
                    self.by_name.setdefault(n, []).append(i)
        self._feeds: dict[str, tuple[int, ...]] = {}

    def feeds(self, key: str) -> tuple[int, ...]:
        """The fields that a source key feeds."""
        got = self._feeds.get(key)
        if got is None:
            base = names.clean(key, self.o.field_name_policy, self.o.scalar_object_key)
            tries = [key, base]
            if self.o.field_name_policy != "preserve" and key not in self.by_name and base not in self.by_name:
                tries += [names.suffixed(key, base, n) for n in range(names.SHORTEST_SUFFIX, names.LONGEST_SUFFIX + 1)]
            hit = next((n for n in tries if n in self.by_name), None)
            # all versions of the field, and its flattened text
            got = tuple(dict.fromkeys(j for i in self.by_name.get(hit, ()) for j in (i, *(self.siblings[i] or ())))) if hit else ()
            if len(self._feeds) < 100_000:
                self._feeds[key] = got
        return got

    def row(self, source: dict, root: bool = False) -> list:
        """The values of all fields for one object."""
        out: list = [None] * len(self.fields)
        fed = set()
        strict = root and self.o.schema_mode == "strict"
        for k, v in source.items():
            if isinstance(v, (list, dict)) and not v:
                continue
            feeds = self.feeds(k)
            if not feeds and strict:
                raise IntegrityError("strict mode: a row has a field that the contract lacks")
            for i in feeds:
                if i not in fed:
                    fed.add(i)
                    out[i] = v
        for i in fed:
            v = out[i]
            if v is None:
                continue
            siblings = self.siblings[i]
            if siblings is None:
                out[i] = self.convert[i](v)
                continue
        routed = {i: v for i in fed if self.siblings[i] and (v := out[i]) is not None}
        for i, v in routed.items():
            best = max(self.siblings[i], key=lambda j: (self.fit(self.fields[j].type, v), j))
            try:
                out[i] = self.convert[i](v) if best == i else None
            except Mismatch:
                out[i] = None
        return out

    def fit(self, t: LType, v) -> int:
        """How directly a value fits a version of a field. The scores that routing compares."""
        if t.kind == "list":
            return 400 if isinstance(v, list) else 350
        if t.kind == "struct":
            return 300 if isinstance(v, dict) else 50
        if isinstance(v, (list, dict)):
            return 25
        if t.kind == "utf8":
            return 300 if isinstance(v, str) else 150
        if isinstance(v, str):
            parsed = getattr(self.parsers, t.kind, lambda s: None)(v) is not None
            return 50 if not parsed else 340 if t.kind == "float64" and self.parsers.int64(v) is not None else 350
        if t.kind == "bool":
            return 400 if isinstance(v, bool) else 50
        if t.kind == "int64":
            return 400 if _is_int(v) else 50
        if t.kind == "float64":
            return 400 if isinstance(v, float) else 375 if _is_int(v) else 50
        return 375 if _is_int(v) else 50

    def _converter(self, f: LField) -> Callable:
        return self._of(f.type, f.name)

    def _of(self, t: LType, name: str) -> Callable:
        if t.kind == "list":
            item = self._of(t.item or LType("utf8"), name)

            def as_list(v):
                if isinstance(v, list):
                    return [None if x is None or (isinstance(x, (list, dict)) and not x) else item(x) for x in v]
                self.counts["scalar_wrappings"] += 1
                return [item(v)]

            return as_list
        if t.kind == "struct":
            level = Level(t.fields, self.o, self.parsers, self.counts)
            fields = [f.name for f in t.fields]
            key = self.o.scalar_object_key

            def as_struct(v):
                if not isinstance(v, dict):
                    if not level.feeds(key):
                        raise Mismatch(f"expected an object for field {name!r}")
                    self.counts["scalar_wrappings"] += 1
                    v = {key: v}
                return dict(zip(fields, level.row(v)))

            return as_struct
        return {"utf8": text_of, "null": text_of}.get(t.kind) or getattr(self, "_" + t.kind)(name)

    def _bool(self, name: str) -> Callable:
        def convert(v):
            out = v if isinstance(v, bool) else self.parsers.bool(v) if isinstance(v, str) else None
            if out is None:
                raise Mismatch(f"expected a boolean for field {name!r}")
            return out

        return convert

    def _int64(self, name: str) -> Callable:
        def convert(v):
            out = self.parsers.int64(v) if isinstance(v, str) else v if _is_int(v) and INT_LOW <= v <= INT_HIGH else None
            if out is None:
                raise Mismatch(f"expected an integer for field {name!r}")
            return out

        return convert

    def _float64(self, name: str) -> Callable:
        def convert(v):
            out = self.parsers.float64(v) if isinstance(v, str) else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else None
            if out is None or not math.isfinite(out):
                raise Mismatch(f"expected a number for field {name!r}")
            return out

        return convert

    def _timestamp(self, name: str) -> Callable:
        def convert(v):
            out = self.parsers.timestamp(v) if isinstance(v, str) else v * self.parsers.scale if _is_int(v) else None
            if out is None or not INT_LOW <= out <= INT_HIGH:
                raise Mismatch(f"expected a timestamp for field {name!r}")
            return out

        return convert

    def _small(self, name: str, kind: str, factor: int) -> Callable:
        parse = getattr(self.parsers, kind)

        def convert(v):
            out = parse(v) if isinstance(v, str) else v if _is_int(v) and -(1 << 31) <= v < 1 << 31 else None
            if out is None:
                raise Mismatch(f"expected a {kind[:-2]} for field {name!r}")
            return out * factor

        return convert

    def _date32(self, name: str) -> Callable:
        return self._small(name, "date32", 1)

    def _time32(self, name: str) -> Callable:
        return self._small(name, "time32", 1_000_000_000)

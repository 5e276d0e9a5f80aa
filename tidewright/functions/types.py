"""Logical types: what evidence, registries and plans speak of, with their Spark and Arrow forms."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import types as T

SCALARS = {
    # kind: (text, semantic suffix, Spark type, Arrow type)
    "null": ("null", "null", None, None),
    "bool": ("bool", "boolean", T.BooleanType(), pa.bool_()),
    "int64": ("int64", "integer", T.LongType(), pa.int64()),
    "float64": ("double", "float", T.DoubleType(), pa.float64()),
    "utf8": ("string", "string", T.StringType(), pa.string()),
    "timestamp": ("timestamp[ns]", "timestamp", T.TimestampNTZType(), pa.timestamp("us")),
    "date32": ("date32[day]", "date", T.DateType(), pa.date32()),
    "time32": ("time32[s]", "time", T.TimeType(0), pa.time64("ns")),
}


@dataclass(frozen=True)
class LType:
    """A logical type: a scalar kind, ``struct`` with fields, or ``list`` with an item."""

    kind: str
    fields: tuple[LField, ...] = ()
    item: LType | None = None

    @property
    def scalar(self) -> bool:
        return self.kind in SCALARS

    def __str__(self) -> str:
        if self.kind == "list":
            return f"list<item: {self.item or 'null'}>"
        if self.kind == "struct":
            return "struct<" + ", ".join(f"{f.name}: {f.type}" for f in self.fields) + ">"
        return SCALARS[self.kind][0]

    @property
    def semantic(self) -> str:
        """The word that a versioned name ends with."""
        if self.kind == "list":
            return (self.item.semantic if self.item else "null") + "_array"
        return "struct" if self.kind == "struct" else SCALARS[self.kind][1]

    def spark(self) -> T.DataType:
        if self.kind == "struct":
            return struct_of(self.fields)
        if self.kind == "list":
            return T.ArrayType(self.item.spark() if self.item else T.StringType(), True)
        return SCALARS[self.kind][2] or T.StringType()

    def arrow(self) -> pa.DataType:
        if self.kind == "struct":
            return pa.struct([pa.field(f.name, f.type.arrow()) for f in self.fields])
        if self.kind == "list":
            return pa.list_(self.item.arrow() if self.item else pa.string())
        return SCALARS[self.kind][3] or pa.string()


@dataclass(frozen=True)
class LField:
    name: str
    type: LType


def struct_of(fields: Iterable[LField]) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.type.spark(), True) for f in fields])


def scalar(kind: str) -> LType:
    return LType(kind)


def list_of(item: LType | None) -> LType:
    return LType("list", item=item)


def struct(fields: Iterable[LField]) -> LType:
    return LType("struct", tuple(fields))


def ordered(fields: Iterable[LField]) -> tuple[LField, ...]:
    """Fields in byte order of their names, at every level."""
    return tuple(sorted((LField(f.name, _ordered(f.type)) for f in fields), key=lambda f: f.name.encode("utf-8", "surrogatepass")))


def _ordered(t: LType) -> LType:
    if t.kind == "struct":
        return replace(t, fields=ordered(t.fields))
    if t.kind == "list" and t.item:
        return replace(t, item=_ordered(t.item))
    return t


def from_spark(t: T.DataType) -> LType | None:
    """The logical type of a typed input column; None for a column of nulls."""
    if isinstance(t, T.NullType):
        return None
    if isinstance(t, T.BooleanType):
        return scalar("bool")
    if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return scalar("int64")
    if isinstance(t, (T.FloatType, T.DoubleType)):
        return scalar("float64")
    if isinstance(t, T.DateType):
        return scalar("date32")
    if isinstance(t, (T.TimestampType, T.TimestampNTZType)):
        return scalar("timestamp")
    if isinstance(t, T.TimeType):
        return scalar("time32") if t.precision == 0 else scalar("utf8")
    if isinstance(t, (T.StringType, T.CharType, T.VarcharType, T.BinaryType, T.DecimalType, T.DayTimeIntervalType, T.YearMonthIntervalType, T.CalendarIntervalType)):
        return scalar("utf8")
    if isinstance(t, T.StructType):
        return struct(LField(f.name, x) for f in t.fields if (x := from_spark(f.dataType)))
    if isinstance(t, T.ArrayType):
        return list_of(from_spark(t.elementType))
    if isinstance(t, T.MapType):
        return list_of(struct([LField("key", from_spark(t.keyType) or scalar("utf8")), LField("value", from_spark(t.valueType) or scalar("utf8"))]))
    raise TypeError(f"columns of type {t.simpleString()} are not supported")


def to_json(t: LType) -> dict:
    """The JSON form of a type in a registry."""
    if t.kind == "struct":
        return {"type": "struct", "fields": [{"name": f.name, "nullable": True, **to_json(f.type)} for f in t.fields]}
    if t.kind == "list":
        return {"type": "list", "item": to_json(t.item) if t.item else {"type": "null"}}
    return {"type": SCALARS[t.kind][0]}


_BY_TEXT = {v[0]: k for k, v in SCALARS.items()}


def from_json(d: dict) -> LType:
    kind = d["type"]
    if kind == "struct":
        return struct(LField(f["name"], from_json(f)) for f in d["fields"])
    if kind == "list":
        return list_of(from_json(d["item"]))
    return scalar(_BY_TEXT[kind])

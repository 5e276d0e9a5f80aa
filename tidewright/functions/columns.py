"""Column twins of the scalar parsers, and casts of typed columns to logical types. All of it stays in the JVM but for the
17-digit text of floats, which Spark has no function for."""

from __future__ import annotations

import math
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..options import Options
from . import names
from .types import LField, LType, from_spark

_SPACE = " \t\n\r\x0b\x0c"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _twice(parse, c: Column) -> Column:
    return F.coalesce(parse(c), parse(F.btrim(c, F.lit(_SPACE))))


def _escaped(s: str) -> str:
    return "\\" + s if not s.isalnum() else s


def parse_bool(c: Column, o: Options) -> Column:
    def parse(x):
        low = F.translate(x, _UPPER, _LOWER)
        fold = lambda ts: [t.translate(str.maketrans(_UPPER, _LOWER)) for t in ts]
        return F.when(low.isin(fold(o.true_tokens)), True).when(low.isin(fold(o.false_tokens)), False)

    return _twice(parse, c) if o.true_tokens or o.false_tokens else F.lit(None).cast("boolean")


def parse_int64(c: Column, o: Options) -> Column:
    return _twice(lambda x: F.when(x.rlike(r"\A-?[0-9]+\z"), x.try_cast("bigint")), c) if o.parse_integers else F.lit(None).cast("bigint")


def parse_float64(c: Column, o: Options) -> Column:
    d, t = _escaped(o.parse_float_decimal_separator), _escaped(o.parse_float_thousands_separator)
    pattern = rf"\A[+-]?(?:(?:[0-9]+|[0-9]{{1,3}}(?:{t}[0-9]{{3}})+)(?:{d}[0-9]*)?|{d}[0-9]+)(?:[eE][+-]?[0-9]+)?\z"

    def parse(x):
        plain = F.replace(F.replace(x, F.lit(o.parse_float_thousands_separator), F.lit("")), F.lit(o.parse_float_decimal_separator), F.lit("."))
        v = F.when(x.rlike(pattern), plain.try_cast("double"))
        return F.when(F.abs(v) < float("inf"), v)

    return _twice(parse, c) if o.parse_floats else F.lit(None).cast("double")


def _date(x: Column, pattern: str) -> Column:
    y, m, d = (F.regexp_extract(x, pattern, i).try_cast("int") for i in (1, 2, 3))
    return F.when(x.rlike(pattern), F.concat_ws("-", F.lpad(y.cast("string"), 4, "0"), F.lpad(m.cast("string"), 2, "0"), F.lpad(d.cast("string"), 2, "0")).try_cast("date"))


def parse_date32(c: Column, o: Options) -> Column:
    patterns = [r"\A([0-9]{4})-([0-9]{2})-([0-9]{2})\z"] * o.parse_iso_dates + [rf"\A(?:{p})\z" for p in o.custom_date_patterns]
    return F.coalesce(*[_twice(lambda x, p=p: _date(x, p), c) for p in patterns]) if patterns else F.lit(None).cast("date")


def _seconds(x: Column, pattern: str) -> Column:
    h, m, s = (F.regexp_extract(x, pattern, i).try_cast("int") for i in (1, 2, 3))
    return F.when(x.rlike(pattern) & (h < 24) & (m < 60) & (s < 60), h * 3600 + m * 60 + s)


def parse_time32(c: Column, o: Options) -> Column:
    """Seconds of the day."""
    patterns = [r"\A([0-9]{2}):([0-9]{2}):([0-9]{2})\z"] * o.parse_iso_times + [rf"\A(?:{p})\z" for p in o.custom_time_patterns]
    return F.coalesce(*[_twice(lambda x, p=p: _seconds(x, p), c) for p in patterns]) if patterns else F.lit(None).cast("int")


_ISO_STAMP = r"\A([0-9]{4})-([0-9]{2})-([0-9]{2})[T ]([0-9]{2}):([0-9]{2}):([0-9]{2})(?:\.([0-9]+))?(Z|[+-][0-9]{2}:[0-9]{2})?\z"
_EPOCH = "timestamp_ntz'1970-01-01'"


def _stamp(x: Column, pattern: str, o: Options, groups: int) -> Column:
    part = lambda i: F.regexp_extract(x, pattern, i)
    day = F.concat_ws("-", part(1), F.lpad(part(2), 2, "0"), F.lpad(part(3), 2, "0")).try_cast("date")
    h, m, s = (part(i).try_cast("bigint") for i in (4, 5, 6))
    nanos9 = F.rpad(F.substring(part(7), 1, 9), 9, "0").try_cast("bigint") if groups > 6 else F.lit(0)
    zone = F.replace(part(8), F.lit(":"), F.lit("")) if groups > 7 else F.lit("")
    shift = F.when(zone.rlike("^[+-][0-9]{4}$"), F.when(zone.startswith("+"), 1).otherwise(-1) * (F.substring(zone, 2, 2).try_cast("bigint") * 3600 + F.substring(zone, 4, 2).try_cast("bigint") * 60)).otherwise(F.lit(0))
    zone_ok = zone.isin("", "Z", "z") | zone.rlike("^[+-](?:[01][0-9]|2[0-3])[0-5][0-9]$")
    seconds = F.unix_date(day).cast("bigint") * 86400 + h * 3600 + m * 60 + s - shift
    ok = x.rlike(pattern) & (h < 24) & (m < 60) & (s < 60) & zone_ok & seconds.between(-9223372036, 9223372035)
    unit = 1_000_000 if o.timestamp_precision == "TIMESTAMP_MILLIS" else 1_000
    fine = nanos9 % unit
    # the whole value is cut toward zero, so values before the epoch go up
    micros = seconds * 1_000_000 + F.floor((nanos9 - fine) / 1000).cast("bigint") + F.when((seconds < 0) & (fine > 0), unit // 1000).otherwise(0)
    return F.when(ok, F.timestamp_add("MICROSECOND", micros, F.expr(_EPOCH)))


def parse_timestamp(c: Column, o: Options) -> Column:
    import re

    tries = [(_ISO_STAMP, 8)] * o.parse_iso_timestamps + [(rf"\A(?:{p})\z", re.compile(p).groups) for p in o.custom_timestamp_patterns]
    return F.coalesce(*[_twice(lambda x, p=p, g=g: _stamp(x, p, o, g), c) for p, g in tries]) if tries else F.lit(None).cast("timestamp_ntz")


def kind_mask(c: Column, o: Options) -> Column:
    """The evidence bit of a text value: the first parser that takes it, else text."""
    tries = ((1, parse_bool), (16, parse_timestamp), (32, parse_date32), (64, parse_time32), (2, parse_int64), (4, parse_float64))
    out = reduce(lambda rest, t: F.when(t[1](c, o).isNotNull(), F.lit(t[0])).otherwise(rest), reversed(tries), F.lit(8))
    return F.when(c.isNull(), F.lit(0)).otherwise(out)


def float_text(c: Column) -> Column:
    """Doubles with 17 significant digits; null where not finite."""

    def written(v: pd.Series) -> pd.Series:
        return v.map(lambda x: None if x is None or not math.isfinite(x) else "%.17g" % x)

    return F.pandas_udf(written, T.StringType())(c)


def text(c: Column, t: T.DataType) -> Column:
    """A typed column as text."""
    if isinstance(t, T.StringType):
        return c
    if isinstance(t, (T.FloatType, T.DoubleType)):
        return float_text(c.cast("double"))
    if isinstance(t, T.BinaryType):
        return F.base64(c)
    if isinstance(t, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    if isinstance(t, (T.StructType, T.ArrayType, T.MapType)):
        return F.to_json(F.map_entries(c) if isinstance(t, T.MapType) else c, {"ignoreNullFields": "false"})
    return c.cast("string")


def _nothing(t: LType) -> Column:
    return F.lit(None).cast(t.spark())


def adapt(c: Column, t: T.DataType, to: LType, o: Options) -> tuple[Column, Column | None]:
    """``c`` of Spark type ``t`` as ``to``, and a condition that says where it does not fit (None: never)."""
    own = from_spark(t)
    if to.kind == "list":
        if isinstance(t, (T.ArrayType, T.MapType)):
            array, inner = (F.map_entries(c), T.StructType([T.StructField("key", t.keyType), T.StructField("value", t.valueType)])) if isinstance(t, T.MapType) else (c, t.elementType)
            value = F.transform(array, lambda x: adapt(x, inner, to.item, o)[0])
            fails = adapt(F.lit(None).cast(inner), inner, to.item, o)[1] is not None
            bad = F.coalesce(F.exists(array, lambda x: adapt(x, inner, to.item, o)[1]), F.lit(False)) if fails else None
            return F.when(F.size(array) > 0, value), bad
        value, bad = adapt(c, t, to.item, o)
        return F.when(c.isNotNull(), F.array(value)), bad
    if to.kind == "struct":
        if isinstance(t, T.StructType):
            cleaned = dict(zip(names.clean_siblings([f.name for f in t.fields], o.field_name_policy, o.scalar_object_key), t.fields))
            parts, bads = [], []
            for f in to.fields:
                source = cleaned.get(f.name) or cleaned.get(names.family(f.name))
                value, bad = adapt(c[source.name], source.dataType, f.type, o) if source is not None else (_nothing(f.type), None)
                parts.append(value.cast(f.type.spark()).alias(f.name))
                bads += [bad] * (bad is not None)
            return F.when(c.isNotNull(), F.struct(*parts)), reduce(lambda a, b: a | b, bads) if bads else None
        if not any(f.name == o.scalar_object_key for f in to.fields):
            return _nothing(to), c.isNotNull()
        parts, bad = [], None
        for f in to.fields:
            value = _nothing(f.type)
            if f.name == o.scalar_object_key:
                value, bad = adapt(c, t, f.type, o)
            parts.append(value.alias(f.name))
        return F.when(c.isNotNull(), F.struct(*parts)), bad
    if own is None:
        return _nothing(to), None
    if to.kind in ("utf8", "null"):
        return text(c, t), None
    if isinstance(t, T.StringType):
        value = {"bool": parse_bool, "int64": parse_int64, "float64": parse_float64, "timestamp": parse_timestamp, "date32": parse_date32, "time32": parse_time32}[to.kind](c, o)
        return value, c.isNotNull() & value.isNull()
    if own.kind == to.kind:
        if isinstance(t, T.TimestampType):
            c = F.to_utc_timestamp(c, F.current_timezone())
        return c.cast(to.spark()), None
    if (own.kind, to.kind) == ("int64", "float64"):
        return c.cast("double"), None
    if own.kind == "int64" and to.kind == "timestamp":
        return F.timestamp_add("MICROSECOND", c.cast("bigint") * (1000 if o.timestamp_precision == "TIMESTAMP_MILLIS" else 1), F.expr(_EPOCH)), None
    if own.kind == "int64" and to.kind == "date32":
        return F.date_from_unix_date(c.cast("int")), None
    return _nothing(to), c.isNotNull()


def fields_of(schema: T.StructType) -> list[LField]:
    return [LField(f.name, t) for f in schema.fields if (t := from_spark(f.dataType)) is not None]

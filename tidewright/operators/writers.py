"""File outputs: CSV, JSON Lines and Parquet, as one file or as a folder of parts.

A single file is written to a folder beside the target and renamed into place, so readers see it whole or not at all.
``parallel=True`` keeps the folder, which is what large outputs need.
"""

from __future__ import annotations

import base64
import datetime as dt
import math
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..errors import InvalidArgumentError
from ..functions.scalars import quote
from ..session import ship
from ..sources.files import beside, publish
from .convert import PLACE, Result, sanitize

COMPRESSIONS = {"gzip": "gzip", "snappy": "snappy", "uncompressed": "uncompressed", None: "gzip"}


def _moment(v) -> str | None:
    if isinstance(v, dt.datetime):
        return v.isoformat(timespec="microseconds")
    if isinstance(v, (dt.date, dt.time)):
        return v.isoformat()
    return None


def json_text(v) -> str:
    """A value as compact JSON: explicit nulls, 17-digit floats, ISO moments, tokens for non-finite numbers."""
    if v is None:
        return "null"
    if v is True or v is False:
        return "true" if v else "false"
    if isinstance(v, str):
        return quote(v)
    if isinstance(v, float):
        return "%.17g" % v if math.isfinite(v) else "NaN" if math.isnan(v) else "Infinity" if v > 0 else "-Infinity"
    if isinstance(v, (int, Decimal)):
        return str(v)
    if isinstance(v, dict):
        return "{" + ",".join(f"{quote(k)}:{json_text(x)}" for k, x in v.items()) + "}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(json_text, v)) + "]"
    if isinstance(v, (bytes, bytearray)):
        return quote(base64.b64encode(v).decode())
    return quote(_moment(v) or str(v))


def cell(v) -> str:
    """A CSV cell: quoted only where it must be; null is empty."""
    if v is None:
        return ""
    if isinstance(v, str):
        s = v
    elif isinstance(v, (dict, list, tuple)):
        s = json_text(v)
    elif isinstance(v, (bytes, bytearray)):
        s = base64.b64encode(v).decode()
    else:
        s = _moment(v) or json_text(v)
    return '"' + s.replace('"', '""') + '"' if any(c in s for c in ',"\r\n') else s


def _text_lines(df: DataFrame, form: str) -> DataFrame:
    """One text line per row; a column of a single string."""
    ship(df.sparkSession)
    names = list(df.columns)

    def lines(batches):
        for b in batches:
            columns = [b.column(i).to_pylist() for i in range(b.num_columns)]
            if form == "csv":
                out = [",".join(map(cell, row)) for row in zip(*columns)]
            else:
                heads = [quote(n) + ":" for n in names]
                out = ["{" + ",".join([h + json_text(v) for h, v in zip(heads, row)]) + "}" for row in zip(*columns)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])

    return df.mapInArrow(lines, "value string")


def _arranged(result: Result, parallel: bool) -> DataFrame:
    """Rows in source order: sorted for one file, left where they are for many."""
    return result.dataframe if parallel else result.placed.coalesce(1).sortWithinPartitions(*PLACE).drop(*PLACE)


def _place(spark: SparkSession, write, target: str, parallel: bool) -> None:
    if parallel:
        write(target)
        return
    folder = beside(target)
    write(folder)
    publish(spark, folder, target)


def write_csv(result: Result, target: str, parallel: bool = False) -> Result:
    spark = result.placed.sparkSession
    df = _arranged(result, parallel)
    head = ",".join(map(cell, df.columns))

    def write(folder: str) -> None:
        body = _text_lines(df, "csv")
        if not parallel:
            body = body.mapInArrow(_headed(head), "value string")
        body.write.mode("overwrite").text(folder)

    _place(spark, write, target, parallel)
    return result


def _headed(head: str):
    def add(batches):
        yield pa.RecordBatch.from_arrays([pa.array([head], pa.string())], names=["value"])
        yield from batches

    return add


def write_jsonl(result: Result, target: str, parallel: bool = False) -> Result:
    df = _arranged(result, parallel)
    _place(result.placed.sparkSession, lambda folder: _text_lines(df, "jsonl").write.mode("overwrite").text(folder), target, parallel)
    return result


def write_parquet(result: Result, target: str, compression: str | None = "gzip", gzip_level: int | None = None, parallel: bool = False) -> Result:
    """Times of day, which Spark cannot write to Parquet, are written as text."""
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    if compression not in COMPRESSIONS:
        raise InvalidArgumentError("parquet_compression must be gzip, snappy, uncompressed or None")
    if gzip_level is not None and not 0 <= gzip_level <= 9:
        raise InvalidArgumentError("parquet_gzip_level must be 0 to 9")
    df = _arranged(result, parallel)

    def stored(t: T.DataType) -> T.DataType:
        if isinstance(t, T.TimeType):
            return T.StringType()
        if isinstance(t, T.ArrayType):
            return T.ArrayType(stored(t.elementType), True)
        if isinstance(t, T.StructType):
            return T.StructType([T.StructField(f.name, stored(f.dataType), True) for f in t.fields])
        return t

    df = df.select(*[F.col(f"`{f.name}`").cast(stored(f.dataType)).alias(f.name) if stored(f.dataType) != f.dataType else F.col(f"`{f.name}`") for f in df.schema.fields])

    def write(folder: str) -> None:
        w = df.write.mode("overwrite").option("compression", COMPRESSIONS[compression])
        if gzip_level is not None and compression == "gzip":
            w = w.option("parquet.compression.codec.zlib.level", gzip_level).option("zlib.compress.level", {0: "NO_COMPRESSION", 1: "BEST_SPEED", 9: "BEST_COMPRESSION"}.get(gzip_level, "DEFAULT_COMPRESSION"))
        w.parquet(folder)

    _place(result.placed.sparkSession, write, target, parallel)
    return result


def to_csv(spark: SparkSession, source, output_path: str, *, parallel: bool = False, **given) -> Result:
    return write_csv(sanitize(spark, source, **given), output_path, parallel)


def to_jsonl(spark: SparkSession, source, output_path: str, *, parallel: bool = False, **given) -> Result:
    return write_jsonl(sanitize(spark, source, **given), output_path, parallel)


def to_parquet(spark: SparkSession, source, output_path: str, *, parquet_compression: str | None = "gzip", parquet_gzip_level: int | None = None, parallel: bool = False, **given) -> Result:
    return write_parquet(sanitize(spark, source, **given), output_path, parquet_compression, parquet_gzip_level, parallel)


def to_pyarrow(spark: SparkSession, source, **given) -> pa.Table:
    return sanitize(spark, source, **given).ordered().toArrow()


def to_pandas(spark: SparkSession, source, **given):
    return sanitize(spark, source, **given).ordered().toPandas()


def to_polars(spark: SparkSession, source, **given):
    try:
        import polars
    except ImportError:
        from ..errors import MissingDependencyError

        raise MissingDependencyError("polars is not installed") from None
    return polars.from_arrow(to_pyarrow(spark, source, **given))


def to_duckdb(spark: SparkSession, source, **given):
    """A DuckDB relation over the converted rows, on a connection of its own."""
    import duckdb

    connection = duckdb.connect()
    connection.register("converted", to_pyarrow(spark, source, **given))
    return connection.table("converted")


def iter_batches(spark: SparkSession, source, *, batch_rows: int = 65_536, **given):
    yield from sanitize(spark, source, **given).iter_batches(batch_rows)

"""Parquet files with columns that Spark's reader refuses (times of day below a second, nanosecond timestamps).

Such files are read by PyArrow inside the workers, a file per task: times become text, nanoseconds are cut to
microseconds toward zero. All other files go through Spark's own reader.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema


def refused(error: PySparkException) -> bool:
    return "PARQUET_TYPE_ILLEGAL" in str(error)


def _kept(t: pa.DataType) -> pa.DataType:
    if pa.types.is_time(t) or t == pa.uint64():
        return pa.string()
    if pa.types.is_timestamp(t):
        return pa.timestamp("us")
    if pa.types.is_dictionary(t):
        return _kept(t.value_type)
    if pa.types.is_nested(t) and any(pa.types.is_time(x) or x == pa.timestamp("ns") for x in _leaves(t)):
        raise TypeError("times below a second and nanoseconds are supported in top-level columns only")
    return t


def _leaves(t: pa.DataType):
    for i in range(t.num_fields):
        yield from _leaves(t.field(i).type) if t.field(i).type.num_fields else (t.field(i).type,)


def _column(c: pa.ChunkedArray, to: pa.DataType) -> pa.ChunkedArray:
    if pa.types.is_timestamp(c.type):
        per = {"s": (pc.multiply, 1_000_000), "ms": (pc.multiply, 1_000), "us": (pc.multiply, 1), "ns": (pc.divide, 1_000)}
        how, by = per[c.type.unit]
        return how(c.cast(pa.int64()), pa.scalar(by, pa.int64())).cast(to)
    return c.cast(to)


def read_in_workers(spark: SparkSession, paths: list[str]) -> list[DataFrame]:
    """A DataFrame for each distinct schema, with the place columns of a conversion."""
    import pyarrow.parquet as pq

    content = spark.read.format("binaryFile").load(paths).select("path", "content")

    def schemas(batches):
        for b in batches:
            found = [pq.read_schema(pa.BufferReader(x)).remove_metadata().serialize().to_pybytes() for x in b.column("content").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("path"), pa.array(found, pa.binary())], names=["path", "schema"])

    groups: dict[bytes, list[str]] = {}
    for r in sorted(content.mapInArrow(schemas, "path string, schema binary").collect(), key=lambda r: r["path"]):
        groups.setdefault(bytes(r["schema"]), []).append(r["path"])
    out = []
    for data, own in groups.items():
        source = pa.ipc.read_schema(pa.BufferReader(data))
        target = pa.schema([("__file", pa.string()), ("__block", pa.int64()), ("__pos", pa.int64()), *((f.name, _kept(f.type)) for f in source)])

        def rows(batches, target=target):
            for b in batches:
                for path, x in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                    at = 0
                    for part in pq.ParquetFile(pa.BufferReader(x)).iter_batches(8192):
                        table = pa.Table.from_batches([part])
                        n = table.num_rows
                        place = [pa.array([path] * n, pa.string()), pa.array([0] * n, pa.int64()), pa.array(range(at, at + n), pa.int64())]
                        columns = [_column(table.column(i), target.field(i + 3).type).combine_chunks() for i in range(table.num_columns)]
                        yield pa.RecordBatch.from_arrays(place + columns, schema=target)
                        at += n

        out.append(content.filter(F.col("path").isin(own)).mapInArrow(rows, from_arrow_schema(target, prefer_timestamp_ntz=True)))
    return out

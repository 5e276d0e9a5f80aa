"""Wide event columns to lists, and verified Hive-partitioned writes."""

from __future__ import annotations

import contextlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import IntegrityError, InvalidArgumentError


def event_columns(columns: list[str], separator: str = "/") -> list[tuple[int, str, str]]:
    """(id, text, column) of columns named ``<integer><separator><text>``, in the order of the input."""
    if not separator:
        raise InvalidArgumentError("the separator must not be empty")
    out = []
    for c in columns:
        number, _, text = c.partition(separator)
        if text:
            with contextlib.suppress(ValueError):  # no integer: an ordinary column
                out.append((int(number), text, c))
    return out


def wide_to_events(df: DataFrame, out: str = "event", drop_null: bool = False, separator: str = "/") -> DataFrame:
    """Event columns become one list of (event_id, event_text, payload); ``drop_null`` leaves out null payloads."""
    events = event_columns(df.columns, separator)
    rest = [c for c in df.columns if c not in {e[2] for e in events}]
    items = [F.struct(F.lit(i).cast("long").alias("event_id"), F.lit(t).alias("event_text"), F.col(f"`{c}`").cast("string").alias("payload")) for i, t, c in events]
    made = F.array(*items) if items else F.array().cast("array<struct<event_id:bigint,event_text:string,payload:string>>")
    if drop_null:
        made = F.filter(made, lambda e: e["payload"].isNotNull())
    return df.select(*[F.col(f"`{c}`") for c in rest], made.alias(out))


def write_hive(df: DataFrame, path: str, stamp: str) -> DataFrame:
    """Write by UTC year, month and day of ``stamp``, read back and check; rows without a time are refused."""
    if df.filter(F.col(stamp).isNull()).take(1):
        raise IntegrityError("a row has no time to partition by")
    parts = {"year": F.year(stamp), "month": F.month(stamp), "day": F.day(stamp)}
    own = df.withColumns(parts)
    # dealt by day, but a day larger than a partition should be is split over several tasks
    own.hint("rebalance", *[F.col(c) for c in parts]).write.mode("overwrite").partitionBy(*parts).parquet(path)
    back = df.sparkSession.read.parquet(path)
    if back.filter((F.year(stamp) != F.col("year")) | (F.month(stamp) != F.col("month")) | (F.day(stamp) != F.col("day"))).take(1):
        raise IntegrityError("a written row lies in another day's partition")
    return back

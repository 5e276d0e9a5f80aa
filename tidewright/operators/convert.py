"""Conversion of messy inputs to DataFrames with a stable, versioned schema.

Two Spark jobs per conversion: evidence (skipped in strict mode, where the contract is the schema) and materialisation.
Both are map-only over the units of the input. What reaches the driver is distinct evidence, reduced on the executors.
Typed Parquet input takes no Python at all: its evidence is its schema, and columns are cast as expressions.
"""

from __future__ import annotations

import datetime as dt
import json
import sys
from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass, field
from functools import cached_property, reduce

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import IntegrityError, InvalidArgumentError, ResourceError
from ..functions import names
from ..functions.columns import adapt
from ..functions.scalars import Parsers
from ..functions.types import LField, from_spark, scalar, struct, struct_of
from ..options import Options, SanitizeOptions
from ..plans import registry as reg
from ..plans.coerce import Level, Mismatch
from ..plans.evidence import Evidence, distinct_trees, packed, unpacked
from ..session import ship
from ..sources.files import SourceManifest, input_paths
from ..sources.parquet import read_in_workers, refused
from ..sources.parse import BadRow
from ..sources.readers import Reader, header_names, open_files, open_lines, open_rows

PLACE = ["__file", "__block", "__pos"]
#: Deepest nesting that Arrow's messages carry between Python and the JVM.
MOST_CARRIED_DEPTH = 60


def deep_calls() -> None:
    """Let a worker follow values of the deepest nesting that the options allow; some calls are needed per level."""
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 20_000))


@dataclass
class Result:
    """A conversion's rows and what is known about their schema."""

    placed: DataFrame  # the output columns after the place columns
    fields: tuple[LField, ...]
    schema_registry: dict
    schema_drifts: list[dict]
    options: Options
    ingestion_timestamp: dt.datetime
    _stats: dict = field(default_factory=dict)

    @cached_property
    def dataframe(self) -> DataFrame:
        """The rows; their order is that of the partitions."""
        return self.placed.drop(*PLACE)

    def ordered(self) -> DataFrame:
        """The rows in the order of the source."""
        return self.placed.orderBy(*PLACE).drop(*PLACE)

    @property
    def schema_registry_json(self) -> str:
        return json.dumps(self.schema_registry, ensure_ascii=False, separators=(",", ":"))

    @property
    def schema_drifts_json(self) -> str:
        return json.dumps(self.schema_drifts, ensure_ascii=False, separators=(",", ":"))

    @property
    def stats(self) -> dict:
        """Counters; those of materialisation are complete once the rows have been computed."""
        out = {"diagnostics_schema_version": 1}
        return out | {k: (v.value if hasattr(v, "value") else v) for k, v in self._stats.items()}

    def iter_batches(self, rows: int = 65_536) -> Iterator[pa.RecordBatch]:
        """Arrow batches in source order, one partition at a time on the driver."""
        held: list = []
        schema = self.ordered().schema
        for r in self.ordered().toLocalIterator(prefetchPartitions=True):
            held.append(r.asDict(recursive=True))
            if len(held) == rows:
                yield pa.RecordBatch.from_pylist(held, schema=arrow_schema(schema))
                held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=arrow_schema(schema))


def arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _depths(fields: Iterable[LField]) -> tuple[int, int]:
    def depth(t, lists: bool) -> int:
        if t.kind == "struct":
            return 1 + max((depth(f.type, lists) for f in t.fields), default=0)
        if t.kind == "list":
            return lists + (depth(t.item, lists) if t.item else 0)
        return 0

    fields = list(fields)
    return max((depth(f.type, True) for f in fields), default=0), max((depth(f.type, False) for f in fields), default=0)


def infer(reader: Reader, stats: dict | None = None) -> tuple[list[LField], tuple | None]:
    """The fields that all rows give evidence of, and the place of the first row."""
    o = reader.o
    ship(reader.units.sparkSession)
    deep_calls()

    def scan(batches):
        deep_calls()
        parsers = Parsers(o)
        n = {"rows": 0, "first": None}
        out: list[tuple] = []

        def rows():
            place = None
            for file, block, pos, row in reader.rows(batches):
                if (file, block) != place:
                    if place is not None:
                        yield None
                    place = (file, block)
                n["rows"] += 1
                if n["first"] is None or (file, block, pos) < n["first"]:
                    n["first"] = (file, block, pos)
                n["at"] = (file, block)
                yield pos, (row if isinstance(row, dict) else {})

        source = rows()
        done = False
        while not done:

            def block():
                nonlocal done
                for x in source:
                    if x is None:
                        return
                    n["pos"] = x[0]
                    yield x[1]
                done = True

            for _, key, t in distinct_trees(block(), parsers, o):
                out.append((*n["at"], n["pos"], key, packed(t), 0))
        if n["rows"]:
            out.append((*n["first"], None, None, n["rows"]))
        yield pa.RecordBatch.from_pylist([dict(zip(("file", "block", "pos", "key", "tree", "n"), x)) for x in out], schema=pa.schema([("file", pa.string()), ("block", pa.int64()), ("pos", pa.int64()), ("key", pa.string()), ("tree", pa.string()), ("n", pa.int64())]))

    sent = reader.units.mapInArrow(scan, "file string, block long, pos long, key string, tree string, n long").withColumn("seq", F.monotonically_increasing_id()).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        place = F.struct("file", "block", "pos", "seq")
        least = sent.groupBy("key", "tree").agg(F.min(place).alias("place"), F.sum("n").alias("n")).collect()
        head = next((r for r in least if r["key"] is None), None)
        entries = [(tuple(r["place"]), r["key"], unpacked(r["tree"])) for r in least if r["key"] is not None]
        entries = _replayed(sent, entries)
    finally:
        sent.unpersist()
    fold = Evidence(o)
    for _, key, t in sorted(entries, key=lambda e: e[0]):
        fold.add([(key, t)])
    for key in header_names(reader):  # declared in a header, though always empty
        node = fold.root.child(key)
        if not node.evident:
            node.count(8, o.scalar_object_key)
    if stats is not None:
        stats["inferred_rows"] = head["n"] if head else 0
    return fold.fields(), tuple(head["place"])[:3] if head else None


def _replayed(sent: DataFrame, entries: list[tuple]) -> list[tuple]:
    """The entries that a sequential fold needs: each tree once between two new shapes of its key.

    Where a new shape comes up is known from first occurrences alone. Only keys with several shapes and several trees are
    looked at again.
    """
    by_key: dict[str, list[tuple]] = {}
    for e in sorted(entries, key=lambda e: e[0]):
        by_key.setdefault(e[1], []).append(e)
    again: dict[str, list[tuple]] = {}
    for key, own in by_key.items():
        from ..plans.evidence import Node

        node, changes = Node(), []
        for place, _, t in own:
            if node.shape(t):
                changes.append(place)
        if len(own) > 1 and changes and not (len(changes) == 1 and changes[0] == own[0][0]):
            again[key] = changes
    if not again:
        return entries
    place = F.struct("file", "block", "pos", "seq")
    out = [e for e in entries if e[1] not in again]
    part = F.lit(0)
    for key, changes in again.items():
        marks = [F.when(place >= F.struct(*[F.lit(x).alias(n) for x, n in zip(c, ("file", "block", "pos", "seq"))]), 1).otherwise(0) for c in changes]
        part = F.when(F.col("key") == key, reduce(lambda a, b: a + b, marks)).otherwise(part)
    rows = sent.filter(F.col("key").isin(list(again))).groupBy("key", "tree", part.alias("part")).agg(F.min(place).alias("place")).collect()
    return out + [(tuple(r["place"]), r["key"], unpacked(r["tree"])) for r in rows]


def materialise(reader: Reader, fields: tuple[LField, ...], stats: dict) -> DataFrame:
    """Rows of ``fields`` with their place and a ``source_file``."""
    o = reader.o
    spark = reader.units.sparkSession
    ship(spark)
    counters = {k: spark.sparkContext.accumulator(0) for k in ("materialized_rows", "skipped_rows", "scalar_wrappings")}
    stats |= counters
    types = pa.schema([(f.name, f.type.arrow()) for f in fields])

    def build(batches):
        deep_calls()
        counts = {"scalar_wrappings": 0}
        level = Level(fields, o, Parsers(o), counts)
        most = 4096

        def batch(rows: list, places: list):
            columns = [pa.array([p[i] for p in places], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.string()))]
            values = list(zip(*rows)) if rows else [()] * len(fields)
            columns += [pa.array(v, f.type) for v, f in zip(values, types)]
            return pa.RecordBatch.from_arrays(columns, names=[*PLACE, "source_file", *types.names])

        rows, places, made, skipped = [], [], 0, 0
        nothing = (None,) * len(fields)
        for file, block, pos, row in reader.rows(batches):
            source = file
            try:
                if isinstance(row, BadRow):
                    raise Mismatch(str(row))
                values = level.row(row, root=True)
            except Mismatch as e:
                if o.on_error == "stop":
                    raise IntegrityError(str(e)) from None
                if o.on_error == "skip_row":
                    skipped += 1
                    continue
                values, source = nothing, None
            rows.append(values)
            places.append((file, block, pos, source or None))
            made += 1
            if len(rows) == most:
                yield batch(rows, places)
                rows, places = [], []
        if rows:
            yield batch(rows, places)
        counters["materialized_rows"].add(made)
        counters["skipped_rows"].add(skipped)
        counters["scalar_wrappings"].add(counts["scalar_wrappings"])

    out = T.StructType([T.StructField("__file", T.StringType()), T.StructField("__block", T.LongType()), T.StructField("__pos", T.LongType()), T.StructField("source_file", T.StringType()), *struct_of(fields).fields])
    return reader.units.mapInArrow(build, out)


def _finished(rows: DataFrame, fields: tuple[LField, ...], merged: reg.Merged, first: tuple | None, stamp: dt.datetime) -> DataFrame:
    """The generated columns at the end; registry and drifts stand on the first row only."""
    own = F.lit(False)
    if first is not None:
        own = (F.col("__file") == first[0]) & (F.col("__block") == first[1]) & (F.col("__pos") == first[2])
    return rows.select(
        *PLACE,
        *[F.col(f"`{f.name}`") for f in fields],
        F.when(own, F.lit(merged.registry_json)).alias("schema_registry"),
        F.when(own, F.lit(merged.drifts_json)).alias("schema_drifts"),
        "source_file",
        F.lit(stamp.replace(tzinfo=None)).cast("timestamp_ntz").alias("ingestion_timestamp"),
    )


def _options(options, given: dict) -> Options:
    if isinstance(options, SanitizeOptions):
        given = options.flat() | given
    elif isinstance(options, Options):
        return options
    return Options.of(**given)


def sanitize(spark: SparkSession, source, *, schema_registry: Mapping | str | None = None, options: SanitizeOptions | Options | None = None, detected_at: str = "", **given) -> Result:
    """Convert ``source`` to a Result: a path, a manifest, dictionaries, a typed DataFrame (input_format 'parquet' or
    none), or a DataFrame of text whose rows are lines or documents (input_format 'jsonl', 'json', 'json_array', 'xml')."""
    o = _options(options, given)
    frame = isinstance(source, DataFrame)
    python = not frame and not isinstance(source, (str, SourceManifest)) and not hasattr(source, "__fspath__")
    if frame and o.input_format not in (None, "parquet", "jsonl", "json", "json_array", "xml"):
        raise InvalidArgumentError("a DataFrame is typed, or holds lines or documents")
    if frame:
        pass
    elif o.input_format is None or o.input_format == "python":
        if not python:
            raise InvalidArgumentError("input_format is needed for files; it is never guessed")
    elif python:
        raise InvalidArgumentError("dictionaries take no input_format but 'python'")
    stats: dict = {"inferred_rows": None, "direct_arrow_input": False}
    stamp = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    if isinstance(source, SourceManifest):
        stats |= {"source_manifest_uri": source.uri, "source_object_count": len(source.files)}
    how = dict(schema_mode=o.schema_mode, column_order=o.column_order, field_name_policy=o.field_name_policy, default_key=o.scalar_object_key, detected_at=detected_at)
    if not python and o.input_format == "parquet":
        return _parquet(spark, input_paths(spark, source, "parquet", o.input_mode), o, schema_registry, how, stats, stamp)
    if frame and o.input_format in (None, "parquet"):
        return _typed([source.withColumns({"__file": F.lit("").cast("string"), "__block": F.spark_partition_id().cast("long"), "__pos": F.monotonically_increasing_id()})], o, schema_registry, how, stats, stamp)
    reader = open_lines(source, o) if frame else open_rows(spark, source, o) if python else open_files(spark, input_paths(spark, source, o.input_format, o.input_mode), o)
    first = None
    if o.schema_mode == "strict":
        merged = reg.merge([], schema_registry, **how)  # the contract is the schema: nothing to infer
    else:
        inferred, first = infer(reader, stats)
        merged = reg.merge(inferred, schema_registry, **how)
    if clash := [f.name for f in merged.fields if f.name in names.ETL_COLUMNS]:
        raise InvalidArgumentError(f"source fields with names of generated columns: {', '.join(clash)}")
    if max(_depths(merged.fields)) > MOST_CARRIED_DEPTH:
        raise ResourceError(f"the schema is nested more than {MOST_CARRIED_DEPTH} deep; lower arrow_max_depth and parquet_max_depth to flatten it")
    rows = materialise(reader, merged.fields, stats)
    if first is None or o.on_error == "skip_row":
        first = rows.agg(F.min(F.struct(*PLACE)).alias("p")).first()["p"]
        first = tuple(first) if first else None
        for name in ("materialized_rows", "skipped_rows", "scalar_wrappings"):
            stats[name].value = 0
    stats["arrow_schema_depth"], stats["parquet_schema_depth"] = _depths(merged.fields)
    placed = _finished(rows, merged.fields, merged, first, stamp)
    return Result(placed, merged.fields, merged.registry, json.loads(merged.drifts_json), o, stamp, stats)


def _parquet(spark: SparkSession, paths: list[str], o: Options, registry, how: dict, stats: dict, stamp: dt.datetime) -> Result:
    """Typed input: evidence from the files' schemas, rows by column expressions."""
    groups: dict[str, list[str]] = {}
    frames: dict[str, DataFrame] = {}
    special = []
    for p in paths:
        try:
            df = spark.read.parquet(p)
            key = df.schema.json()
        except PySparkException as e:
            if not refused(e):
                raise
            special.append(p)
            continue
        frames.setdefault(key, df)
        groups.setdefault(key, []).append(p)
    typed = read_in_workers(spark, special) if special else []
    for key, own in groups.items():
        df = spark.read.schema(frames[key].schema).parquet(*own)
        typed.append(df.withColumns({"__file": F.col("_metadata.file_path"), "__block": F.lit(0).cast("long"), "__pos": F.col("_metadata.row_index")}))
    return _typed(typed, o, registry, how, stats, stamp)


def _typed(frames: list[DataFrame], o: Options, registry, how: dict, stats: dict, stamp: dt.datetime) -> Result:
    """Rows of typed frames, which carry their place columns, by expressions alone."""
    rows, batches, plans = None, [], []
    for df in frames:
        live = [(f.name, t) for f in df.schema.fields if f.name not in PLACE and (t := from_spark(f.dataType)) is not None]
        if clash := [n for n, _ in live if n in names.ETL_COLUMNS]:
            raise InvalidArgumentError(f"source fields with names of generated columns: {', '.join(clash)}")
        cleaned = names.clean_siblings([n for n, _ in live], o.field_name_policy, o.scalar_object_key)
        batches.append([LField(c, _cleaned(t, o)) for c, (_, t) in zip(cleaned, live)])
        plans.append((df, dict(zip(cleaned, (n for n, _ in live)))))
    merged = reg.merge(reg.combined(batches, o.scalar_object_key), registry, **how)
    for df, columns in plans:
        place = df
        values, bad = _adapted(df.schema, columns, merged.fields, o)
        source = F.col("__file")
        if bad is not None:
            if o.on_error == "skip_row":
                place = place.filter(~bad)
            else:
                failed = F.raise_error(F.lit("a value does not fit its planned field")) if o.on_error == "stop" else F.lit(None)
                values = [F.when(bad, failed.cast(f.type.spark())).otherwise(v).alias(f.name) for v, f in zip(values, merged.fields)]
                source = F.when(bad, F.lit(None)).otherwise(source)
        out = place.select(*PLACE, source.alias("source_file"), *values)
        rows = out if rows is None else rows.unionByName(out)
    stats["direct_arrow_input"] = True
    stats["arrow_schema_depth"], stats["parquet_schema_depth"] = _depths(merged.fields)
    first = rows.agg(F.min(F.struct(*PLACE)).alias("p")).first()["p"]  # reads no column of the data but what a policy needs
    placed = _finished(rows, merged.fields, merged, tuple(first) if first else None, stamp)
    return Result(placed, merged.fields, merged.registry, [d.__dict__ for d in merged.drifts], o, stamp, stats)


def _cleaned(t, o: Options):
    """A nested type with clean names."""
    if t.kind == "struct":
        cleaned = names.clean_siblings([f.name for f in t.fields], o.field_name_policy, o.scalar_object_key)
        return struct(LField(c, _cleaned(f.type, o)) for c, f in zip(cleaned, t.fields))
    if t.kind == "list":
        from ..functions.types import list_of

        if t.item is None or t.item.kind == "list":
            return list_of(scalar("utf8"))
        return list_of(_cleaned(t.item, o))
    return t


def _adapted(schema: T.StructType, columns: dict[str, str], fields: tuple[LField, ...], o: Options) -> tuple[list[Column], Column | None]:
    """The output columns of a typed frame, and where a value does not fit.

    Of the versions of a field, the one that fits the column's type best takes it; it never fails a row.
    """
    out, bads = [], []
    for f in fields:
        siblings = [x for x in fields if names.family(x.name) == names.family(f.name)]
        source = columns.get(f.name) or columns.get(names.family(f.name)) or next((columns[x.name] for x in siblings if x.name in columns), None)
        value = F.lit(None)
        if source is not None:
            own = _cleaned(from_spark(schema[source].dataType), o)
            if max(siblings, key=lambda x: (_closeness(x.type, own), siblings.index(x))).name == f.name:
                value, bad = adapt(F.col(f"`{source}`"), schema[source].dataType, f.type, o)
                if bad is not None and len(siblings) == 1:
                    bads.append(bad)
        out.append(value.cast(f.type.spark()).alias(f.name))
    return out, reduce(lambda a, b: a | b, bads) if bads else None


def _closeness(t, own) -> int:
    if t == own:
        return 500
    if t.kind == "list":
        return 400 if own.kind == "list" else 350
    if t.kind == "struct":
        return 300 if own.kind == "struct" else 50
    if not own.scalar:
        return 25
    if t.kind == "utf8":
        return 300 if own.kind == "utf8" else 150
    return 375 if (own.kind, t.kind) == ("int64", "float64") else 350 if own.kind == "utf8" else 50


class Sanitizer:
    """A conversion with fixed options."""

    def __init__(self, spark: SparkSession, options: SanitizeOptions | None = None):
        self.spark, self.options = spark, options or SanitizeOptions()

    def to_dataframe(self, source, **given) -> Result:
        return sanitize(self.spark, source, options=self.options, **given)

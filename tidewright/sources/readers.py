"""Readers: each input becomes a DataFrame of raw units, and workers turn units into rows.

A unit is a line (JSON Lines; CSV whose records are lines), a whole document, or a piece of an XML document. Units carry the file and the offset of
the split they come from, so that rows have a fixed place (file, block, position) whatever the partitioning is: splits of a
large file are read side by side, and order is restored from the place.
"""

from __future__ import annotations

import base64
import codecs
import datetime as dt
import decimal
import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import IntegrityError, ResourceError
from ..functions import names
from ..functions.scalars import ASCII_SPACE
from ..options import Options
from .parse import BadRow, Csv, csv_keys, decoded, json_array, json_document, json_row, xml_rows

UNITS = "file string, block long, unit string"
#: Bytes of an XML document that are sent to a worker in one row.
PIECE = 1 << 20


@dataclass
class Reader:
    """Units of one input and what workers need to read them."""

    units: DataFrame  # file, block, unit (string or binary), for XML last; rows of a split follow each other
    form: str
    o: Options
    headers: dict[str, list[str] | None] = field(default_factory=dict)  # CSV in union mode and by lines

    def __getstate__(self):
        return {**self.__dict__, "units": None}  # workers get no DataFrame

    def rows(self, batches: Iterator) -> Iterator[tuple[str, int, int, dict | BadRow]]:
        """(file, block, position, row) of a partition's units; a malformed JSON line gives its error as the row."""
        place, position = None, 0
        for file, block, unit in self._documents(batches) if self.form == "xml" else _columns(batches, "file", "block", "unit"):
            if (file, block) != place:
                place, position, first = (file, block), 0, block == 0
            else:
                first = False
            for row in self._of_unit(file, unit, first):
                yield file, block, position, row
                position += 1

    def _documents(self, batches: Iterator) -> Iterator[tuple[str, int, Iterator[str]]]:
        """(file, block, text in pieces) of a partition's XML documents; the text is to be read before the next is asked for."""
        source = _columns(batches, "file", "block", "unit", "last")
        encoding = self.o.input_text_encoding.lower()

        def text(piece: bytes, last: bool) -> Iterator[str]:
            decoder = codecs.getincrementaldecoder(encoding)()
            while True:
                try:
                    yield decoder.decode(piece, last)
                except UnicodeDecodeError:
                    raise IntegrityError(f"the input is not valid {encoding}") from None
                if last:
                    return
                _, _, piece, last = next(source)

        for file, block, piece, last in source:
            yield file, block, text(piece, last)

    def _of_unit(self, file: str, unit, first: bool) -> Iterator[dict | BadRow]:
        o = self.o
        if self.form == "xml":
            yield from xml_rows(_unmarked(unit) if first else unit, o.xml_row_tag)
            return
        if isinstance(unit, (bytes, bytearray)):
            unit = decoded(unit, o.input_text_encoding)
        if first and unit.startswith("﻿"):
            unit = unit[1:]
        if self.form in ("jsonl", "python"):
            for line in unit.split("\n") if o.input_text_encoding.lower() != "utf-8" else (unit,):
                if line.strip(ASCII_SPACE):
                    try:
                        yield json_row(line, o.scalar_object_key)
                    except BadRow as e:
                        yield e
        elif self.form == "json":
            try:
                yield from json_document(unit, o.scalar_object_key)
            except BadRow as e:
                yield e
        elif self.form == "json_array":
            yield from json_array(unit)
        elif self.form == "csv_lines":
            records = Csv(o.csv_delimiter, o.csv_escape_char).records(unit)
            keys = self.headers.get(file)
            for cells in records:
                if first and o.csv_has_header:
                    return
                yield self._cells(keys, cells)
        else:
            keys = None
            for cells in Csv(o.csv_delimiter, o.csv_escape_char).records(unit):
                if keys is None and o.csv_has_header:
                    keys = csv_keys(cells)
                    continue
                yield self._cells(keys, cells)

    def _cells(self, keys: list[str] | None, cells: list[str]) -> dict:
        known = len(keys) if keys else 0
        if self.o.csv_header_mode == "union" and keys and len(cells) > known:
            raise IntegrityError("CSV: a row is longer than its header")
        out = {k: c or None for k, c in zip(keys or (), cells)}
        for i in range(known, len(cells)):
            out[str(i)] = cells[i] or None
        return out


def _columns(batches: Iterator, *names: str) -> Iterator[tuple]:
    """The values of these columns row by row; a unit becomes a Python value when its turn comes."""
    for batch in batches:
        yield from zip(*[(v.as_py() for v in batch.column(n)) if n == "unit" else batch.column(n).to_pylist() for n in names])


def _unmarked(text: Iterator[str]) -> Iterator[str]:
    """Without the byte order mark."""
    yield next(text, "").removeprefix("\ufeff")
    yield from text


def _pieces(units: DataFrame) -> DataFrame:
    """XML documents in pieces, in order, the last of each marked, so that no worker holds a document.

    The bytes are a column of their own below the generator, which takes their length: generated code then has them in a
    variable and copies nothing but the piece.
    """
    end = F.expr(f"CAST((octet_length(whole) - 1) DIV {PIECE} AS INT)")
    numbered = units.select("file", "block", F.col("unit").cast("binary").alias("whole")).select("file", "block", "whole", F.explode(F.sequence(F.lit(0), end)).alias("i"))
    return numbered.select("file", "block", F.substring("whole", F.col("i") * PIECE + 1, F.lit(PIECE)).alias("unit"), (F.col("i") == end).alias("last"))


def _whole(spark: SparkSession, paths: list[str], encoding: str) -> DataFrame:
    if encoding.lower() != "utf-8":
        got = spark.read.format("binaryFile").load(paths).select(F.col("path").alias("file"), F.col("content").alias("unit"))
    else:
        got = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("unit"))
    return got.select("file", F.lit(0).cast("long").alias("block"), "unit")


def _lines(spark: SparkSession, paths: list[str], separator: str | None = None) -> DataFrame:
    read = spark.read.option("lineSep", separator) if separator else spark.read
    return read.text(paths).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("unit"))


def open_files(spark: SparkSession, paths: list[str], o: Options) -> Reader:
    """The reader of an input's files (all formats but Parquet)."""
    form = o.input_format
    utf8 = o.input_text_encoding.lower() == "utf-8"
    if form == "jsonl":
        return Reader(_lines(spark, paths) if utf8 else _whole(spark, paths, o.input_text_encoding), form, o)
    if form != "csv":
        whole = _whole(spark, paths, o.input_text_encoding)
        return Reader(_pieces(whole) if form == "xml" else whole, form, o)
    if utf8 and _records_are_lines(_lines(spark, paths), o):
        reader = Reader(_lines(spark, paths), "csv_lines", o)
        reader.headers = _line_headers(reader.units, o)
    else:
        reader = Reader(_whole(spark, paths, o.input_text_encoding), "csv", o)
        reader.headers = _document_headers(reader, o)
    _check_headers(reader.headers, o)
    return reader


def _records_are_lines(lines: DataFrame, o: Options) -> bool:
    """Whether no quoted cell spans lines: every line holds an even number of quotes and no escape."""
    odd = (F.length("unit") - F.length(F.replace(F.col("unit"), F.lit('"'), F.lit("")))) % 2 == 1
    if o.csv_escape_char:
        odd = odd | F.contains(F.col("unit"), F.lit(o.csv_escape_char))
    return not lines.filter(F.contains(F.col("unit"), F.lit('"')) & odd).take(1) if o.csv_escape_char is None else not lines.filter(odd).take(1)


def _line_headers(units: DataFrame, o: Options) -> dict:
    """The first record of each file, read from the first split of each."""
    if not o.csv_has_header:
        return {}

    def first(batches):
        import pyarrow as pa

        done = set()
        for b in batches:
            files, lines = [], []
            for f, line in zip(b.column("file").to_pylist(), b.column("unit").to_pylist()):
                if f not in done and line.strip(ASCII_SPACE):
                    done.add(f)
                    files.append(f)
                    lines.append(line)
            yield pa.RecordBatch.from_arrays([pa.array(files, pa.string()), pa.array(lines, pa.string())], names=["file", "line"])

    got = units.filter("block = 0").select("file", "unit").mapInArrow(first, "file string, line string").collect()
    csv = Csv(o.csv_delimiter, o.csv_escape_char)
    return {r["file"]: csv_keys(next(csv.records(r["line"]))) for r in got}


def _document_headers(reader: Reader, o: Options) -> dict:
    if not o.csv_has_header:
        return {}

    def first(batches):
        import pyarrow as pa

        for b in batches:
            files, heads = [], []
            for f, unit in zip(b.column("file").to_pylist(), b.column("unit").to_pylist()):
                text = decoded(unit, o.input_text_encoding) if isinstance(unit, bytes) else unit
                head = next(Csv(o.csv_delimiter, o.csv_escape_char).records(text), None)
                if head is not None:
                    files.append(f)
                    heads.append(csv_keys(head))
            yield pa.RecordBatch.from_arrays([pa.array(files, pa.string()), pa.array(heads, pa.list_(pa.string()))], names=["file", "head"])

    return {r["file"]: list(r["head"]) for r in reader.units.select("file", "unit").mapInArrow(first, "file string, head array<string>").collect()}


def _check_headers(headers: dict[str, list[str]], o: Options) -> None:
    for keys in headers.values():
        cleaned = [names.clean(k, o.field_name_policy, o.scalar_object_key) for k in keys]
        if len(set(cleaned)) < len(cleaned):
            raise IntegrityError("CSV: header names collide once cleaned")
    if o.csv_header_mode == "exact" and len({tuple(k) for k in headers.values()}) > 1:
        raise IntegrityError("CSV: the files' headers differ; csv_header_mode='union' takes them")


def header_names(reader: Reader) -> list[str]:
    """In union mode, the columns that files declare, whether or not a row fills them."""
    return list(dict.fromkeys(k for keys in dict(sorted(reader.headers.items())).values() for k in keys)) if reader.o.csv_header_mode == "union" else []


def _plain(v):
    if isinstance(v, (dt.datetime, dt.date, dt.time)):
        return v.isoformat()
    if isinstance(v, (bytes, bytearray, memoryview)):
        return base64.b64encode(bytes(v)).decode()
    if isinstance(v, decimal.Decimal):
        return str(v)
    if isinstance(v, (set, frozenset, tuple)):
        return list(v)
    raise TypeError(f"values of type {type(v).__name__} are not supported")


def open_lines(lines: DataFrame, o: Options) -> Reader:
    """The reader of a DataFrame of text (its first column): one document or line per row."""
    units = lines.select(F.lit("").alias("file"), F.spark_partition_id().cast("long").alias("block"), F.col(f"`{lines.columns[0]}`").alias("unit"))
    units = units.filter(F.col("unit").isNotNull())
    return Reader(_pieces(units) if o.input_format == "xml" else units, o.input_format, o)


def open_rows(spark: SparkSession, rows: Iterable[dict], o: Options, chunk: int = 10_000) -> Reader:
    """The reader of Python dictionaries: serialised once, so that they can be read again."""
    lines: list[tuple[str, int, str]] = []
    for i, r in enumerate(rows):
        if not isinstance(r, dict):
            raise TypeError("rows must be dictionaries")
        try:
            lines.append(("", i // chunk, json.dumps(r, ensure_ascii=False, allow_nan=False, default=_plain)))
        except ValueError as e:
            raise ResourceError(str(e)) from None
    parts = max(1, min(len(lines) // chunk + 1, 256))
    data = spark.createDataFrame(spark.sparkContext.parallelize(lines, parts), UNITS) if lines else spark.createDataFrame([], UNITS)
    return Reader(data, "python", o)

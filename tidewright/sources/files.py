"""Listing, manifests and atomic publication through Hadoop's file systems."""

from __future__ import annotations

import datetime as dt
import os
import uuid
from collections.abc import Iterable
from dataclasses import dataclass
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import IntegrityError, InvalidArgumentError

SUFFIXES = {"csv": (".csv",), "json": (".json",), "json_array": (".json",), "jsonl": (".jsonl", ".ndjson", ".json"), "xml": (".xml",), "parquet": (".parquet",)}


@dataclass(frozen=True, order=True)
class RemoteFile:
    """One object; the generation tells versions of an object apart (here: its modification time in ms)."""

    uri: str
    generation: str | None = None
    size: int | None = None
    updated: dt.datetime | None = None


def _place(uri: str) -> tuple[str, str]:
    """Authority and path of a uri."""
    parts = urlsplit(uri)
    return parts.netloc.lower(), parts.path.strip("/")


def _holds(source: str, uri: str) -> bool:
    """Whether an object is the source itself or lies below it; a pattern holds what begins as it does."""
    if "*" in source:
        return uri.startswith(source.partition("*")[0])
    (host, root), (own, path) = _place(source), _place(uri)
    return host == own and (root in ("", path) or path.startswith(root + "/"))


@dataclass(frozen=True)
class SourceManifest:
    """An ordered, immutable set of objects under one prefix."""

    uri: str
    files: tuple[RemoteFile, ...]

    def __post_init__(self):
        files = tuple(sorted(self.files, key=lambda f: (f.uri, f.generation or "")))
        object.__setattr__(self, "files", files)
        for f in files:
            if not _holds(self.uri, f.uri):
                raise InvalidArgumentError("a manifest's object lies outside its prefix")
            if not f.generation:
                raise InvalidArgumentError("a manifest's objects need a generation")
        if len({(f.uri, f.generation) for f in files}) < len(files):
            raise InvalidArgumentError("a manifest names an object twice")

    @property
    def total_bytes(self) -> int | None:
        sizes = [f.size for f in self.files]
        return None if None in sizes else sum(sizes)


def _fs(spark: SparkSession, uri: str):
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(uri)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def _listed(spark: SparkSession, uri: str) -> list[RemoteFile]:
    fs, path = _fs(spark, uri)
    if not fs.exists(path):
        raise FileNotFoundError(f"no such path: {uri}")
    out = []
    for s in fs.listStatus(path):
        if s.isFile():
            ms = s.getModificationTime()
            out.append(RemoteFile(s.getPath().toString(), str(ms), s.getLen(), dt.datetime.fromtimestamp(ms / 1000, dt.timezone.utc)))
    return sorted(out, key=lambda f: f.uri)


def list_objects(spark: SparkSession, uri: str, suffixes: Iterable[str] | None = None) -> tuple[RemoteFile, ...]:
    """The direct children of a folder that are files, in order of name; hidden ones do not count."""
    wanted = tuple("." + s.lstrip(".") for s in suffixes) if suffixes else None
    hidden = lambda f: f.uri.rsplit("/", 1)[-1].startswith(("_", "."))
    return tuple(f for f in _listed(spark, uri) if not hidden(f) and (wanted is None or f.uri.endswith(wanted)))


def discover(spark: SparkSession, uri: str, suffixes: Iterable[str], modified_between: tuple[dt.datetime, dt.datetime] | None = None) -> SourceManifest:
    """A manifest of the objects under a folder, by half-open modification time."""
    files = list_objects(spark, uri, suffixes)
    if modified_between:
        begin, end = modified_between
        files = tuple(f for f in files if begin <= f.updated < end)
    return SourceManifest(files[0].uri.rsplit("/", 1)[0] + "/" if files else uri.rstrip("/") + "/", files)


def manifest_frame(objects: DataFrame, uri: str = "uri", generation: str = "generation") -> DataFrame:
    """A listing that is a table, as a manifest: in order of uri and generation.

    An object without a generation and one that is named twice fail the query, as they fail ``SourceManifest``.
    """
    named = objects.groupBy(uri, generation).agg(F.count("*").alias("__times"))
    blank = F.coalesce(F.trim(F.col(generation).cast("string")), F.lit("")) == ""
    fault = F.when(blank, F.raise_error(F.lit("a manifest's objects need a generation"))).when(F.col("__times") > 1, F.raise_error(F.lit("a manifest names an object twice")))
    return named.filter(fault.isNull()).orderBy(uri, generation).select(uri, generation)


def input_paths(spark: SparkSession, source, input_format: str, input_mode: str) -> list[str]:
    """The files of an input, in order."""
    if isinstance(source, SourceManifest):
        return [f.uri for f in source.files]
    source = str(source)
    if input_mode == "directory":
        found = [f.uri for f in list_objects(spark, source, SUFFIXES[input_format])]
        if not found:
            raise FileNotFoundError(f"no {input_format} files in {source}")
        return found
    fs, path = _fs(spark, source)
    if not fs.exists(path):
        raise FileNotFoundError(f"no such path: {source}")
    if fs.getFileStatus(path).isDirectory():
        parts = [f.uri for f in list_objects(spark, source) if f.size]
        if input_format != "parquet" and not parts:
            raise InvalidArgumentError("a folder needs input_mode='directory'")
        return parts
    if not source.lower().endswith(SUFFIXES[input_format]):
        raise InvalidArgumentError(f"the file's extension does not agree with input_format={input_format!r}")
    return [fs.makeQualified(path).toString()]


def _replace(spark: SparkSession, fs, made, out) -> None:
    """Rename ``made`` to ``out``; an older file there is never gone before the new one stands.

    Local files and HDFS replace in one step. Other stores have no such rename: there the old file is set aside, and comes
    back if the new one cannot take its place.
    """
    scheme = fs.getScheme()
    if scheme == "file":
        os.replace(made.toUri().getPath(), out.toUri().getPath())
        return
    jvm = spark._jvm
    if scheme in ("hdfs", "viewfs", "webhdfs", "swebhdfs"):
        options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(made, out, options)
        return
    aside = jvm.org.apache.hadoop.fs.Path(beside(out.toString())) if fs.exists(out) else None
    if aside is not None and not fs.rename(out, aside):
        raise IntegrityError(f"could not publish {out}")
    if not fs.rename(made, out):
        if aside is not None:
            fs.rename(aside, out)
        raise IntegrityError(f"could not publish {out}")
    if aside is not None:
        fs.delete(aside, False)


def publish(spark: SparkSession, folder: str, target: str) -> int:
    """Move the single part file in ``folder`` to ``target`` by one rename; return its size."""
    fs, path = _fs(spark, folder)
    parts = [s.getPath() for s in fs.listStatus(path) if s.getPath().getName().startswith("part-")]
    if len(parts) != 1:
        raise IntegrityError(f"expected one part file, found {len(parts)}")
    out_fs, out = _fs(spark, target)
    n = fs.getFileStatus(parts[0]).getLen()
    out_fs.mkdirs(out.getParent())
    _replace(spark, out_fs, parts[0], out)
    fs.delete(path, True)
    _drop_checksum(spark, out_fs, out)
    return n


def _drop_checksum(spark: SparkSession, fs, path) -> None:
    """Local file systems keep a checksum file beside each file; published files need none."""
    if fs.getScheme() == "file":
        spark._jvm.java.nio.file.Files.deleteIfExists(spark._jvm.java.nio.file.Path.of(path.getParent().toUri().getPath(), spark.sparkContext._gateway.new_array(spark._jvm.java.lang.String, 0)).resolve(f".{path.getName()}.crc"))


def beside(target: str) -> str:
    """A temporary folder next to a target, on the same file system."""
    head, _, name = target.rstrip("/").rpartition("/")
    return f"{head or '.'}/.{name}.{uuid.uuid4().hex}"


def publish_file_atomic(spark: SparkSession, local: str, uri: str) -> int:
    """Copy a local file to ``uri`` so that readers see it whole or not at all; return its size."""
    fs, out = _fs(spark, uri)
    temp = spark._jvm.org.apache.hadoop.fs.Path(beside(uri))
    fs.copyFromLocalFile(False, True, spark._jvm.org.apache.hadoop.fs.Path(local), temp)
    n = fs.getFileStatus(temp).getLen()
    _replace(spark, fs, temp, out)
    _drop_checksum(spark, fs, out)
    return n

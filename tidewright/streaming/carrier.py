"""A folder of JSON Lines files as a stream: each micro-batch merges into the registry that the last one left."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.convert import Result, _finished, infer, materialise
from ..options import Options
from ..plans import registry as reg
from ..sources.files import _fs
from ..sources.readers import Reader


def _read(spark: SparkSession, path: str) -> dict | None:
    fs, p = _fs(spark, path)
    return json.loads(spark.read.text(path, wholetext=True).first()[0]) if fs.exists(p) else None


def _write(spark: SparkSession, path: str, registry: dict) -> None:
    fs, p = _fs(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(json.dumps(registry, ensure_ascii=False).encode()))
    out.close()


def convert_stream(spark: SparkSession, folder: str, output: str, checkpoint: str, *, registry_path: str | None = None, on_batch: Callable[[int, Result], None] | None = None, files_per_batch: int | None = None, **given):
    """Convert what is in ``folder`` and not yet converted; the checkpoint remembers which files were.

    A batch is written to a folder of its own, overwritten if the batch is repeated, and the registry after it is kept by
    batch number, so a batch that is repeated after a failure starts from the same registry.
    """
    o = Options.of(**({"input_format": "jsonl"} | given))
    registry_path = registry_path or f"{output.rstrip('/')}_registry"
    read = spark.readStream.format("text")
    if files_per_batch:
        read = read.option("maxFilesPerTrigger", files_per_batch)
    lines = read.load(folder).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("unit"))

    def one(batch: DataFrame, number: int) -> None:
        import datetime as dt

        session = batch.sparkSession
        before = _read(session, f"{registry_path}/{number - 1:012d}.json") if number else None
        stats: dict = {}
        batch = batch.persist()
        try:
            reader = Reader(batch, "jsonl", o)
            inferred, first = infer(reader, stats)
            merged = reg.merge(inferred, before, schema_mode=o.schema_mode, column_order=o.column_order, field_name_policy=o.field_name_policy, default_key=o.scalar_object_key)
            stamp = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
            placed = _finished(materialise(reader, merged.fields, stats), merged.fields, merged, first, stamp)
            result = Result(placed, merged.fields, merged.registry, json.loads(merged.drifts_json), o, stamp, stats)
            result.dataframe.write.mode("overwrite").parquet(f"{output.rstrip('/')}/batch={number}")
            _write(session, f"{registry_path}/{number:012d}.json", merged.registry)
            if on_batch:
                on_batch(number, result)
        finally:
            batch.unpersist()

    return lines.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

"""Helpers around analytical schemas: projection, validation, finalisation, schema differences."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import fields_of
from ..functions.names import ETL_COLUMNS
from ..plans import registry as reg


@dataclass(frozen=True)
class SchemaDiff:
    added_paths: tuple[str, ...]
    removed_paths: tuple[str, ...]
    changed_paths: tuple[str, ...]


@dataclass(frozen=True)
class Validation:
    row_count: int
    schema: T.StructType


@dataclass(frozen=True)
class Finalised:
    dataframe: DataFrame
    schema_registry: dict


def flatten_schema(schema: T.StructType) -> dict[str, str]:
    """Every field path with its type; list items are ``path[]``."""
    out: dict[str, str] = {}

    def walk(fields, parent: str):
        for f in fields:
            path = f"{parent}.{f.name}" if parent else f.name
            out[path] = f.dataType.simpleString()
            t = f.dataType
            if isinstance(t, T.ArrayType):
                path, t = path + "[]", t.elementType
                out[path] = t.simpleString()
            if isinstance(t, T.StructType):
                walk(t.fields, path)

    walk(schema.fields, "")
    return out


def diff_schemas(before: T.StructType, after: T.StructType) -> SchemaDiff:
    a, b = flatten_schema(before), flatten_schema(after)
    return SchemaDiff(tuple(sorted(b.keys() - a.keys())), tuple(sorted(a.keys() - b.keys())), tuple(sorted(p for p in a.keys() & b.keys() if a[p] != b[p])))


def project_ingress_scalar_schema(schema: T.StructType, *, include_fields: set[str] | None = None, exclude_generated: bool = True) -> T.StructType:
    """The scalar fields of a final schema, for reading wide text sources."""
    if include_fields and (missing := sorted(include_fields - set(schema.names))):
        raise ValueError(f"include_fields has unknown fields: {missing}")
    dropped = set(ETL_COLUMNS) if exclude_generated else set()
    nested = (T.StructType, T.ArrayType, T.MapType)
    return T.StructType([f for f in schema.fields if f.name not in dropped and (include_fields is None or f.name in include_fields) and not isinstance(f.dataType, nested)])


def validate_analytical_result(data: DataFrame, expected: T.StructType) -> Validation:
    """Order, names, nullability and types have to be exactly as expected."""
    if data.schema != expected:
        diff = diff_schemas(expected, data.schema)
        raise ValueError(f"schema mismatch: added {diff.added_paths}, removed {diff.removed_paths}, changed {diff.changed_paths}, or another order or nullability")
    return Validation(data.count(), data.schema)


def finalize_analytical_output(data: DataFrame, expected: T.StructType, *, field_name_policy: str = "lower_snake", detected_at: str = "") -> Finalised:
    """Cast to a final schema under a registry of its own, which then stands on every row."""
    own = [c for c in data.columns if c not in ("schema_registry", "schema_drifts")]
    wanted = [f for f in expected.fields if f.name not in ("schema_registry", "schema_drifts")]
    if extra := sorted(set(own) ^ {f.name for f in wanted}):
        raise ValueError(f"columns that only one side has: {extra}")
    merged = reg.merge(fields_of(T.StructType([f for f in wanted if f.name not in ETL_COLUMNS])), field_name_policy=field_name_policy, detected_at=detected_at, column_order="schema_contract_first")
    made = {"schema_registry": F.lit(merged.registry_json), "schema_drifts": F.lit(merged.drifts_json)}
    out = data.select(*[made[f.name].alias(f.name) if f.name in made else F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in expected.fields])
    return Finalised(out, merged.registry)


def without_fields(data: DataFrame, fields) -> DataFrame:
    """``data`` without partition or generated columns."""
    return data.drop(*fields)


def latest_registry(rows: DataFrame, partition_columns: tuple[str, ...] = (), registry: str = "schema_registry", stamp: str = "ingestion_timestamp") -> DataFrame:
    """The newest registry: by ingestion time, then generation, then partition."""
    generation = F.get_json_object(registry, "$.schema_generation").cast("bigint")
    return rows.filter(F.col(registry).isNotNull()).orderBy(F.desc(stamp), generation.desc(), *[F.desc(c) for c in partition_columns]).limit(1).select(registry)


def upsert(target: DataFrame, source: DataFrame, key: str) -> DataFrame:
    """Rows of ``target`` replaced by those of ``source`` with the same key, and the new ones added."""
    s = source.select(*[F.col(f"`{c}`").alias(f"__new_{c}") for c in target.columns]).withColumn("__found", F.lit(True))
    both = target.join(s, target[key] == s[f"__new_{key}"], "full_outer")
    return both.select(*[F.when(F.col("__found"), F.col(f"__new_{c}")).otherwise(target[c]).alias(c) for c in target.columns])


def merge_registry(registry: Mapping | str | None, data: DataFrame, **how) -> reg.Merged:
    """Merge a typed DataFrame's schema into a registry."""
    return reg.merge(fields_of(data.schema), registry, **how)

"""Conversion of messy data to DataFrames and files with a stable, versioned schema, on Spark."""

from .errors import CancelledError, IntegrityError, InvalidArgumentError, MissingDependencyError, OutOfMemoryError, ResourceError, TidewrightError
from .operators.analytical import diff_schemas, finalize_analytical_output, latest_registry, project_ingress_scalar_schema, upsert, validate_analytical_result
from .operators.convert import Result, Sanitizer, sanitize
from .operators.operation import CancellationToken, operation_cancellation, process_operation_diagnostics
from .operators.writers import iter_batches, to_csv, to_duckdb, to_jsonl, to_pandas, to_parquet, to_polars, to_pyarrow
from .options import CsvOptions, Options, ParquetOptions, ParsingOptions, ResourceOptions, SanitizeOptions
from .plans.registry import arrow_schema_from_schema_registry, new_schema_registry, schema_registry_from_arrow_schema
from .sources import RemoteFile, SourceManifest, discover, list_objects, publish_file_atomic

__version__ = "0.1.0"

__all__ = [
    "CancellationToken", "CancelledError", "CsvOptions", "IntegrityError", "InvalidArgumentError", "MissingDependencyError", "Options", "OutOfMemoryError",
    "ParquetOptions", "ParsingOptions", "RemoteFile", "ResourceError", "ResourceOptions", "Result", "SanitizeOptions", "Sanitizer", "SourceManifest",
    "TidewrightError", "arrow_schema_from_schema_registry", "diff_schemas", "discover", "finalize_analytical_output", "iter_batches", "latest_registry",
    "list_objects", "new_schema_registry", "operation_cancellation", "process_operation_diagnostics", "project_ingress_scalar_schema", "publish_file_atomic",
    "sanitize", "schema_registry_from_arrow_schema", "to_csv", "to_duckdb", "to_jsonl", "to_pandas", "to_parquet", "to_polars", "to_pyarrow", "upsert",
    "validate_analytical_result",
]

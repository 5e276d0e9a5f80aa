"""Options of all conversions, checked on the driver."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, fields

from .errors import InvalidArgumentError
from .functions.names import POLICIES

FORMATS = ("csv", "json", "json_array", "jsonl", "xml", "parquet", "python")
ENCODINGS = ("utf-8", "utf-16", "utf-16-le", "utf-16-be", "iso8859-1")
MEMORY_CEILING = 64 << 30
DEEPEST = 512


@dataclass(frozen=True)
class Options:
    """Every conversion option, flat."""

    input_format: str | None = None
    input_mode: str = "single_file"
    schema_mode: str = "additive"
    column_order: str = "alphabetically"
    field_name_policy: str = "lower_alpha"
    scalar_object_key: str = "default_key"
    arrow_max_depth: int = 32
    parquet_max_depth: int = 15
    parse_integers: bool = False
    parse_floats: bool = False
    parse_float_decimal_separator: str = "."
    parse_float_thousands_separator: str = ","
    true_tokens: tuple[str, ...] = ()
    false_tokens: tuple[str, ...] = ()
    parse_iso_timestamps: bool = False
    parse_iso_dates: bool = False
    parse_iso_times: bool = False
    custom_timestamp_patterns: tuple[str, ...] = ()
    custom_date_patterns: tuple[str, ...] = ()
    custom_time_patterns: tuple[str, ...] = ()
    timestamp_precision: str = "TIMESTAMP_MICROS"
    csv_has_header: bool = True
    csv_delimiter: str = ","
    csv_escape_char: str | None = None
    csv_header_mode: str = "exact"
    input_text_encoding: str = "utf-8"
    xml_row_tag: str | None = None
    on_error: str = "emit_null_row"
    multi_threading: bool = False
    memory_limit_bytes: int | None = None

    def __post_init__(self):
        def need(ok: bool, what: str):
            if not ok:
                raise InvalidArgumentError(what)

        def one_of(name: str, allowed: tuple):
            need(getattr(self, name) in allowed, f"{name} must be one of {', '.join(map(repr, allowed))}")

        for name in ("true_tokens", "false_tokens", "custom_timestamp_patterns", "custom_date_patterns", "custom_time_patterns"):
            need(not isinstance(getattr(self, name), (str, bytes)), f"{name} must be a sequence of strings")
            object.__setattr__(self, name, tuple(getattr(self, name)))
        need(self.input_format is None or self.input_format in FORMATS, f"input_format must be one of {', '.join(FORMATS)}; it is never guessed")
        one_of("input_mode", ("single_file", "directory"))
        one_of("schema_mode", ("additive", "strict"))
        one_of("column_order", ("alphabetically", "schema_contract_first"))
        one_of("field_name_policy", POLICIES)
        one_of("timestamp_precision", ("TIMESTAMP_MILLIS", "TIMESTAMP_MICROS", "TIMESTAMP_NANOS"))
        need(self.timestamp_precision != "TIMESTAMP_NANOS", "TIMESTAMP_NANOS cannot be held by Spark's microsecond timestamps")
        one_of("csv_header_mode", ("exact", "union"))
        one_of("on_error", ("stop", "skip_row", "emit_null_row"))
        need(self.input_text_encoding.lower().replace("_", "-") in ENCODINGS, f"input_text_encoding must be one of {', '.join(ENCODINGS)}")
        need(bool(self.scalar_object_key), "scalar_object_key must not be empty")
        need(1 <= self.arrow_max_depth <= DEEPEST and 0 <= self.parquet_max_depth <= DEEPEST, f"depths must be at most {DEEPEST}")
        for name in ("parse_float_decimal_separator", "parse_float_thousands_separator"):
            c = getattr(self, name)
            need(len(c) == 1 and c.isascii() and c.isprintable() and not c.isalnum() and c not in "+- ", f"{name} must be one ASCII punctuation character other than + and -")
        need(self.parse_float_decimal_separator != self.parse_float_thousands_separator, "the decimal and thousands separators must differ")
        need(not {t.lower() for t in self.true_tokens} & {t.lower() for t in self.false_tokens}, "true_tokens and false_tokens overlap")
        need(len(self.csv_delimiter.encode()) == 1 and self.csv_delimiter not in '"\r\n', "csv_delimiter must be one byte other than a quote or line end")
        need(self.csv_escape_char is None or (len(self.csv_escape_char.encode()) == 1 and self.csv_escape_char not in '"\r\n' + self.csv_delimiter), "csv_escape_char must be one byte of its own")
        need(self.memory_limit_bytes is None or 0 < self.memory_limit_bytes <= MEMORY_CEILING, "memory_limit_bytes must be positive and at most 64 GiB")
        need(self.xml_row_tag is None or re.fullmatch(r"[A-Za-z_][\w.:-]*", self.xml_row_tag) is not None, "xml_row_tag must be an element name")
        for name, least, most in (("custom_timestamp_patterns", 6, 8), ("custom_date_patterns", 3, 3), ("custom_time_patterns", 3, 3)):
            for p in getattr(self, name):
                try:
                    groups = re.compile(p).groups
                except re.error as e:
                    raise InvalidArgumentError(f"{name}: {e}") from None
                need(least <= groups <= most, f"{name} need {least} to {most} groups")

    @classmethod
    def of(cls, **given) -> Options:
        known = {f.name for f in fields(cls)}
        if unknown := sorted(set(given) - known):
            raise InvalidArgumentError(f"unknown options: {', '.join(unknown)}")
        return cls(**given)


@dataclass(frozen=True)
class CsvOptions:
    has_header: bool = True
    delimiter: str = ","
    escape_char: str | None = None
    header_mode: str = "exact"


@dataclass(frozen=True)
class ParsingOptions:
    integers: bool = False
    floats: bool = False
    float_decimal_separator: str = "."
    float_thousands_separator: str = ","
    iso_timestamps: bool = False
    iso_dates: bool = False
    iso_times: bool = False
    true_tokens: tuple[str, ...] = ()
    false_tokens: tuple[str, ...] = ()
    timestamp_patterns: tuple[str, ...] = ()
    date_patterns: tuple[str, ...] = ()
    time_patterns: tuple[str, ...] = ()


@dataclass(frozen=True)
class ResourceOptions:
    multi_threading: bool = False
    memory_limit_bytes: int | None = None


@dataclass(frozen=True)
class ParquetOptions:
    compression: str | None = "gzip"
    gzip_level: int | None = None


_PARSING_PLAIN = ("true_tokens", "false_tokens")
_PARSING_PATTERNS = ("timestamp_patterns", "date_patterns", "time_patterns")


@dataclass(frozen=True)
class SanitizeOptions:
    """Reusable options, grouped."""

    input_format: str | None = None
    input_mode: str = "single_file"
    schema_mode: str = "additive"
    column_order: str = "alphabetically"
    field_name_policy: str = "lower_alpha"
    timestamp_precision: str = "TIMESTAMP_MICROS"
    arrow_max_depth: int = 32
    parquet_max_depth: int = 15
    scalar_object_key: str = "default_key"
    input_text_encoding: str = "utf-8"
    xml_row_tag: str | None = None
    on_error: str = "emit_null_row"
    csv: CsvOptions = field(default_factory=CsvOptions)
    parsing: ParsingOptions = field(default_factory=ParsingOptions)
    resources: ResourceOptions = field(default_factory=ResourceOptions)

    def flat(self) -> dict:
        """The same as keyword arguments of the converters."""
        out = {f.name: getattr(self, f.name) for f in fields(self) if f.name not in ("csv", "parsing", "resources")}
        out |= {f"csv_{f.name}": getattr(self.csv, f.name) for f in fields(self.csv)}
        for f in fields(self.parsing):
            name = f.name if f.name in _PARSING_PLAIN else f"custom_{f.name}" if f.name in _PARSING_PATTERNS else f"parse_{f.name}"
            out[name] = getattr(self.parsing, f.name)
        return out | {f.name: getattr(self.resources, f.name) for f in fields(self.resources)}

"""Partition pipelines: planning Hive or modification-time partitions and running them with the registry carried on."""

from __future__ import annotations

import datetime as dt
import re
import time
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InvalidArgumentError
from ..sources.files import RemoteFile, SourceManifest, _fs, discover

RETENTION = ("full", "metadata_only", "streaming")


@dataclass(frozen=True, order=True)
class UtcWindow:
    """A half-open time window, in UTC; times without a zone are refused."""

    start: dt.datetime
    end: dt.datetime

    def __post_init__(self):
        for name in ("start", "end"):
            v = getattr(self, name)
            if v.utcoffset() is None:
                raise InvalidArgumentError(f"a window's {name} needs a time zone")
            object.__setattr__(self, name, v.astimezone(dt.timezone.utc))
        if self.start >= self.end:
            raise InvalidArgumentError("a window must start before it ends")

    def contains(self, moment: dt.datetime) -> bool:
        return self.start <= moment < self.end

    @property
    def logical_date(self) -> dt.date:
        return self.start.date()


def build_utc_daily_windows(start: dt.date, end: dt.date) -> tuple[UtcWindow, ...]:
    """A window for each day from ``start`` to ``end``, both included."""
    if isinstance(start, dt.datetime) or isinstance(end, dt.datetime):
        raise TypeError("dates are needed, not times")
    if start > end:
        raise InvalidArgumentError("the first day must not be after the last")
    marks = [dt.datetime.combine(start, dt.time(), dt.timezone.utc) + dt.timedelta(days=i) for i in range((end - start).days + 2)]
    return tuple(map(UtcWindow, marks, marks[1:]))


def check_windows(windows: Iterable[UtcWindow]) -> list[UtcWindow]:
    windows = sorted(windows)
    if any(a.end > b.start for a, b in zip(windows, windows[1:])):
        raise InvalidArgumentError("windows overlap")
    return windows


def assign_files(files: Iterable[RemoteFile], windows: Iterable[UtcWindow]) -> dict[UtcWindow, list[RemoteFile]]:
    """Files by the window that their modification time falls in; windows without files are left out."""
    windows = check_windows(windows)
    starts = [w.start for w in windows]
    out: dict[UtcWindow, list[RemoteFile]] = {}
    for f in files:
        i = bisect_right(starts, f.updated) - 1
        if i >= 0 and windows[i].contains(f.updated):
            out.setdefault(windows[i], []).append(f)
    return dict(sorted(out.items()))


def assign_windows(rows: DataFrame, stamp: str, start: dt.date, end: dt.date) -> DataFrame:
    """Rows of the days from ``start`` to ``end`` with their ``window_start`` and ``window_end``; no shuffle."""
    day = F.date_trunc("day", F.col(stamp)).cast("timestamp_ntz")
    first, last = (F.lit(dt.datetime.combine(d, dt.time())).cast("timestamp_ntz") for d in (start, end + dt.timedelta(days=1)))
    kept = rows.filter((F.col(stamp) >= first) & (F.col(stamp) < last))
    return kept.withColumns({"window_start": day, "window_end": day + F.expr("interval 1 day")})


def partition_points(start: dt.date, end: dt.date, granularity: str = "daily", start_hour: int = 0, end_hour: int = 23) -> Iterator[tuple[dt.date, int | None]]:
    if start > end:
        raise InvalidArgumentError("the first day must not be after the last")
    if granularity not in ("daily", "hourly"):
        raise InvalidArgumentError("granularity must be daily or hourly")
    if not 0 <= start_hour <= end_hour <= 23:
        raise InvalidArgumentError("hours must be in order and between 0 and 23")
    for i in range((end - start).days + 1):
        d = start + dt.timedelta(days=i)
        yield from ((d, h) for h in range(start_hour, end_hour + 1)) if granularity == "hourly" else ((d, None),)


def points_frame(spark: SparkSession, start: dt.date, end: dt.date) -> DataFrame:
    """Daily partition points as a DataFrame."""
    return spark.range(1).select(F.explode(F.sequence(F.lit(start), F.lit(end))).alias("date"))


def _values(d: dt.date, hour: int | None) -> dict[str, str]:
    out = {"date": d.isoformat(), "yyyymmdd": f"{d:%Y%m%d}", "year": f"{d:%Y}", "month": f"{d:%m}", "day": f"{d:%d}"}
    return out | ({"hour": f"{hour:02d}", "hh": f"{hour:02d}", "yyyymmddhh": f"{d:%Y%m%d}{hour:02d}"} if hour is not None else {})


def render(template: str, d: dt.date, hour: int | None = None) -> str:
    """A concrete uri: placeholders filled in, or the date and hour of a concrete uri moved on."""
    values = _values(d, hour)
    filled = template
    for k, v in values.items():
        filled = filled.replace("{" + k + "}", v)
    if left := re.search(r"\{(\w+)\}", filled):
        raise InvalidArgumentError(f"placeholder {left[0]} has no value here")
    if filled != template:
        if hour is not None and not re.search(r"\{(hour|hh|yyyymmddhh)\}", template):
            raise InvalidArgumentError("hourly templates need an hour placeholder")
        return filled
    anchor = re.search(r"([0-9]{4})-([0-9]{2})-([0-9]{2})", template)
    if not anchor:
        raise InvalidArgumentError("the uri needs placeholders or a date to move on")
    old = dt.date(*map(int, anchor.groups()))
    moved = template.replace(anchor[0], values["date"]).replace(f"{old:%Y%m%d}", values["yyyymmdd"])
    for name in ("year", "month", "day"):
        moved = re.sub(rf"(?<=/){name}=[0-9]+", f"{name}={values[name]}", moved)
    if hour is not None:
        if "hour=" not in moved:
            raise InvalidArgumentError("hourly uris need an hour=HH folder")
        moved = re.sub(r"(?<=/)hour=[0-9]+", f"hour={values['hour']}", moved)
    return moved


def partition_folder(prefix: str, d: dt.date, hour: int | None = None) -> str:
    v = _values(d, hour)
    folder = f"{prefix.rstrip('/')}/year={v['year']}/month={v['month']}/date={v['date']}"
    return folder + (f"/hour={v['hour']}" if hour is not None else "")


def partition_file(prefix: str, name: str, extension: str, d: dt.date, hour: int | None = None) -> str:
    v = _values(d, hour)
    tail = v["yyyymmdd"] + (f"_{v['hour']}" if hour is not None else "")
    return f"{partition_folder(prefix, d, hour)}/{name}_{tail}.{extension.lstrip('.')}"


@dataclass(frozen=True)
class PartitionPlan:
    """One partition: its source (a path or a manifest), its output, its place in time."""

    source: str | SourceManifest
    output_uri: str
    date: dt.date | None = None
    hour: int | None = None
    input_mode: str = "single_file"


@dataclass(frozen=True)
class HiveRangeConfig:
    source_prefix: str | None = None
    output_prefix: str | None = None
    source_uri: str | None = None
    output_uri: str | None = None
    start_date: dt.date | None = None
    end_date: dt.date | None = None
    start_hour: int = 0
    end_hour: int = 23
    partition_granularity: str = "daily"
    input_format: str = "json_array"
    input_mode: str = "single_file"
    file_name_prefix: str | None = None
    source_file_extension: str | None = None
    output_file_extension: str = "parquet"


_EXTENSIONS = {"csv": "csv", "json": "json", "json_array": "json", "jsonl": "jsonl", "xml": "xml", "parquet": "parquet"}


def build_hive_range_plan(c: HiveRangeConfig) -> list[PartitionPlan]:
    by_prefix = bool(c.source_prefix or c.output_prefix)
    if by_prefix == bool(c.source_uri or c.output_uri) or not ((c.source_prefix and c.output_prefix) or (c.source_uri and c.output_uri)):
        raise InvalidArgumentError("give both prefixes or both uris")
    if (c.start_date is None) != (c.end_date is None):
        raise InvalidArgumentError("give both dates or none")
    if c.start_date is None:
        if by_prefix:
            raise InvalidArgumentError("prefixes need dates")
        return [PartitionPlan(c.source_uri, c.output_uri, input_mode=c.input_mode)]
    name = c.file_name_prefix or (c.source_prefix.rstrip("/").rsplit("/", 1)[-1] if by_prefix else "")
    extension = c.source_file_extension or _EXTENSIONS[c.input_format]
    plans = []
    for d, h in partition_points(c.start_date, c.end_date, c.partition_granularity, c.start_hour, c.end_hour):
        if by_prefix:
            source = partition_folder(c.source_prefix, d, h) if c.input_mode == "directory" else partition_file(c.source_prefix, name, extension, d, h)
            output = partition_file(c.output_prefix, name, c.output_file_extension, d, h)
        else:
            source, output = render(c.source_uri, d, h), render(c.output_uri, d, h)
        plans.append(PartitionPlan(source, output, d, h, c.input_mode))
    return unique_outputs(plans)


def unique_outputs(plans: list[PartitionPlan]) -> list[PartitionPlan]:
    seen: set[str] = set()
    for p in plans:
        if p.output_uri in seen:
            raise InvalidArgumentError("two partitions have one output")
        seen.add(p.output_uri)
    return plans


def existing(spark: SparkSession, plans: Iterable[PartitionPlan]) -> tuple[list[PartitionPlan], list[PartitionPlan]]:
    """Plans whose sources exist, and those whose sources are missing."""
    there, missing = [], []
    for p in plans:
        ok = isinstance(p.source, SourceManifest)
        if not ok:
            fs, path = _fs(spark, p.source)
            ok = fs.exists(path)
        (there if ok else missing).append(p)
    return there, missing


@dataclass
class PartitionRun:
    plan: PartitionPlan
    seconds: float
    drift_count: int
    schema_registry: dict | None
    result: object | None = None


@dataclass
class PipelineRun:
    partitions: list[PartitionRun] = field(default_factory=list)
    missing: list[PartitionPlan] = field(default_factory=list)
    schema_registry: dict | None = None


def run_partitioned_to_parquet(spark: SparkSession, plans: Iterable[PartitionPlan], *, schema_registry=None, options_for: Callable[[PartitionPlan], dict] | None = None, after_partition: Callable[[PartitionRun], None] | None = None, retention: str = "metadata_only", parallel: bool = False, **options) -> PipelineRun:
    """Convert partition by partition, in order; each starts from the registry that its predecessor left."""
    from ..operators.writers import to_parquet

    if retention not in RETENTION:
        raise InvalidArgumentError(f"retention must be one of {', '.join(RETENTION)}")
    out = PipelineRun(schema_registry=schema_registry)
    there, out.missing = existing(spark, list(plans))
    for p in there:
        begin = time.perf_counter()
        own = {"input_mode": "single_file" if isinstance(p.source, SourceManifest) else p.input_mode} | options | (options_for(p) if options_for else {})
        result = to_parquet(spark, p.source, p.output_uri, schema_registry=out.schema_registry, parallel=parallel, **own)
        out.schema_registry = result.schema_registry
        run = PartitionRun(p, time.perf_counter() - begin, len(result.schema_drifts), result.schema_registry, result if retention == "full" else None)
        if after_partition:
            after_partition(run)
        if retention != "streaming":
            out.partitions.append(run)
    return out


def warm_up_registry(spark: SparkSession, sources: Iterable, *, schema_registry=None, **options) -> dict | None:
    """Infer and merge every source additively; nothing is written."""
    from ..operators.convert import sanitize

    for s in sources:
        schema_registry = sanitize(spark, s, schema_registry=schema_registry, **options).schema_registry
    return schema_registry


@dataclass(frozen=True)
class HivePartitions:
    start: dt.date
    end: dt.date
    granularity: str = "daily"
    start_hour: int = 0
    end_hour: int = 23
    file_name_prefix: str | None = None
    source_file_extension: str | None = None
    output_file_extension: str = "parquet"


@dataclass(frozen=True)
class ModifiedTimePartitions:
    start: dt.date
    end: dt.date
    suffixes: tuple[str, ...] = ("csv",)


@dataclass(frozen=True)
class ParquetPipeline:
    """Plan and run the partitions of one source prefix."""

    spark: SparkSession
    source: str
    output: str
    partitions: HivePartitions | ModifiedTimePartitions
    options: dict = field(default_factory=dict)

    def plan(self) -> list[PartitionPlan]:
        p = self.partitions
        if isinstance(p, ModifiedTimePartitions):
            manifest = discover(self.spark, self.source, p.suffixes)
            found = assign_files(manifest.files, build_utc_daily_windows(p.start, p.end))
            return unique_outputs([PartitionPlan(replace(manifest, files=tuple(fs)), partition_file(self.output, "part", "parquet", w.logical_date), w.logical_date) for w, fs in found.items()])
        own = {"file_name_prefix": p.file_name_prefix, "source_file_extension": p.source_file_extension, "output_file_extension": p.output_file_extension}
        uris = {"source_uri": self.source, "output_uri": self.output} if "{" in self.source else {"source_prefix": self.source, "output_prefix": self.output}
        return build_hive_range_plan(HiveRangeConfig(**uris, **own, start_date=p.start, end_date=p.end, start_hour=p.start_hour, end_hour=p.end_hour, partition_granularity=p.granularity, input_format=self.options.get("input_format", "json_array"), input_mode=self.options.get("input_mode", "single_file")))

    def run(self, **how) -> PipelineRun:
        return run_partitioned_to_parquet(self.spark, self.plan(), **(self.options | how))


def format_duration(seconds: float) -> str:
    """``4.2s``, ``1m 1s``, ``2h 0m 5s``; negative times count as none."""
    left, parts = max(0.0, seconds), []
    for unit, size in (("h", 3600), ("m", 60)):
        n, left = divmod(left, size)
        if n or parts:
            parts.append(f"{n:.0f}{unit}")
    return " ".join([*parts, f"{left:.0f}s" if parts else f"{left:.1f}s"])


def cpu_share(wall: float, cpu: float) -> tuple[float, float]:
    """Percentages of wall time spent computing and waiting; they add up to 100."""
    if wall <= 0:
        return 0.0, 100.0
    _, busy, _ = sorted((0.0, round(100 * cpu / wall, 1), 100.0))
    return busy, round(100 - busy, 1)


def compact_uri(uri: str, most: int = 96) -> str:
    """A long uri without its middle: a third of what stays is its beginning, the rest its end."""
    room = most - len("...")
    cut = len(uri) - room
    return uri if len(uri) <= most else "...".join((uri[: room // 3], uri[room // 3 + cut :]))


def summary(run: PartitionRun) -> str:
    """One line about a partition, without any of its values."""
    return f"{compact_uri(run.plan.output_uri)} {format_duration(run.seconds)} drifts={run.drift_count}"

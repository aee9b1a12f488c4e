"""Usage sources: declared schemas, preflight, and rows turned into valid, scaled observations."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class ResourceRule:
    """An output channel: a source column times scale, valid within [valid_min, valid_max] before scaling."""

    name: str
    column: str
    scale: float = 1.0
    valid_min: float | None = None
    valid_max: float | None = None

    def raw(self) -> Column:
        return F.col(self.column).try_cast("double")

    def valid(self) -> Column:
        x = self.raw()
        ok = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
        if self.valid_min is not None:
            ok &= x >= self.valid_min
        if self.valid_max is not None:
            ok &= x <= self.valid_max
        return ok


@dataclass(frozen=True)
class SourceSpec:
    """Where usage rows are and how to read them. columns names a headerless file's columns by place."""

    path: str
    key: str
    time: str
    rules: tuple[ResourceRule, ...]
    node: str | None = None
    fmt: str = "parquet"
    header: bool = True
    delimiter: str = ","
    columns: tuple[str, ...] = ()
    time_unit: str = "seconds"
    extra: tuple[str, ...] = field(default=())

    def required(self) -> list[str]:
        wanted = [self.key, self.time, *([self.node] if self.node else []), *(r.column for r in self.rules), *self.extra]
        return list(dict.fromkeys(wanted))


def read_source(spark: SparkSession, spec: SourceSpec | SideSpec) -> DataFrame:
    """The required columns only. CSV is read as text, so that dirty values fail no read; blank and short rows have null keys and go."""
    if spec.fmt == "csv":
        reader = spark.read.option("sep", spec.delimiter).option("mode", "PERMISSIVE").option("header", spec.header)
        if spec.columns:
            reader = reader.schema(T.StructType([T.StructField(c, T.StringType()) for c in spec.columns]))
        return reader.csv(spec.path).select(*spec.required()).where(F.col(spec.key).isNotNull())
    return spark.read.format(spec.fmt).load(spec.path).select(*spec.required())


def preflight(spark: SparkSession, spec: SourceSpec | SideSpec) -> dict:
    """Whether the source exists, can be read and has the columns it declares."""
    report = {"path": spec.path, "readable": False, "columns": [], "missing": spec.required(), "ok": False}
    try:
        if spec.fmt == "csv" and spec.columns:
            spark.read.text(spec.path).schema
            names = list(spec.columns)
        else:
            names = (spark.read.option("header", True).csv(spec.path) if spec.fmt == "csv" else spark.read.format(spec.fmt).load(spec.path)).columns
    except Exception as e:  # the report is the answer
        return report | {"error": type(e).__name__}
    missing = [c for c in spec.required() if c not in names]
    return report | {"readable": True, "columns": names, "missing": missing, "ok": not missing}


def resolve(spark: SparkSession, specs: list[SourceSpec], needed: bool = True) -> SourceSpec | None:
    """The first source, in order of priority, that passes preflight. None passes: an error, or None where it is not needed."""
    reports = [preflight(spark, s) for s in specs]
    for spec, report in zip(specs, reports):
        if report["ok"]:
            return spec
    if not needed:
        return None
    raise ValueError(f"no usable source: {reports}")


@dataclass(frozen=True)
class SideSpec:
    """A deployment or link source: the columns it must have, and how to read it. preflight and resolve take it as well."""

    path: str
    wanted: tuple[str, ...]
    fmt: str = "parquet"
    header: bool = True
    delimiter: str = ","
    columns: tuple[str, ...] = ()

    @property
    def key(self) -> str:
        return self.wanted[0]

    def required(self) -> list[str]:
        return list(self.wanted)


def bucket(t: Column, size: int) -> Column:
    """Tumbling bucket of a time; floors below zero too."""
    return F.floor(t / size).cast("long")


def observations(rows: DataFrame, spec: SourceSpec, start: int | None = None, end: int | None = None, step: int = 60) -> DataFrame:
    """Valid rows as (workload, t, [node], channels): a row goes whole if any used value is not finite or out of bounds,
    or if its bucketed time is outside [start, end). t is the bucket's number."""
    t = F.col(spec.time).try_cast("double")
    t = bucket(t, step) if spec.time_unit == "seconds" else F.floor(t).cast("long")
    ok = F.col(spec.key).isNotNull() & t.isNotNull()
    for r in spec.rules:
        ok &= r.valid()
    if start is not None:
        ok &= t * step >= start
    if end is not None:
        ok &= t * step < end
    node = [F.trim(F.col(spec.node).cast("string")).alias("node")] if spec.node else []
    return rows.where(ok).select(F.col(spec.key).alias("workload"), t.alias("t"), *node, *((r.raw() * r.scale).alias(r.name) for r in spec.rules), *spec.extra)


def select_workloads(rows: DataFrame, chosen: DataFrame, key: str = "workload") -> DataFrame:
    """Semi-join by selected ids. The selection is a bounded parameter (hundreds of ids), so Spark may broadcast it by its own threshold."""
    return rows.join(chosen.select(key).distinct(), key, "left_semi")

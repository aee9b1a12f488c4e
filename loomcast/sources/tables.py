"""Side tables and sinks: prepared bundles, links, portable exports."""

from __future__ import annotations

import json
import math
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def last_wins(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of duplicate keys the row that comes last by order."""
    rest = [c for c in df.columns if c not in (*keys, order)]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*")


def first_wins(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    rest = [c for c in df.columns if c not in (*keys, order)]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*")


def load_prepared(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(resources, deployment) of a prepared folder."""
    return spark.read.parquet(f"{folder}/resources"), spark.read.parquet(f"{folder}/deployment")


def write_prepared(resources: DataFrame, deployment: DataFrame, folder: str) -> None:
    resources.write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/resources")
    deployment.write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/deployment")


def write_bundle(df: DataFrame, path: str, formats: tuple[str, ...] = ("parquet", "csv"), partition_by: tuple[str, ...] = ()) -> None:
    """One table in several formats; nested cells become JSON text for CSV."""
    for fmt in formats:
        out = df
        if fmt == "csv":
            out = df.select(*[F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in df.dtypes])
        writer = out.write.mode("overwrite").option("header", True)
        (writer.partitionBy(*partition_by) if partition_by else writer).format(fmt).save(f"{path}/{fmt}")


def json_safe(x):
    """NaN and infinities as null, all the way down."""
    if isinstance(x, dict):
        return {str(k): json_safe(v) for k, v in x.items()}
    if isinstance(x, (list, tuple)):
        return [json_safe(v) for v in x]
    return None if isinstance(x, float) and not math.isfinite(x) else x


def write_json(x, path: str) -> None:
    """Strict JSON, written whole or not at all."""
    part = f"{path}.{uuid.uuid4().hex}"
    with open(part, "w") as f:
        json.dump(json_safe(x), f, sort_keys=True, allow_nan=False)
    os.replace(part, path)


def copy_whole(spark: SparkSession, source: str, to: str) -> None:
    """A byte copy of a file that is there whole or not at all: written beside its place and renamed."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    conf, a, b = spark._jsc.hadoopConfiguration(), path(source), path(to)
    part = path(f"{to}.{uuid.uuid4().hex}")
    spark._jvm.org.apache.hadoop.fs.FileUtil.copy(a.getFileSystem(conf), a, b.getFileSystem(conf), part, False, conf)
    fs = b.getFileSystem(conf)
    if fs.exists(b):
        fs.delete(b, False)
    if not fs.rename(part, b):
        raise OSError(f"cannot rename to {to}")


def link_table(rows: DataFrame, values: list[str], order: str) -> DataFrame:
    """(src, dst, values, live): of repeated links the last by order; live where all values are finite and not all are 0."""
    last = last_wins(rows.select("src", "dst", *values, order).dropna(subset=["src", "dst"]), ["src", "dst"], order)
    live = sum((F.abs(v) for v in values[1:]), F.abs(values[0])) > 0
    for v in values:
        x = F.col(v).cast("double")
        live = live & x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return last.withColumn("live", F.coalesce(live, F.lit(False)))


def deployment_nodes(rows: DataFrame, workloads: DataFrame, order: str) -> DataFrame:
    """(workload, node) of the workloads asked for, each its first row by order. A workload without one is an error."""
    found = first_wins(rows.select("workload", "node", order).dropna(subset=["workload", "node"]), ["workload"], order)
    asked = workloads.select("workload").distinct()
    lost = [r[0] for r in asked.join(found, "workload", "left_anti").orderBy("workload").limit(5).collect()]
    if lost:
        raise ValueError(f"workloads without a deployment: {lost}")
    return asked.join(found, "workload")


def manifest(df: DataFrame, keys: list[str]) -> DataFrame:
    """(rows, digest): an order-free fingerprint of a table's content."""
    row = F.sha2(F.to_json(F.struct(*sorted(df.columns))).cast("binary"), 256)
    return df.select(F.conv(F.substring(row, 1, 12), 16, 10).cast("decimal(38,0)").alias("h")).agg(F.count("h").alias("rows"), F.sum("h").cast("string").alias("digest"))

"""Buckets, statistics, selection, dense grids, filling, normalising, splits and origins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranges import ranged


def bucket_means(obs: DataFrame, channels: list[str]) -> DataFrame:
    """(workload, t, n, channels): the mean of each channel in each bucket."""
    return obs.groupBy("workload", "t").agg(F.count(F.lit(1)).alias("n"), *(F.avg(c).alias(c) for c in channels))


def majority_node(obs: DataFrame) -> DataFrame:
    """(workload, node): the node with most rows, of equals the least."""
    counts = obs.groupBy("workload", "node").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("workload").agg(F.min_by("node", F.struct(-F.col("n"), F.col("node"))).alias("node"))


def workload_stats(obs: DataFrame) -> DataFrame:
    """(workload, n_rows, points, first_t, last_t, span): points are distinct buckets."""
    return obs.groupBy("workload").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("t").alias("points"), F.min("t").alias("first_t"), F.max("t").alias("last_t"), (F.max("t") - F.min("t")).alias("span"))


def top_workloads(stats: DataFrame, n: int, lexical: bool = False) -> DataFrame:
    order = [F.col("workload")] if lexical else [F.desc("points"), F.desc("n_rows"), F.desc("span"), F.col("workload")]
    return stats.orderBy(*order).limit(n)


def full_span(obs: DataFrame, start: int, points: int, required: int) -> DataFrame:
    """Workloads with at least required distinct buckets in [start, start + points)."""
    inside = obs.where((F.col("t") >= start) & (F.col("t") < start + points))
    return inside.groupBy("workload").agg(F.countDistinct("t").alias("covered")).where(F.col("covered") >= required)


def dense_grid(means: DataFrame, start: int, end: int) -> DataFrame:
    """Every workload at every slot of [start, end): what was not observed is null, never imputed.

    Slots are generated per workload with explode, so the grid needs one equi-join and no cross join.
    """
    slots = means.select("workload").distinct().withColumn("t", F.explode(F.sequence(F.lit(start).cast("long"), F.lit(end - 1).cast("long"))))
    return slots.join(means, ["workload", "t"], "left")


def causal_fill(grid: DataFrame, channels: list[str], steps: int = 3) -> DataFrame:
    """<channel>_input: the last observed value of at most steps slots ago; imputed, input_valid and target_observed flags."""
    w = Window.partitionBy("workload").orderBy("t").rowsBetween(-steps, 0)
    out = grid.withColumns({f"{c}_input": F.last(c, ignorenulls=True).over(w) for c in channels})
    every = lambda cols: F.forall(F.array(*cols), lambda x: x.isNotNull())
    observed, valid = every(channels), every([f"{c}_input" for c in channels])
    return out.withColumns({"target_observed": observed, "input_valid": valid, "imputed": valid & ~observed})


def split_of(index: Column, n: int, train: float = 0.6, validation: float = 0.2) -> Column:
    a, b = int(n * train), int(n * train) + int(n * validation)
    return F.when(index < a, "train").when(index < b, "validation").otherwise("test")


def origins(spark, start: int, end: int, history: int, horizon: int, stride: int) -> DataFrame:
    """Forecast origins of a split [start, end): every stride slots, with all targets inside and full history before."""
    return spark.range(max(start, history - 1), end - horizon, stride).select(F.col("id").alias("origin"), (F.col("id") - history + 1).alias("history_start"), (F.col("id") + horizon).alias("last_target"))


def cohort(filled: DataFrame, origin_table: DataFrame, history: int, horizons: list[int], min_coverage: float = 0.8, all_targets: bool = False) -> DataFrame:
    """(origin, workload, coverage, eligible). Coverage comes from one window over each workload's slots; origins join on equality."""
    w = Window.partitionBy("workload").orderBy("t")
    valid = F.col("input_valid").cast("double")
    slots = filled.withColumn("coverage", F.sum(valid).over(w.rowsBetween(-(history - 1), 0)) / history)
    ahead = [F.coalesce(F.lead(F.col("target_observed"), h).over(w), F.lit(False)) for h in horizons]
    slots = slots.withColumn("targets", F.forall(F.array(*ahead), lambda x: x) if all_targets else F.lit(True))
    return slots.join(origin_table.select(F.col("origin").alias("t")), "t").select(F.col("t").alias("origin"), "workload", "coverage", (F.col("input_valid") & F.col("targets") & (F.col("coverage") >= min_coverage)).alias("eligible"))


def common_origins(filled: DataFrame, first: int, last: int, stride: int, histories: list[int], horizons: list[int], min_coverage: float = 0.8) -> DataFrame:
    """(origin, workload, valid, common): which of all pairs of history and horizon a workload's origin serves, and whether all.

    Origins are every stride-th slot of [first, last]. A pair (L, H) is served if L slots lie behind the origin
    and H before the data's end, the origin's input is valid, so is at least min_coverage of the L slots, and
    the target H slots ahead was observed. valid holds 'L/H' of the pairs served, by L and then H; the origins
    common to all pairs are those where every one is. One sweep over each workload's slots answers all pairs.
    """
    w = Window.partitionBy("workload").orderBy("t")
    good, start = F.col("input_valid").cast("double"), F.min("t").over(Window.partitionBy("workload"))
    flags = {}
    for long in sorted(histories):
        behind = F.sum(good).over(w.rowsBetween(-(long - 1), 0)) / long
        for ahead in sorted(horizons):
            seen = F.coalesce(F.lead("target_observed", ahead).over(w), F.lit(False))
            flags[f"{long}/{ahead}"] = F.col("input_valid") & (F.col("t") - start >= long - 1) & (behind >= min_coverage) & seen
    served = F.filter(F.array(*[F.when(ok, F.lit(name)) for name, ok in flags.items()]), lambda x: x.isNotNull())
    slots = filled.withColumn("valid", served).where((F.col("t") >= first) & (F.col("t") <= last) & ((F.col("t") - first) % stride == 0))
    return slots.select(F.col("t").alias("origin"), "workload", "valid", (F.size("valid") == len(flags)).alias("common"))


def zscore_stats(values: DataFrame, channels: list[str], eps: float = 1e-8) -> DataFrame:
    """One row: population mean and deviation of each channel; a deviation below eps counts as 1."""
    cols = []
    for c in channels:
        s = F.stddev_pop(c)
        cols += [F.avg(c).alias(f"{c}_mean"), F.when(s < eps, 1.0).otherwise(s).alias(f"{c}_std")]
    return values.agg(*cols)


def zscore(values: DataFrame, channels: list[str], stats: DataFrame | None = None, mode: str = "plain", log: tuple[str, ...] = ()) -> DataFrame:
    """<channel>_z by a one-row table of statistics. mode: 'plain' divides by std, 'eps' by std + 1e-8, 'floor' by at least 1e-4."""
    for c in log:
        values = values.withColumn(c, F.log1p(F.greatest(F.col(c), F.lit(0.0))))
    stats = zscore_stats(values, channels) if stats is None else stats
    by = {"plain": lambda s: s, "eps": lambda s: s + 1e-8, "floor": lambda s: F.greatest(s, F.lit(1e-4))}[mode]
    wide = values.join(F.broadcast(stats), how="cross")  # stats is one row
    return wide.select(*values.columns, *(F.coalesce((F.col(c) - F.col(f"{c}_mean")) / by(F.col(f"{c}_std")), F.lit(0.0)).alias(f"{c}_z") for c in channels))


def portable_summary(filled: DataFrame) -> DataFrame:
    return filled.groupBy("workload").agg(F.count(F.lit(1)).alias("time_steps"), F.count_if("target_observed").alias("observed_points"), F.count_if("input_valid").alias("input_valid_points"), F.count_if("imputed").alias("imputed_points"), F.avg(F.col("target_observed").cast("double")).alias("observed_coverage"))


def as_of(left: DataFrame, snapshots: DataFrame, left_t: str, snap_t: str, values: list[str], keys: list[str], store: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Each left time with the latest snapshot at or before it, duplicates of a snapshot averaged.

    Distinct times are merged in ranges, which store writes first, and each range goes on from the last
    snapshot of those before it; then snapshots join on equality.
    """
    times = left.select(F.col(left_t).alias("_t")).distinct().withColumn("_snap", F.lit(None).cast("long")).withColumn("_o", F.lit(1))
    snaps = snapshots.select(F.col(snap_t).alias("_t")).distinct().withColumn("_snap", F.col("_t").cast("long")).withColumn("_o", F.lit(0))
    merged = ranged(times.unionByName(snaps), ["_t", "_o"], store)
    before = F.max("_last").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))  # a row a range
    earlier = merged.groupBy("_range").agg(F.max("_snap").alias("_last")).select("_range", before.alias("_earlier"))
    w = Window.partitionBy("_range").orderBy("_t", "_o").rowsBetween(Window.unboundedPreceding, 0)
    found = merged.join(F.broadcast(earlier), "_range").withColumn("_snap", F.coalesce(F.last("_snap", ignorenulls=True).over(w), "_earlier")).where("_o = 1")
    means = snapshots.groupBy(F.col(snap_t).alias("_snap"), *keys).agg(*(F.avg(v).alias(v) for v in values))
    return left.join(found.select(F.col("_t").alias(left_t), "_snap"), left_t).join(means, "_snap").withColumnRenamed("_snap", snap_t)

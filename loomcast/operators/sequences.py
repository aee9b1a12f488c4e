"""States over time: runs, pairs, contexts, decayed counts, cadence, trajectories."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranges import numbered


def active_runs(slots: DataFrame, active: str = "input_valid") -> DataFrame:
    """(workload, run_start, run_end, n): maximal runs of adjoining active slots."""
    w = Window.partitionBy("workload").orderBy("t")
    on = slots.where(F.col(active)).withColumn("_island", F.col("t") - F.row_number().over(w))
    return on.groupBy("workload", "_island").agg(F.min("t").alias("run_start"), F.max("t").alias("run_end"), F.count(F.lit(1)).alias("n")).drop("_island")


def next_pairs(slots: DataFrame, value: str) -> DataFrame:
    """(workload, t, value, next_value) where the next slot adjoins."""
    w = Window.partitionBy("workload").orderBy("t")
    return slots.select("workload", "t", F.col(value).alias("value"), F.lead(value).over(w).alias("next_value"), F.lead("t").over(w).alias("_next")).where("_next = t + 1").drop("_next")


def contexts(events: DataFrame, order: list[str], k: int, state: str = "state") -> DataFrame:
    """The events with ctx, an array of the k states before each in its workload, oldest first; gaps are compressed.

    An event with fewer than k before it has no context and goes; a null state is a state like others.
    """
    if not k:
        return events.withColumn("ctx", F.array().cast(f"array<{dict(events.dtypes)[state]}>"))
    w = Window.partitionBy("workload").orderBy(*order)
    lags = [F.lag(state, i).over(w) for i in range(k, 0, -1)]
    return events.withColumn("_n", F.row_number().over(w)).withColumn("ctx", F.array(*lags)).where(F.col("_n") > k).drop("_n")


def run_contexts(slots: DataFrame, k: int, store: Callable[[DataFrame], DataFrame], state: str = "state", active: str = "input_valid") -> DataFrame:
    """(workload, t, event, ctx, state): contexts within runs of adjoining active slots, which gaps break.

    event counts all active slots by workload and time from 0, so that a query's age is a number of events.
    It is counted within ranges of (workload, t), which store writes first, and from range to range: no task
    counts all.
    """
    on = slots.where(F.col(active)).select("workload", "t", F.col(state).alias("state"))
    w = Window.partitionBy("workload").orderBy("t")
    runs = on.withColumn("_run", F.col("t") - F.row_number().over(w))
    inside = Window.partitionBy("workload", "_run").orderBy("t")
    lags = [F.lag("state", i).over(inside) for i in range(k, 0, -1)]
    ctx = F.array(*lags) if k else F.array().cast(f"array<{dict(on.dtypes)['state']}>")
    rows = runs.withColumn("ctx", ctx).withColumn("_n", F.row_number().over(inside))
    return numbered(rows, ["workload", "t"], "event", store).where(F.col("_n") > k).select("workload", "t", "event", "ctx", "state")


def transition_counts(events: DataFrame, order: list[str], state: str = "state") -> DataFrame:
    return contexts(events, order, 1, state).groupBy(F.get("ctx", F.lit(0)).alias("from_state"), F.col(state).alias("to_state")).agg(F.count(F.lit(1)).alias("n"))


def transition_matrix(counts: DataFrame, states: DataFrame, smoothing: float = 1.0) -> DataFrame:
    """Additive smoothing over all pairs of states (a domain of K states, K small by definition), rows summing to 1."""
    every = states.agg(F.sort_array(F.collect_set("state")).alias("all"))
    grid = states.select(F.col("state").alias("from_state")).join(F.broadcast(every), how="cross").select("from_state", F.explode("all").alias("to_state"))
    full = grid.join(counts, ["from_state", "to_state"], "left").withColumn("w", F.coalesce("n", F.lit(0)) + smoothing)
    return full.select("from_state", "to_state", (F.col("w") / F.sum("w").over(Window.partitionBy("from_state"))).alias("p"))


def decayed_counts(events: DataFrame, keys: list[str], now: int, decay: float, max_age: int | None = None) -> DataFrame:
    """Sum of exp(-decay * age) per key over events before now, at most max_age old."""
    age = F.lit(now) - F.col("t")
    on = (age > 0) if max_age is None else (age > 0) & (age <= max_age)
    return events.where(on).groupBy(*keys).agg(F.sum(F.exp(-decay * age)).alias("weight"))


def decayed_range(events: DataFrame, keys: list[str], decay: float, max_age: int) -> DataFrame:
    """At each event's time, the decayed number of earlier events of its key within max_age.

    Time is cut into stretches of max_age and weights are taken against their own stretch's start, so that none
    overflows however long the history. A frame meets two adjoining stretches at most, an even and an odd one.
    """
    cut = F.floor(F.col("t") / max_age).cast("long")
    w = Window.partitionBy(*keys).orderBy("t").rangeBetween(-max_age, -1)
    out = events.withColumn("_c", cut).withColumn("_w", F.exp(decay * (F.col("t") - F.col("_c") * max_age)))
    sums = [F.coalesce(F.sum(F.when(F.pmod("_c", F.lit(2)) == i, F.col("_w"))).over(w), F.lit(0.0)) for i in (0, 1)]
    even = F.pmod("_c", F.lit(2)) == 0
    own, other = F.when(even, sums[0]).otherwise(sums[1]), F.when(even, sums[1]).otherwise(sums[0])
    age = F.col("t") - F.col("_c") * max_age
    return out.withColumn("weight", own * F.exp(-decay * age) + other * F.exp(-decay * (age + max_age))).drop("_c", "_w")


def last_valid(slots: DataFrame, values: list[str], active: str) -> DataFrame:
    on = slots.where(F.col(active))
    return on.groupBy("workload").agg(F.max("t").alias("last_t"), F.max_by(F.struct(*values), "t").alias("r")).select("workload", "last_t", "r.*")


def cadence(times: DataFrame) -> DataFrame:
    """(workload, step): the lower median of the steps between a workload's times."""
    w = Window.partitionBy("workload").orderBy("t")
    steps = times.withColumn("d", F.col("t") - F.lag("t").over(w)).where("d is not null")
    return steps.groupBy("workload").agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY d)").cast("long").alias("step"))


def future_times(times: DataFrame, horizon: int) -> DataFrame:
    """(workload, h, t): the horizon's times after each workload's last, by its cadence; a single time steps by 1."""
    last = times.groupBy("workload").agg(F.max("t").alias("last")).join(cadence(times), "workload", "left")
    h = last.withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    return h.select("workload", "h", (F.col("last") + F.col("h") * F.coalesce("step", F.lit(1))).alias("t"))


def degradation(metrics: DataFrame, keys: list[str], value: str, higher_better: bool) -> DataFrame:
    """Each h against the first h of its keys: positive is worse."""
    ref = F.first(value).over(Window.partitionBy(*keys).orderBy("h"))
    d = (ref - F.col(value)) if higher_better else (F.col(value) - ref)
    return metrics.select(*keys, "h", F.col(value).alias("value"), d.alias("degradation"), (F.try_divide(d, F.abs(ref)) * 100).alias("degradation_pct"))


def trajectory(metrics: DataFrame, keys: list[str], value: str, threshold: float) -> DataFrame:
    """Trapezoid area over the range, least-squares slope, first h at or over the threshold."""
    w = Window.partitionBy(*keys).orderBy("h")
    nh, nv = F.lead("h").over(w), F.lead(value).over(w)
    rows = metrics.withColumn("_a", (nh - F.col("h")) * (nv + F.col(value)) / 2)
    return rows.groupBy(*keys).agg((F.sum("_a") / (F.max("h") - F.min("h"))).alias("auc"), F.regr_slope(F.col(value), F.col("h")).alias("slope"), F.min(F.when(F.col(value) >= threshold, F.col("h"))).alias("first_over"))

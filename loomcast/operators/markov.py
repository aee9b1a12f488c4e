"""Variable-order back-off over decayed context counts, and blended forecasts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import sigmoid
from .sequences import contexts


def order_counts(events: DataFrame, order: list[str], k: int, now: int, decay: float, max_age: int | None = None, state: str = "state") -> DataFrame:
    """(ctx, state, c): decayed counts of what followed each context of k states before now."""
    seen = contexts(events, order, k, state)
    age = F.lit(now) - F.col("t")
    fresh = (age > 0) if max_age is None else (age > 0) & (age <= max_age)
    return seen.where(fresh).groupBy("ctx", state).agg(F.sum(F.exp(-decay * age)).alias("c"))


def current_contexts(events: DataFrame, order: list[str], k: int, now: int, state: str = "state") -> DataFrame:
    """(workload, ctx): each workload's last k states before now, as an array."""
    if not k:
        return events.where(F.col("t") < now).select("workload").distinct().withColumn("ctx", F.array().cast(f"array<{dict(events.dtypes)[state]}>"))
    last = events.where(F.col("t") < now).withColumn("_r", F.row_number().over(Window.partitionBy("workload").orderBy(*[F.desc(c) for c in order]))).where(F.col("_r") <= k)
    rows = last.groupBy("workload").agg(F.sort_array(F.collect_list(F.struct((-F.col("_r")).alias("r"), F.col(state).alias("s")))).alias("a"))
    return rows.where(F.size("a") == k).select("workload", F.transform("a", lambda x: x["s"]).alias("ctx"))


def backoff(events: DataFrame, order: list[str], states: DataFrame, now: int, max_order: int = 2, mode: str = "flat", decay: float = 0.02, max_age: int | None = None, smoothing: float = 1.0, threshold: float = 2.0, temperature: float = 1.0, state: str = "state") -> DataFrame:
    """(workload, state, p, effective_order): the states that follow each workload's context, all orders mixed.

    mode 'flat' smooths every order additively on its own; 'hierarchical' smooths each towards the order
    below. An order's gate is sigmoid((support - threshold) / temperature), 0 without support or context;
    an order weighs its gate times what higher gates leave. Only events before now count.
    """
    base = events.where(F.col("t") < now).select("workload").distinct().join(F.broadcast(states.select("state")), how="cross")
    k_states = F.count(F.lit(1)).over(Window.partitionBy("workload"))
    out = base
    for k in range(max_order + 1):
        counts = order_counts(events, order, k, now, decay, max_age, state).withColumnRenamed(state, "state")
        asked = current_contexts(events, order, k, now, state)
        mine = asked.join(counts, "ctx").select("workload", "state", F.col("c").alias(f"c{k}"))
        out = out.join(mine, ["workload", "state"], "left")
        by = Window.partitionBy("workload")
        out = out.withColumn(f"c{k}", F.coalesce(f"c{k}", F.lit(0.0))).withColumn(f"n{k}", F.sum(f"c{k}").over(by))
        if mode == "hierarchical":
            lower = F.col(f"p{k - 1}") if k else None
            p = (F.col("c0") + 1e-12) / (F.col("n0") + k_states * 1e-12) if not k else F.when(F.col(f"n{k}") > 0, (F.col(f"c{k}") + lower * smoothing) / (F.col(f"n{k}") + smoothing)).otherwise(lower)
        else:
            p = F.when(F.col(f"n{k}") > 0, (F.col(f"c{k}") + smoothing) / (F.col(f"n{k}") + k_states * smoothing)).otherwise(1.0 / k_states)
        out = out.withColumn(f"p{k}", p).withColumn(f"g{k}", F.when(F.col(f"n{k}") > 0, sigmoid((F.col(f"n{k}") - threshold) / temperature)).otherwise(0.0))
    left, weights = F.lit(1.0), {}
    for k in range(max_order, 0, -1):
        weights[k] = left * F.col(f"g{k}")
        left = left * (1 - F.col(f"g{k}"))
    weights[0] = left
    mass = sum(weights.values(), F.lit(0.0))
    p = sum((weights[k] * F.col(f"p{k}") for k in weights), F.lit(0.0)) / mass
    best = F.greatest(*weights.values())
    effective = F.coalesce(*[F.when(weights[k] == best, k) for k in range(max_order + 1)])
    return out.select("workload", "state", p.alias("p"), effective.cast("int").alias("effective_order"))


def direct_backoff(events: DataFrame, order: list[str], horizon: int, now: int, decay: float, smoothing: float, states: DataFrame) -> DataFrame:
    """(h, state, p, support) of order 1 for h = 1..horizon from one fixed history: pooled counts of what came h
    positions after the workload's current state, each decayed by its age plus h."""
    past = events.where(F.col("t") < now)
    w = Window.partitionBy("workload").orderBy(*order)
    placed = past.withColumn("pos", F.row_number().over(w)).withColumn("last_pos", F.count(F.lit(1)).over(Window.partitionBy("workload")))
    now_state = placed.where("pos = last_pos").select("workload", F.col("state").alias("cur"))
    first = placed.join(now_state, "workload").where("state = cur").select("workload", "pos", "last_pos", "cur")
    ahead = first.withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(horizon)))).withColumn("at", F.col("pos") + F.col("h"))
    hits = ahead.join(placed.select("workload", F.col("pos").alias("at"), "state"), ["workload", "at"])
    counts = hits.groupBy("cur", "h", "state").agg(F.sum(F.exp(-decay * (F.col("last_pos") - F.col("at") + F.col("h")))).alias("c"))
    grid = now_state.select("cur").distinct().withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(horizon)))).join(F.broadcast(states.select("state")), how="cross")
    full = grid.join(counts, ["cur", "h", "state"], "left").withColumn("c", F.coalesce("c", F.lit(0.0)))
    by = Window.partitionBy("cur", "h")
    return full.select("cur", "h", "state", ((F.col("c") + smoothing) / (F.sum("c").over(by) + smoothing * F.count(F.lit(1)).over(by))).alias("p"), F.sum("c").over(by).alias("support"))


def direct_orders(events: DataFrame, order: list[str], horizon: int, now: int, max_order: int, decay: float, smoothing: float, states: DataFrame, threshold: float = 2.0, temperature: float = 1.0) -> DataFrame:
    """(workload, h, state, p) for h = 1..horizon from one fixed history, all orders mixed.

    An event's context of k states counts towards h if the event lies h positions or more after the history's
    beginning; its weight decays by its distance from the end plus h. So one count per (context, position,
    state), summed from the last position back, serves every horizon. Orders are smoothed additively and
    gated as in backoff.
    """
    past = events.where(F.col("t") < now)
    w = Window.partitionBy("workload").orderBy(*order)
    placed = past.withColumn("pos", F.row_number().over(w) - 1).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("workload")))
    base = placed.select("workload").distinct().withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(horizon)))).join(F.broadcast(states.select("state")), how="cross")
    by = Window.partitionBy("workload", "h")
    out, k_states = base, F.count(F.lit(1)).over(by)
    for k in range(max_order + 1):
        seen = contexts(placed, order, k)
        weighed = seen.groupBy("ctx", "pos", "state").agg(F.sum(F.exp(-decay * (F.col("n") - F.col("pos")))).alias("v"))
        tail = Window.partitionBy("ctx", "state").orderBy(F.desc("pos"))
        sums = weighed.select("ctx", "state", "pos", F.sum("v").over(tail).alias("c"))
        # a horizon takes the sum at the first position that is h - 1 or more
        first = sums.withColumn("h", F.explode(F.sequence(F.lit(1), F.least(F.col("pos") + 1, F.lit(horizon))))).groupBy("ctx", "state", "h").agg(F.max("c").alias("c"))
        mine = current_contexts(events, order, k, now).join(first, "ctx").select("workload", "h", "state", (F.col("c") * F.exp(-decay * F.col("h"))).alias(f"c{k}"))
        out = out.join(mine, ["workload", "h", "state"], "left").withColumn(f"c{k}", F.coalesce(f"c{k}", F.lit(0.0))).withColumn(f"n{k}", F.sum(f"c{k}").over(by))
        out = out.withColumn(f"p{k}", F.when(F.col(f"n{k}") > 0, (F.col(f"c{k}") + smoothing) / (F.col(f"n{k}") + k_states * smoothing)).otherwise(1.0 / k_states)).withColumn(f"g{k}", F.when(F.col(f"n{k}") > 0, sigmoid((F.col(f"n{k}") - threshold) / temperature)).otherwise(0.0))
    left, p = F.lit(1.0), F.lit(0.0)
    for k in range(max_order, 0, -1):
        p, left = p + left * F.col(f"g{k}") * F.col(f"p{k}"), left * (1 - F.col(f"g{k}"))
    return out.select("workload", "h", "state", (p + left * F.col("p0")).alias("p"))


def dynamic(mu: DataFrame, matrix: DataFrame) -> DataFrame:
    """(workload, state, p): memberships (workload, state, mu) one step through a transition matrix."""
    step = mu.join(matrix.withColumnRenamed("from_state", "state"), "state")
    return step.groupBy("workload", F.col("to_state").alias("state")).agg(F.sum(F.col("mu") * F.col("p")).alias("p"))


def blended(a: DataFrame, b: DataFrame, beta: float = 0.5) -> DataFrame:
    """(workload, state, p): (1 - beta) a + beta b, normalised; a state that one side lacks has 0 there."""
    both = a.select("workload", "state", F.col("p").alias("pa")).join(b.select("workload", "state", F.col("p").alias("pb")), ["workload", "state"], "full")
    v = F.coalesce("pa", F.lit(0.0)) * (1 - beta) + F.coalesce("pb", F.lit(0.0)) * beta
    return both.select("workload", "state", (v / F.sum(v).over(Window.partitionBy("workload"))).alias("p"))


def soft_transitions(mu: DataFrame) -> DataFrame:
    """(from_state, to_state, w): the sum of mu_t(i) * mu_{t+1}(j) over adjoining slots of long memberships."""
    nxt = mu.select("workload", (F.col("t") - 1).alias("t"), F.col("state").alias("to_state"), F.col("mu").alias("mu2"))
    return mu.join(nxt, ["workload", "t"]).groupBy(F.col("state").alias("from_state"), "to_state").agg(F.sum(F.col("mu") * F.col("mu2")).alias("w"))

"""Registered queries over the driver's tables, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import arrays
from ..operators import forecast, graph, ingest, learn, markov, metrics, sampling, sequences, shapes
from ..sources import tables
from . import usage as u

QUERIES: dict = {}
SQL: dict[str, str] = {}
#: Candidates of a pattern dictionary: a parameter of that operator.
CANDIDATES = 300


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to 6 digits, so that the order of additions cannot show."""
    return df.select(*[(F.round(c, 6) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def rounded_as_sql(df: DataFrame) -> DataFrame:
    """Doubles to 6 digits by the SQL's own steps: times a million, to the nearest whole (halves away from 0), divided.

    Spark's round looks at the shortest decimal instead; of numbers that end in a 5 after 6 digits, as ends
    of intervals of few units often do, some fall the other way.
    """
    return df.select(*[(F.round(F.col(c) * 1e6) / 1e6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def query(sql: str | None = None, with_: str = ""):
    def add(f):
        name = f.__name__
        QUERIES[name] = lambda spark, d: rounded(f(spark, d))
        if sql:
            SQL[name] = (f"WITH {with_} " if with_ else "") + sql
        return f

    return add


U = """u AS (SELECT user_id AS workload, CAST(floor(epoch(ts) / 86400) AS BIGINT) AS t, event_type AS node, event_id, value * 0.01 AS cpu, k * 0.01 AS mem, value * 0.005 AS disk_i, value * 0.005 AS disk_o
  FROM (SELECT *, TRY_CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS DOUBLE) AS k FROM events) WHERE value BETWEEN 0 AND 400 AND k BETWEEN 0 AND 100)"""
M = U + ", m AS (SELECT workload, t, count(*) AS n, avg(cpu) AS cpu, avg(mem) AS mem, avg(disk_i) AS disk_i, avg(disk_o) AS disk_o FROM u GROUP BY workload, t)"
G = M + ", g AS (SELECT w.workload, a.t, n, cpu, mem, disk_i, disk_o FROM (SELECT DISTINCT workload FROM m) w CROSS JOIN (SELECT unnest(range(min(t), max(t) + 1)) AS t FROM m) a LEFT JOIN m ON m.workload = w.workload AND m.t = a.t)"
FILL = G + """, f0 AS (SELECT *, cpu IS NOT NULL AS target_observed, last_value(cpu IGNORE NULLS) OVER w AS cpu_input, last_value(mem IGNORE NULLS) OVER w AS mem_input FROM g WINDOW w AS (PARTITION BY workload ORDER BY t ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)),
f AS (SELECT *, cpu_input IS NOT NULL AS input_valid, cpu_input IS NOT NULL AND NOT target_observed AS imputed FROM f0)"""
S = "s AS (SELECT user_id AS workload, CAST(epoch(ts) AS BIGINT) AS sec0, CAST(floor(epoch(ts)) AS BIGINT) AS sec, CAST(floor(epoch(ts) / 86400) AS BIGINT) AS t, event_id, event_type AS state FROM events)"
DEP = "dep AS (SELECT DISTINCT l_partkey AS workload, l_orderkey AS node FROM lineitem), pr AS (SELECT a.workload AS src, b.workload AS dst, a.node FROM dep a JOIN dep b ON a.node = b.node AND a.workload <> b.workload), adj AS (SELECT DISTINCT src, dst FROM pr)"
LINK = """links AS (SELECT (year(l_shipdate) - 1970) * 12 + month(l_shipdate) - 1 AS time_bucket, s_nationkey AS src, c_nationkey AS dst, avg(l_extendedprice) AS bandwidth, avg(l_quantity) AS delay, avg(l_discount) AS loss, avg(l_tax) AS availability
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE s_nationkey <> c_nationkey GROUP BY 1, 2, 3)"""
MU = """e AS (SELECT vec_id AS workload, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings), c AS (SELECT label AS state, pos, avg(x) AS c FROM e GROUP BY 1, 2),
d2 AS (SELECT workload, label AS truth, state, sum((x - c) * (x - c)) AS d2 FROM e JOIN c USING (pos) GROUP BY 1, 2, 3), mu AS (SELECT workload, state, truth, exp(-4 * d2) / sum(exp(-4 * d2)) OVER (PARTITION BY workload) AS mu FROM d2)"""


# ---- ingest and timeline


@query("SELECT workload, t, n, round(cpu, 6) AS cpu, round(mem, 6) AS mem, round(disk_i + disk_o, 6) AS disk_io_total FROM m", M)
def usage_bucket_mean(spark, d):
    return u.means(spark, d).select("workload", "t", "n", "cpu", "mem", (F.col("disk_i") + F.col("disk_o")).alias("disk_io_total"))


@query("SELECT user_id AS workload, count(*) AS n_rows, count(*) FILTER (value BETWEEN 0 AND 400) AS valid_rows FROM events GROUP BY 1")
def usage_validity_counts(spark, d):
    ok = u.RULES[0].valid()
    return u.read(spark, d, "events").groupBy(F.col("user_id").alias("workload")).agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(ok).alias("valid_rows"))


_STATS = "st AS (SELECT workload, count(*) AS n_rows, count(DISTINCT t) AS points, min(t) AS first_t, max(t) AS last_t, max(t) - min(t) AS span FROM u GROUP BY 1)"


@query("SELECT * FROM st", f"{U}, {_STATS}")
def workload_stats(spark, d):
    return ingest.workload_stats(u.usage(spark, d))


@query("SELECT * FROM st ORDER BY points DESC, n_rows DESC, span DESC, workload LIMIT 20", f"{U}, {_STATS}")
def workload_topn(spark, d):
    return ingest.top_workloads(ingest.workload_stats(u.usage(spark, d)), 20)


@query("SELECT workload, node FROM (SELECT workload, node, row_number() OVER (PARTITION BY workload ORDER BY count(*) DESC, node) AS r FROM u GROUP BY 1, 2) WHERE r = 1", U)
def node_mode(spark, d):
    return ingest.majority_node(u.usage(spark, d))


@query("SELECT workload, node FROM (SELECT workload, node, row_number() OVER (PARTITION BY workload ORDER BY event_id) AS r FROM u) WHERE r = 1", U)
def node_first(spark, d):
    return tables.first_wins(u.usage(spark, d).select("workload", "node", "event_id"), ["workload"], "event_id")


@query("SELECT workload, count(DISTINCT t) AS covered FROM u, (SELECT min(t) AS t0 FROM u) WHERE t >= t0 AND t < t0 + 30 GROUP BY 1 HAVING count(DISTINCT t) >= 25", U)
def full_span_keep(spark, d):
    obs = u.usage(spark, d)
    return ingest.full_span(obs, obs.agg(F.min("t")).first()[0] or 0, 30, 25)


@query("SELECT workload, t, coalesce(n, 0) AS n, round(cpu, 6) AS cpu FROM g", G)
def dense_grid(spark, d):
    m = u.means(spark, d)
    lo, hi = m.agg(F.min("t"), F.max("t")).first()
    return ingest.dense_grid(m, lo or 0, (hi or 0) + 1).select("workload", "t", F.coalesce("n", F.lit(0)).alias("n"), "cpu")


@query("SELECT workload, t, round(cpu_input, 6) AS cpu_input, round(mem_input, 6) AS mem_input, target_observed, input_valid, imputed FROM f", FILL)
def causal_fill(spark, d):
    return u.filled(spark, d).select("workload", "t", "cpu_input", "mem_input", "target_observed", "input_valid", "imputed")


@query("SELECT workload, count(*) AS time_steps, count(*) FILTER (target_observed) AS observed_points, count(*) FILTER (input_valid) AS input_valid_points, count(*) FILTER (imputed) AS imputed_points, round(avg(target_observed::INT), 6) AS observed_coverage FROM f GROUP BY 1", FILL)
def portable_summary(spark, d):
    return ingest.portable_summary(u.filled(spark, d))


@query("SELECT split, count(*) AS n FROM (SELECT CASE WHEN t - t0 < 18 THEN 'train' WHEN t - t0 < 24 THEN 'validation' ELSE 'test' END AS split FROM g, (SELECT min(t) AS t0 FROM g)) GROUP BY 1", G)
def split_labels(spark, d):
    g = u.filled(spark, d)
    lo = g.agg(F.min("t")).first()[0] or 0
    return g.groupBy(ingest.split_of(F.col("t") - lo, 30).alias("split")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o AS origin, o - 4 AS history_start, o + 60 AS last_target FROM (SELECT unnest(range(100, 140, 10)) AS o)")
def origins_grid(spark, d):
    return ingest.origins(spark, 100, 200, 5, 60, 10)


@query("""SELECT t AS origin, workload, round(cov, 6) AS coverage, input_valid AND cov >= 0.8 AS eligible
FROM (SELECT *, sum(input_valid::INT) OVER (PARTITION BY workload ORDER BY t ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) / 5.0::DOUBLE AS cov, min(t) OVER () AS t0 FROM f) WHERE t - t0 IN (10, 15, 20)""", FILL)
def cohort_eligibility(spark, d):
    f = u.filled(spark, d)
    lo = f.agg(F.min("t")).first()[0] or 0
    return ingest.cohort(f, ingest.origins(spark, lo + 10, lo + 26, 5, 5, 5), 5, [1])


@query("SELECT round(avg(cpu), 6) AS cpu_mean, round(stddev_pop(cpu), 6) AS cpu_std, round(avg(mem), 6) AS mem_mean, round(stddev_pop(mem), 6) AS mem_std FROM m", M)
def zscore_stats(spark, d):
    return ingest.zscore_stats(u.means(spark, d), ["cpu", "mem"])


@query("SELECT workload, t, round((cpu - a) / (b + 1e-8), 6) AS cpu_z, round((l - c) / (e + 1e-8), 6) AS mem_z FROM (SELECT *, ln(1 + greatest(mem, 0)) AS l FROM m), (SELECT avg(cpu) AS a, stddev_pop(cpu) AS b, avg(ln(1 + greatest(mem, 0))) AS c, stddev_pop(ln(1 + greatest(mem, 0))) AS e FROM m)", M)
def zscore_values(spark, d):
    return ingest.zscore(u.means(spark, d), ["cpu", "mem"], mode="eps", log=("mem",)).select("workload", "t", "cpu_z", "mem_z")


@query("SELECT tt AS origin, l.* EXCLUDE (time_bucket), time_bucket FROM (SELECT DISTINCT (year(o_orderdate) - 1970) * 12 + month(o_orderdate) - 1 AS tt FROM orders) o, LATERAL (SELECT max(time_bucket) AS tb FROM links WHERE time_bucket <= tt) x JOIN (SELECT time_bucket, src, dst, round(bandwidth, 6) AS bandwidth FROM links) l ON l.time_bucket = tb", LINK)
def link_asof(spark, d):
    o = u.read(spark, d, "orders").select(((F.year("o_orderdate") - 1970) * 12 + F.month("o_orderdate") - 1).cast("long").alias("origin")).distinct()
    return ingest.as_of(o, u.links(spark, d), "origin", "time_bucket", ["bandwidth"], ["src", "dst"], _store).select("origin", "src", "dst", "bandwidth", "time_bucket")


# ---- sequences


@query("SELECT workload, min(t) AS run_start, max(t) AS run_end, count(*) AS n FROM (SELECT workload, t, t - row_number() OVER (PARTITION BY workload ORDER BY t) AS i FROM f WHERE target_observed) GROUP BY workload, i", FILL)
def active_runs(spark, d):
    return sequences.active_runs(u.filled(spark, d), "target_observed")


@query("SELECT workload, t, round(cpu, 6) AS value, round(n2, 6) AS next_value FROM (SELECT workload, t, cpu, lead(cpu) OVER w AS n2, lead(t) OVER w AS t2 FROM m WINDOW w AS (PARTITION BY workload ORDER BY t)) WHERE t2 = t + 1", M)
def lag_pairs(spark, d):
    return sequences.next_pairs(u.means(spark, d), "cpu")


@query("SELECT workload, t AS last_t, round(cpu, 6) AS cpu, round(mem, 6) AS mem FROM (SELECT *, row_number() OVER (PARTITION BY workload ORDER BY t DESC) AS r FROM f WHERE target_observed) WHERE r = 1", FILL)
def last_valid(spark, d):
    return sequences.last_valid(u.filled(spark, d), ["cpu", "mem"], "target_observed")


@query("SELECT workload, CAST(quantile_disc(x, 0.5) AS BIGINT) AS step FROM (SELECT workload, t - lag(t) OVER (PARTITION BY workload ORDER BY t) AS x FROM m) WHERE x IS NOT NULL GROUP BY 1", M)
def median_cadence(spark, d):
    return sequences.cadence(u.means(spark, d))


_CTX = "x AS (SELECT *, lag(state, 1) OVER w AS a, lag(state, 2) OVER w AS b, lag(state, 3) OVER w AS c FROM s WINDOW w AS (PARTITION BY workload ORDER BY sec, event_id))"
ORDER = ["sec", "event_id"]


@query("SELECT a AS from_state, state AS to_state, count(*) AS n FROM x WHERE a IS NOT NULL GROUP BY 1, 2", f"{S}, {_CTX}")
def transition_counts(spark, d):
    return sequences.transition_counts(u.states(spark, d), ORDER)


@query("SELECT f.state AS from_state, g.state AS to_state, round((coalesce(n, 0) + 1) / sum(coalesce(n, 0) + 1) OVER (PARTITION BY f.state)::DOUBLE, 6) AS p FROM (SELECT DISTINCT state FROM s) f CROSS JOIN (SELECT DISTINCT state FROM s) g LEFT JOIN (SELECT a, state, count(*) AS n FROM x GROUP BY 1, 2) n ON n.a = f.state AND n.state = g.state", f"{S}, {_CTX}")
def transition_matrix(spark, d):
    s = u.states(spark, d)
    return sequences.transition_matrix(sequences.transition_counts(s, ORDER), s.select("state").distinct())


@query("SELECT c || '>' || b || '>' || a AS ctx, state, count(*) AS n FROM x WHERE c IS NOT NULL GROUP BY 1, 2", f"{S}, {_CTX}")
def context_counts(spark, d):
    return sequences.contexts(u.states(spark, d), ORDER, 3).groupBy(F.array_join("ctx", ">").alias("ctx"), "state").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT workload, state, round(sum(exp(-0.02 * (now - t))), 6) AS weight FROM s, (SELECT max(t) AS now FROM s) WHERE t < now AND t >= now - 15 GROUP BY 1, 2", S)
def decayed_counts(spark, d):
    s = u.states(spark, d)
    return sequences.decayed_counts(s, ["workload", "state"], s.agg(F.max("t")).first()[0] or 0, 0.02, 15)


@query("SELECT a.event_id, round(coalesce(sum(exp(-0.02 * (a.t - b.t))), 0), 6) AS weight FROM s a LEFT JOIN s b ON a.workload = b.workload AND a.state = b.state AND b.t < a.t AND b.t >= a.t - 10 GROUP BY 1", S)
def decayed_range(spark, d):
    return sequences.decayed_range(u.states(spark, d), ["workload", "state"], 0.02, 10).select("event_id", "weight")


_H = "hm AS (SELECT event_type AS k, CAST(floor(epoch(ts) / 86400) AS BIGINT) - (SELECT min(CAST(floor(epoch(ts) / 86400) AS BIGINT)) FROM events) AS h, avg(value) AS v FROM events GROUP BY 1, 2)"


def _by_h(spark, d):
    e = u.read(spark, d, "events").withColumn("day", F.floor(u.seconds("ts") / u.DAY).cast("long"))
    lo = e.agg(F.min("day")).first()[0] or 0
    return e.groupBy(F.col("event_type").alias("k"), (F.col("day") - lo).alias("h")).agg(F.avg("value").alias("v"))


@query("SELECT k, h, round(v, 6) AS value, round(v - r, 6) AS degradation, round((v - r) / abs(r) * 100, 6) AS degradation_pct FROM (SELECT *, first_value(v) OVER (PARTITION BY k ORDER BY h) AS r FROM hm)", _H)
def degradation(spark, d):
    return sequences.degradation(_by_h(spark, d), ["k"], "v", higher_better=False)


@query("SELECT k, round(sum((h2 - h) * (v + v2) / 2) / (max(h) - min(h)), 6) AS auc, round(regr_slope(v, h), 6) AS slope, min(h) FILTER (v >= 60) AS first_over FROM (SELECT *, lead(h) OVER w AS h2, lead(v) OVER w AS v2 FROM hm WINDOW w AS (PARTITION BY k ORDER BY h)) GROUP BY 1", _H)
def long_horizon(spark, d):
    return sequences.trajectory(_by_h(spark, d), ["k"], "v", 60.0)


# ---- back-off and forecasts


@query("SELECT from_state, to_state, round(w, 6) AS w FROM (SELECT a.state AS from_state, b.state AS to_state, sum(a.mu * b.mu) AS w FROM mu a JOIN mu b ON b.workload = a.workload + 1 WHERE a.workload // 50 = b.workload // 50 GROUP BY 1, 2)", MU)
def soft_transition(spark, d):
    mu = u.memberships(spark, d).select(F.floor(F.col("workload") / 50).alias("workload"), F.col("workload").alias("t"), "state", "mu")
    return markov.soft_transitions(mu)


def _sql_backoff(mode: str) -> str:
    ctx = {0: "''", 1: "a", 2: "b || '>' || a"}
    parts = ["now AS (SELECT max(t) AS now FROM s)", "st AS (SELECT DISTINCT state FROM s)", "ws AS (SELECT DISTINCT workload FROM s, now WHERE t < now)", "base AS (SELECT workload, state FROM ws CROSS JOIN st)"]
    parts.append("pw AS (SELECT *, row_number() OVER (PARTITION BY workload ORDER BY sec DESC, event_id DESC) AS r FROM s, now WHERE t < now)")
    parts.append("cur AS (SELECT workload, '' AS c0, max(state) FILTER (r = 1) AS c1, max(state) FILTER (r = 2) || '>' || max(state) FILTER (r = 1) AS c2 FROM pw WHERE r <= 2 GROUP BY 1)")
    sel = "SELECT base.workload, base.state"
    joins = " FROM base JOIN cur ON cur.workload = base.workload"
    for k in range(3):
        parts.append(f"o{k} AS (SELECT {ctx[k]} AS ctx, state, sum(exp(-0.02 * (now - t))) AS c FROM x, now WHERE t < now AND t >= now - 20 AND ({ctx[k]}) IS NOT NULL GROUP BY 1, 2)")
        sel += f", coalesce(o{k}.c, 0) AS c{k}, coalesce(sum(o{k}.c) OVER (PARTITION BY base.workload), 0) AS n{k}"
        joins += f" LEFT JOIN o{k} ON o{k}.ctx = cur.c{k} AND o{k}.state = base.state"
    parts.append(f"j AS ({sel}{joins})")
    if mode == "flat":
        ps = ", ".join(f"CASE WHEN n{k} > 0 THEN (c{k} + 1) / (n{k} + ks) ELSE 1.0::DOUBLE / ks END AS p{k}" for k in range(3))
        parts.append(f"q AS (SELECT *, {ps} FROM (SELECT *, count(*) OVER (PARTITION BY workload) AS ks FROM j))")
    else:
        parts.append("q0 AS (SELECT *, (c0 + 1e-12) / (n0 + ks * 1e-12) AS p0 FROM (SELECT *, count(*) OVER (PARTITION BY workload) AS ks FROM j))")
        parts.append("q1 AS (SELECT *, CASE WHEN n1 > 0 THEN (c1 + p0) / (n1 + 1) ELSE p0 END AS p1 FROM q0)")
        parts.append("q AS (SELECT *, CASE WHEN n2 > 0 THEN (c2 + p1) / (n2 + 1) ELSE p1 END AS p2 FROM q1)")
    gs = ", ".join(f"CASE WHEN n{k} > 0 THEN 1 / (1 + exp(-greatest(least(n{k} - 2, 60), -60))) ELSE 0 END AS g{k}" for k in (1, 2))
    parts.append(f"w AS (SELECT *, g2 AS w2, (1 - g2) * g1 AS w1, (1 - g2) * (1 - g1) AS w0 FROM (SELECT *, {gs} FROM q))")
    return f"WITH {S}, {_CTX}, " + ", ".join(parts) + " SELECT workload, state, round((w0 * p0 + w1 * p1 + w2 * p2) / (w0 + w1 + w2), 6) AS p, CASE WHEN w0 >= w1 AND w0 >= w2 THEN 0 WHEN w1 >= w2 THEN 1 ELSE 2 END::INT AS effective_order FROM w"


def _backoff(spark, d, mode):
    s = u.states(spark, d)
    return markov.backoff(s, ORDER, s.select("state").distinct(), s.agg(F.max("t")).first()[0] or 0, 2, mode, 0.02, 20)


@query(_sql_backoff("flat"))
def backoff_flat(spark, d):
    return _backoff(spark, d, "flat")


@query(_sql_backoff("hierarchical"))
def backoff_hier(spark, d):
    return _backoff(spark, d, "hierarchical")


@query("""SELECT g.cur, g.h, g.state, round((coalesce(c, 0) + 1) / (sum(coalesce(c, 0)) OVER w + count(*) OVER w), 6) AS p, round(sum(coalesce(c, 0)) OVER w, 6) AS support
FROM (SELECT DISTINCT state AS cur, h, st.state FROM cu, (SELECT unnest(range(1, 4))::INT AS h), (SELECT DISTINCT state FROM s) st) g
LEFT JOIN (SELECT cu.state AS cur, CAST(b.pos - a.pos AS INT) AS h, b.state, sum(exp(-0.02 * (a.last_pos - b.pos + (b.pos - a.pos)))) AS c FROM cu JOIN pl a ON a.workload = cu.workload AND a.state = cu.state JOIN pl b ON b.workload = a.workload AND b.pos > a.pos AND b.pos <= a.pos + 3 GROUP BY 1, 2, 3) n
ON n.cur = g.cur AND n.h = g.h AND n.state = g.state WINDOW w AS (PARTITION BY g.cur, g.h)""".replace("SELECT DISTINCT state AS cur, h, st.state", "SELECT DISTINCT cu.state AS cur, h, st.state AS state"), S + ", pl AS (SELECT workload, state, row_number() OVER (PARTITION BY workload ORDER BY sec, event_id) AS pos, count(*) OVER (PARTITION BY workload) AS last_pos FROM s WHERE t < (SELECT max(t) FROM s)), cu AS (SELECT workload, state FROM pl WHERE pos = last_pos)")
def backoff_direct(spark, d):
    s = u.states(spark, d)
    return markov.direct_backoff(s, ORDER, 3, s.agg(F.max("t")).first()[0] or 0, 0.02, 1.0, s.select("state").distinct())


_BACK = _sql_backoff("flat").replace("round((w0 * p0 + w1 * p1 + w2 * p2) / (w0 + w1 + w2), 6)", "(w0 * p0 + w1 * p1 + w2 * p2) / (w0 + w1 + w2)")


@query(f"""SELECT workload, state, round((0.5 * coalesce(q.p, 0) + 0.5 * b.p) / sum(0.5 * coalesce(q.p, 0) + 0.5 * b.p) OVER (PARTITION BY workload), 6) AS p FROM ({_BACK}) b LEFT JOIN
(SELECT workload, g.state, (coalesce(n, 0) + 1) / sum(coalesce(n, 0) + 1) OVER (PARTITION BY workload)::DOUBLE AS p FROM (SELECT workload, arg_max(state, (sec, event_id)) AS a FROM s WHERE t < (SELECT max(t) FROM s) GROUP BY 1) l CROSS JOIN (SELECT DISTINCT state FROM s) g
LEFT JOIN (SELECT a, state, count(*) AS n FROM (SELECT state, lag(state) OVER (PARTITION BY workload ORDER BY sec, event_id) AS a FROM s WHERE t < (SELECT max(t) FROM s)) WHERE a IS NOT NULL GROUP BY 1, 2) n ON n.a = l.a AND n.state = g.state) q USING (workload, state)""", S)
def blend_forecast(spark, d):
    s = u.states(spark, d)
    now = s.agg(F.max("t")).first()[0] or 0
    back = markov.backoff(s, ORDER, s.select("state").distinct(), now, 2, "flat", 0.02, 20)
    matrix = sequences.transition_matrix(sequences.transition_counts(s.where(F.col("t") < now), ORDER), s.select("state").distinct())
    mu = markov.current_contexts(s, ORDER, 1, now).select("workload", F.get("ctx", F.lit(0)).alias("state"), F.lit(1.0).alias("mu"))
    return markov.blended(markov.dynamic(mu, matrix), back)


@query("SELECT h, round(avg(abs(y - m)), 6) AS model_mae, round(avg(abs(y - b)), 6) AS persistence_mae, round(avg(abs(y - b)) - avg(abs(y - m)), 6) AS gain FROM (SELECT workload, t, t % 5 AS h, cpu AS y, lag(cpu) OVER w AS b, avg(cpu) OVER (PARTITION BY workload ORDER BY t ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS m FROM m WINDOW w AS (PARTITION BY workload ORDER BY t)) WHERE b IS NOT NULL GROUP BY 1", M)
def persistence_gain(spark, d):
    w = Window.partitionBy("workload").orderBy("t")
    m = u.means(spark, d).select("workload", "t", (F.col("t") % 5).alias("h"), F.col("cpu").alias("y"), F.lag("cpu").over(w).alias("b"), F.avg("cpu").over(w.rowsBetween(-5, -1)).alias("m")).where("b is not null")
    return forecast.persistence_gain(m, "y", "m", "b", ["h"])


@query()
def recursive_forecast(spark, d):
    """All users from the end of their histories: one origin, numbered 0."""
    s = u.states(spark, d)
    index = F.dense_rank().over(Window.orderBy("state")) - 1
    code = s.select("state").distinct().withColumn("i", index.cast("int"))
    rows = s.join(F.broadcast(code), "state").select(F.lit(0).cast("long").alias("origin"), "workload", (F.col("sec") * 1000 + F.col("event_id") % 1000).alias("t"), F.col("i").alias("state"))
    return forecast.recursive_rollout(rows, 5, 6)


# ---- memberships, centroids, shapes


@query("SELECT workload, state, truth, round(mu, 6) AS mu FROM mu", MU)
def membership_slot(spark, d):
    return u.memberships(spark, d)


@query("SELECT workload, truth, CAST(min(state) FILTER (mu = top) AS INT) AS state FROM (SELECT *, max(mu) OVER (PARTITION BY workload) AS top FROM mu) GROUP BY 1, 2", MU)
def hard_state(spark, d):
    w = u.memberships(spark, d).groupBy("workload", "truth").agg(F.sort_array(F.collect_list(F.struct("state", "mu"))).alias("a"))
    mu = F.transform("a", lambda x: x["mu"])
    return w.select("workload", "truth", arrays.argmax(mu).alias("state"))


@query("SELECT workload, round(sum(mu * (state + 1)), 6) AS decoded FROM mu GROUP BY 1", MU)
def membership_decode(spark, d):
    w = u.memberships(spark, d).groupBy("workload").agg(F.sort_array(F.collect_list(F.struct("state", "mu"))).alias("a"))
    return w.select("workload", arrays.dot(F.transform("a", lambda x: x["mu"]), F.transform("a", lambda x: x["state"] + 1.0)).alias("decoded"))


def _points(spark, d):
    return u.read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("x"))


_SEED = "p AS (SELECT vec_id AS id, embedding::DOUBLE[] AS x FROM embeddings), s0 AS (SELECT id AS state, x AS c FROM p WHERE id < 4)"
_STEP = ", a{i} AS (SELECT id, x, arg_min(state, (d2, state)) AS state, min(d2) AS d2 FROM (SELECT id, x, state, list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i]))) AS d2 FROM p CROSS JOIN s{i}) GROUP BY id, x)"
_UPDATE = ", s{j} AS (SELECT state, list(v ORDER BY pos) AS c FROM (SELECT state, pos, avg(v) AS v FROM (SELECT state, unnest(x) AS v, generate_subscripts(x, 1) AS pos FROM a{i}) GROUP BY 1, 2) GROUP BY 1)"
_LLOYD = _SEED + _STEP.format(i=0) + _UPDATE.format(i=0, j=1) + _STEP.format(i=1) + _UPDATE.format(i=1, j=2) + _STEP.format(i=2)


@query("SELECT id, state, round(d2, 6) AS d2 FROM a2", _LLOYD)
def kmeans_lloyd(spark, d):
    p = _points(spark, d)
    seeds = p.where("id < 4").select(F.col("id").alias("state"), F.col("x").alias("c"))
    return shapes.assign(p, shapes.k_means(p, seeds, 2)).select("id", "state", "d2")


@query("SELECT round(greatest(sqrt(quantile_cont(d2, 0.5) FILTER (d2 > 1e-12)), 0.1), 6) AS scale FROM a0", _SEED + _STEP.format(i=0))
def membership_scale(spark, d):
    p = _points(spark, d)
    return shapes.membership_scale(shapes.assign(p, p.where("id < 4").select(F.col("id").alias("state"), F.col("x").alias("c"))))


_PIECES = """i AS (SELECT workload, t - row_number() OVER (PARTITION BY workload ORDER BY t) AS run, t, cpu_input AS x, mem_input AS y FROM f WHERE input_valid),
r AS MATERIALIZED (SELECT workload, run, min(t) AS first, count(*) AS n, list(x ORDER BY t) AS x, list(y ORDER BY t) AS y, greatest(3, least(8, count(*))) AS most FROM i GROUP BY 1, 2),
k AS (SELECT workload, run, e, k, x[e - k + 1 : e] AS x, y[e - k + 1 : e] AS y FROM r, range(1, n + 1) a(e), range(1, most + 1) b(k) WHERE k <= e),
c AS MATERIALIZED (SELECT workload, run, e, list(c ORDER BY k) AS cost FROM (SELECT *, round(list_sum(list_transform(x, lambda v: (v - mx) * (v - mx))) + 0.2 * pow((x[k] - x[1]) / greatest(k - 1, 1), 2) + list_sum(list_transform(y, lambda v: (v - my) * (v - my))) + 0.2 * pow((y[k] - y[1]) / greatest(k - 1, 1), 2), 9) AS c FROM (SELECT *, list_avg(x) AS mx, list_avg(y) AS my FROM k)) GROUP BY 1, 2, 3),
s AS (SELECT workload, run, n, most, 0::BIGINT AS e, [0.0::DOUBLE] AS total, [0::BIGINT] AS last FROM r WHERE n >= 3
  UNION ALL SELECT workload, run, n, most, e, list_append(total, best.c), list_append(last, best.k) FROM (SELECT s.workload, s.run, s.n, s.most, c.e, total, last, coalesce(list_sort(list_transform(list_filter(range(3, least(most, c.e) + 1), lambda j: last[c.e - j + 1] IS NOT NULL), lambda j: {'c': round(total[c.e - j + 1] + cost[j] + 0.05, 9), 'k': j}))[1], CASE WHEN c.e <= most THEN {'c': round(cost[c.e] + 0.05, 9), 'k': c.e} END) AS best FROM s JOIN c ON c.workload = s.workload AND c.run = s.run AND c.e = s.e + 1)),
z AS (SELECT workload, run, last, n AS b FROM s WHERE e = n AND last[n + 1] IS NOT NULL UNION ALL SELECT workload, run, last, b - last[b + 1] FROM z WHERE b - last[b + 1] > 0)"""


@query("SELECT z.workload, first + b - last[b + 1] AS seg_start, first + b - 1 AS seg_end FROM z JOIN r USING (workload, run) UNION ALL SELECT workload, first, first + n - 1 FROM r WHERE (workload, run) NOT IN (SELECT (workload, run) FROM z)", "RECURSIVE " + FILL + ", " + _PIECES)
def segment_runs(spark, d):
    return shapes.segment_runs(u.filled(spark, d).where("input_valid").select("workload", "t", F.col("cpu_input").alias("cpu"), F.col("mem_input").alias("mem")), ["cpu", "mem"], 3, 8, 0.05)


_BEST = "CASE WHEN row[e[1].n + 1].c <= acc[e[1].n].c AND row[e[1].n + 1].c <= row[e[1].n].c THEN row[e[1].n + 1] WHEN acc[e[1].n].c <= row[e[1].n].c THEN acc[e[1].n] ELSE row[e[1].n] END"
#: Rows of the table of alignments one after the other: cell by cell the cheapest of up, left and diagonal, with its number of points.
_WARP = f"""it AS MATERIALIZED (SELECT workload AS id, list(cpu_input ORDER BY t) AS xs FROM f WHERE input_valid GROUP BY 1 ORDER BY md5(workload::VARCHAR), workload LIMIT {CANDIDATES}),
al AS (SELECT a.id AS i, b.id AS j, a.xs AS x, b.xs AS y, greatest(5, abs(len(a.xs) - len(b.xs))) AS band, 0::BIGINT AS r, list_prepend({{'c': 0.0::DOUBLE, 'n': 0::BIGINT}}, list_transform(b.xs, lambda v: {{'c': 'infinity'::DOUBLE, 'n': 0::BIGINT}})) AS row FROM it a JOIN it b ON a.id < b.id
  UNION ALL SELECT i, j, x, y, band, r + 1, list_reduce(list_transform(range(1, len(y) + 1), lambda q: [{{'c': CASE WHEN abs(r + 1 - q) <= band THEN (x[r + 1] - y[q]) * (x[r + 1] - y[q]) ELSE 'infinity'::DOUBLE END, 'n': q}}]), lambda acc, e: list_append(acc, {{'c': ({_BEST}).c + e[1].c, 'n': ({_BEST}).n + 1}}), [{{'c': 'infinity'::DOUBLE, 'n': 0::BIGINT}}]) FROM al WHERE r < len(x))"""


@query("SELECT i, j, round(sqrt(row[len(row)].c / row[len(row)].n), 6) AS distance FROM al WHERE r = len(x)", f"RECURSIVE {FILL}, {_WARP}")
def dtw_pairs(spark, d):
    items = u.filled(spark, d).where("input_valid").groupBy(F.col("workload").alias("id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("t", "cpu_input"))), lambda x: x["cpu_input"]).alias("series"))
    return shapes.pairwise_dtw(sampling.digest_sample(items, "id", CANDIDATES))


@query("SELECT id, arg_min(other, struct_pack(d, other)) AS nearest, min(d) AS distance FROM (SELECT unnest([i, j]) AS id, unnest([j, i]) AS other, round(sqrt(row[len(row)].c / row[len(row)].n), 6) AS d FROM al WHERE r = len(x)) GROUP BY id", f"RECURSIVE {FILL}, {_WARP}".replace(f" ORDER BY md5(workload::VARCHAR), workload LIMIT {CANDIDATES}", ""))
def nearest_warped(spark, d):
    """Of every workload the one whose usage is nearest by warped distance, over all workloads."""
    items = u.filled(spark, d).where("input_valid").groupBy(F.col("workload").alias("id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("t", "cpu_input"))), lambda x: x["cpu_input"]).alias("series"))
    return shapes.nearest_warped(items, _store)


@query()
def shape_set(spark, d):
    pairs = dtw_pairs(spark, d).toPandas()  # candidates are a bounded set
    ids = sorted({*pairs["i"], *pairs["j"]})
    at = {x: k for k, x in enumerate(ids)}
    dist = np.zeros((len(ids), len(ids)))
    for i, j, v in pairs.itertuples(index=False):
        dist[at[i], at[j]] = dist[at[j], at[i]] = v
    s = shapes.shape_set(dist, 0.9, 8)
    return spark.createDataFrame([(int(ids[m]), int((s["assignment"] == c).sum()), float(s["sigma"][c]), float(s["coverage"])) for c, m in enumerate(s["medoids"])], "medoid long, members int, sigma double, coverage double")


@query()
def window_membership(spark, d):
    protos = np.stack([np.full((6, 2), x) for x in (0.2, 0.5, 1.0)])
    f = u.filled(spark, d).select("workload", "t", F.coalesce("cpu_input", F.lit(0.0)).alias("cpu"), F.coalesce("mem_input", F.lit(0.0)).alias("mem"), "input_valid")
    return shapes.window_memberships(f, ["cpu", "mem"], protos, 5).select("workload", "t", F.posexplode("mu").alias("state", "mu"))


_WARPED = f"""wv AS (SELECT workload, t, list(cpu_input) OVER four AS x4, list(cpu_input) OVER three AS x3 FROM f WHERE input_valid WINDOW four AS (PARTITION BY workload ORDER BY t ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), three AS (PARTITION BY workload ORDER BY t ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)),
al AS (SELECT workload, t, c, CASE WHEN len(y) = 4 THEN x4 ELSE x3 END AS x, y, 0::BIGINT AS r, list_prepend({{'c': 0.0::DOUBLE, 'n': 0::BIGINT}}, list_transform(y, lambda v: {{'c': 'infinity'::DOUBLE, 'n': 0::BIGINT}})) AS row FROM wv, (VALUES (0, [0.2, 0.2, 0.2, 0.2]::DOUBLE[]), (1, [0.2, 0.5, 1.0]::DOUBLE[]), (2, [1.0, 1.0, 1.0, 1.0]::DOUBLE[])) p(c, y)
  UNION ALL SELECT workload, t, c, x, y, r + 1, list_reduce(list_transform(range(1, len(y) + 1), lambda q: [{{'c': (x[r + 1] - y[q]) * (x[r + 1] - y[q]), 'n': q}}]), lambda acc, e: list_append(acc, {{'c': ({_BEST}).c + e[1].c, 'n': ({_BEST}).n + 1}}), [{{'c': 'infinity'::DOUBLE, 'n': 0::BIGINT}}]) FROM al WHERE r < len(x)),
wm AS (SELECT workload, t, c, exp(-row[len(row)].c / row[len(row)].n / (2 * 0.3::DOUBLE * 0.3::DOUBLE)) AS m FROM al WHERE r = len(x))"""


@query("SELECT workload, t, CAST(c AS INT) AS state, round(CASE WHEN sum(m) OVER w > 1e-12 THEN m / sum(m) OVER w ELSE 1 / 3.0::DOUBLE END, 6) AS mu FROM wm WINDOW w AS (PARTITION BY workload, t)", f"RECURSIVE {FILL}, {_WARPED}")
def warped_membership(spark, d):
    protos = [np.array([[0.2]] * 4), np.array([[0.2], [0.5], [1.0]]), np.array([[1.0]] * 4)]
    f = u.filled(spark, d).select("workload", "t", F.col("cpu_input").alias("cpu"), "input_valid")
    return shapes.warped_memberships(f, ["cpu"], protos, [0.3, 0.3, 0.3]).select("workload", "t", F.posexplode("mu").alias("state", "mu"))


# ---- graphs


@query("SELECT src, dst, 1.0::DOUBLE AS weight FROM adj", DEP)
def adjacency_pair(spark, d):
    return graph.adjacency(u.deployment(spark, d))


@query("SELECT workload, node, round(1.0::DOUBLE / count(*) OVER (PARTITION BY workload), 6) AS weight FROM dep", DEP)
def norm_deployment(spark, d):
    return graph.normalized_incidence(graph.incidence(u.deployment(spark, d)))


@query("SELECT src, dst, shared, round(shared / top::DOUBLE, 6) AS weight FROM n, (SELECT max(shared) AS top FROM n)", DEP + ", n AS (SELECT src, dst, count(*) AS shared FROM pr GROUP BY 1, 2)")
def hyperedge_overlap(spark, d):
    return graph.overlaps(u.deployment(spark, d))


@query("SELECT src, dst, round(w / max(w) OVER (), 6) AS weight FROM (SELECT src, dst, sum(1.0::DOUBLE / (d - 1)) AS w FROM pr JOIN (SELECT node, count(*) AS d FROM dep GROUP BY 1) USING (node) GROUP BY 1, 2)", DEP)
def hypergraph_weight(spark, d):
    return graph.hypergraph(u.deployment(spark, d))


@query("SELECT count(*) AS workloads, CAST(sum(g) // 2 AS BIGINT) AS edges, round(avg((g = 0)::INT), 6) AS isolated, round(avg(g), 6) AS mean_degree, quantile_cont(g, 0.5)::DOUBLE AS p50, round(quantile_cont(g, 0.95), 6) AS p95 FROM (SELECT workload, coalesce(n, 0) AS g FROM (SELECT DISTINCT workload FROM dep) LEFT JOIN (SELECT src, count(*) AS n FROM adj GROUP BY 1) ON src = workload)", DEP)
def degree_stats(spark, d):
    dep = u.deployment(spark, d)
    return graph.coverage(graph.adjacency(dep), dep)


@query("SELECT src, count(*) AS indirect FROM (SELECT DISTINCT a.src, b.dst FROM adj a JOIN adj b ON a.dst = b.src WHERE a.src <> b.dst) r WHERE NOT EXISTS (SELECT 1 FROM adj c WHERE c.src = r.src AND c.dst = r.dst) GROUP BY 1", DEP)
def two_hop_counts(spark, d):
    reach = graph.within_two_on(u.incidences(spark, d), _written, _store)
    return reach.where("reached > direct").select("src", (F.col("reached") - F.col("direct")).alias("indirect"))


def _store(df: DataFrame) -> DataFrame:
    """An iteration's rows, checkpointed to the cluster's shared folder."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(u.shared_folder(df.sparkSession))
    return df.checkpoint()


def _written(df: DataFrame) -> DataFrame:
    """The rows, written to the cluster's shared folder and read back; the shuffle files behind them go at once."""
    spark, clean = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    path, was = f"{u.shared_folder(spark)}/written-{uuid.uuid4().hex}", spark.conf.get(clean, "false")
    spark.conf.set(clean, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(clean, was)
    return spark.read.schema(df.schema).parquet(path)


#: Label propagation in SQL for as many rounds as the tables' graphs are wide, and a few more.
_ROUNDS = ", ".join(["l0 AS (SELECT DISTINCT workload, workload AS label FROM dep)", *(f"l{i} AS MATERIALIZED (SELECT a.workload, min(least(a.label, coalesce(b.label, a.label))) AS label FROM l{i - 1} a LEFT JOIN adj ON adj.src = a.workload LEFT JOIN l{i - 1} b ON b.workload = adj.dst GROUP BY 1)" for i in range(1, 9))])


@query("SELECT workload, label AS component FROM l8", f"{DEP}, {_ROUNDS}")
def component_labels(spark, d):
    dep = u.deployment(spark, d)
    return graph.component_sizes(graph.stars(dep), dep, _store)


@query("SELECT workload, t, round(greatest(least(((2 * mu - 1 + e) / (1 + (2 * mu - 1) * e) + 1) / 2, 1), 0), 6) AS value FROM (SELECT workload, t, least(cpu, 1) AS mu, 0.5 * greatest(least(mem, 1), -1) AS e FROM m)", M)
def einstein_modulation(spark, d):
    return u.means(spark, d).select("workload", "t", arrays.einstein(F.least("cpu", F.lit(1.0)), F.col("mem"), 0.5).alias("value"))


@query("""SELECT v.workload, v.t, v.state, round(v.v / sum(v.v) OVER (PARTITION BY v.workload, v.t), 6) AS mu FROM (
SELECT w.workload, w.t, w.state, greatest(least(((2 * w.mu - 1 + e) / greatest(1 + (2 * w.mu - 1) * e, 1e-12) + 1) / 2, 1), 0) AS v FROM (SELECT wm.*, 0.5 * coalesce(m, 0) AS e FROM wm LEFT JOIN (SELECT src, t, state, avg(tanh((x.mu + 0.5 * y.weight) / 2)) AS m FROM ov y JOIN wm x ON x.workload = y.dst GROUP BY 1, 2, 3) n ON n.src = wm.workload AND n.t = wm.t AND n.state = wm.state) w) v""",
       DEP + ", n AS (SELECT src, dst, count(*) AS shared FROM pr GROUP BY 1, 2), ov AS (SELECT src, dst, shared / (SELECT max(shared) FROM n)::DOUBLE AS weight FROM n), wm AS (SELECT workload, 0 AS t, st AS state, CASE st WHEN 0 THEN (workload % 7) / 7.0::DOUBLE ELSE 1 - (workload % 7) / 7.0::DOUBLE END AS mu FROM (SELECT DISTINCT workload FROM dep), (VALUES (0), (1)) v(st))")
def neighbour_modulation(spark, d):
    dep = u.deployment(spark, d)
    x = (F.col("workload") % 7) / F.lit(7.0)
    mu = dep.select("workload").distinct().withColumn("t", F.lit(0)).withColumn("state", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("mu", F.when(F.col("state") == 0, x).otherwise(1 - x))
    return graph.neighbour_modulation(mu, graph.overlaps(dep), 1.0, 0.5, 0.5)


_GATE = LINK + """, lk AS (SELECT src, dst, avg(bandwidth) AS bandwidth, avg(delay) AS delay, avg(loss) AS loss, avg(availability) AS availability FROM links GROUP BY 1, 2),
gt AS (SELECT src, dst, 1 / (1 + exp(-greatest(least(z, 60), -60))) AS gate FROM (SELECT src, dst, (bandwidth - avg(bandwidth) OVER ()) / (stddev_pop(bandwidth) OVER () + 1e-8) - (delay - avg(delay) OVER ()) / (stddev_pop(delay) OVER () + 1e-8) - (loss - avg(loss) OVER ()) / (stddev_pop(loss) OVER () + 1e-8) + (availability - avg(availability) OVER ()) / (stddev_pop(availability) OVER () + 1e-8) AS z FROM lk))"""


def _gates(spark, d):
    return graph.link_gates(u.links(spark, d).groupBy("src", "dst").agg(*(F.avg(c).alias(c) for c in graph.SIGNS)))


@query("SELECT src, dst, round(gate, 6) AS gate, round(gate / sum(gate) OVER (PARTITION BY dst), 6) AS share FROM gt", _GATE)
def link_gates(spark, d):
    return _gates(spark, d)


@query("SELECT n_nationkey AS node, round(tanh(0.8 * n_nationkey / 25.0::DOUBLE + 0.4 * coalesce(m, 0)), 6) AS value FROM nation LEFT JOIN (SELECT dst, sum(gate / s * src / 25.0::DOUBLE) AS m FROM (SELECT *, sum(gate) OVER (PARTITION BY dst) AS s FROM gt) GROUP BY 1) ON dst = n_nationkey", _GATE)
def propagate_1hop(spark, d):
    values = u.read(spark, d, "nation").select(F.col("n_nationkey").alias("node"), (F.col("n_nationkey") / F.lit(25.0)).alias("value"))
    return graph.propagate(values, _gates(spark, d), 0.8, 0.4)


# ---- metrics


_HARD = MU + ", hs AS (SELECT workload, truth, min(state) FILTER (mu = top) AS pred, max(mu) AS conf FROM (SELECT *, max(mu) OVER (PARTITION BY workload) AS top FROM mu) GROUP BY 1, 2)"


def _hard(spark, d):
    return u.memberships(spark, d).groupBy("workload", "truth").agg(F.max_by("state", F.struct("mu", -F.col("state"))).alias("pred"), F.max("mu").alias("conf"))


@query("SELECT truth, pred, count(*)::DOUBLE AS n FROM hs GROUP BY 1, 2", _HARD)
def confusion(spark, d):
    return metrics.confusion(_hard(spark, d), "truth", "pred")


_CONF = "cf AS (SELECT quality AS truth, toxic AS pred, count(*)::DOUBLE AS n FROM labels GROUP BY 1, 2), pc AS (SELECT label, sum(tp) AS tp, sum(s) AS support, sum(p) AS predicted FROM (SELECT truth AS label, CASE WHEN truth = pred THEN n ELSE 0 END AS tp, n AS s, 0 AS p FROM cf UNION ALL SELECT pred, 0, 0, n FROM cf) GROUP BY 1), pf AS (SELECT *, CASE WHEN prec + rec > 0 THEN 2 * prec * rec / (prec + rec) ELSE 0 END AS f1 FROM (SELECT *, coalesce(tp / nullif(predicted, 0), 0) AS prec, coalesce(tp / nullif(support, 0), 0) AS rec FROM pc))"


def _labels(spark, d):
    return metrics.confusion(u.read(spark, d, "labels"), "quality", "toxic")


@query("SELECT label, tp, support, predicted, round(prec, 6) AS precision, round(rec, 6) AS recall, round(f1, 6) AS f1 FROM pf", _CONF)
def per_class(spark, d):
    return metrics.per_class(_labels(spark, d))


@query("""SELECT n, round(hit / n, 6) AS accuracy, round(ba, 6) AS balanced_accuracy, round(pm, 6) AS precision_macro, round(rm, 6) AS recall_macro, round(fm, 6) AS f1_macro, round(fw, 6) AS f1_weighted, round(coalesce((hit * n - tpx) / nullif(sqrt((n * n - pp) * (n * n - tt)), 0), 0), 6) AS mcc, round((hit / n - tpx / (n * n)) / (1 - tpx / (n * n)), 6) AS kappa
FROM (SELECT sum(support) AS n, sum(tp) AS hit, avg(rec) FILTER (support > 0) AS ba, avg(prec) AS pm, avg(rec) AS rm, avg(f1) AS fm, sum(f1 * support) / sum(support) AS fw, sum(support * predicted) AS tpx, sum(predicted * predicted) AS pp, sum(support * support) AS tt FROM pf)""", _CONF)
def class_metrics(spark, d):
    return metrics.classification(_labels(spark, d))


@query("""SELECT round(avg(mae), 6) AS mae, round(sqrt(avg(mse)), 6) AS rmse, round(avg(brier), 6) AS brier, round(avg(l1), 6) AS l1, round(avg(l2), 6) AS l2, round(avg(tv), 6) AS tv, round(avg(kl), 6) AS kl, round(avg(js), 6) AS js, round(avg(hell), 6) AS hellinger, round(avg(cos), 6) AS cosine, round(avg(ce), 6) AS soft_ce
FROM (SELECT workload, avg(abs(t - p)) AS mae, avg((t - p) * (t - p)) AS mse, sum((t - p) * (t - p)) AS brier, sum(abs(t - p)) AS l1, sqrt(sum((t - p) * (t - p))) AS l2, sum(abs(t - p)) / 2 AS tv, sum(tc * ln(tc / pc)) AS kl, sum(tc * ln(2 * tc / (tc + pc))) / 2 + sum(pc * ln(2 * pc / (tc + pc))) / 2 AS js, sqrt(sum((sqrt(tc) - sqrt(pc)) * (sqrt(tc) - sqrt(pc))) / 2) AS hell, sum(t * p) / (sqrt(sum(t * t)) * sqrt(sum(p * p))) AS cos, -sum(t * ln(pc)) AS ce
FROM (SELECT workload, (state = truth)::INT::DOUBLE AS t, mu AS p, greatest((state = truth)::INT::DOUBLE, 1e-12) AS tc, least(greatest(mu, 1e-12), 1) AS pc FROM mu) GROUP BY 1)""", MU)
def membership_metrics(spark, d):
    m = u.memberships(spark, d).select("workload", "state", (F.col("state") == F.col("truth")).cast("double").alias("truth"), F.col("mu").alias("pred"))
    return metrics.membership(m, ["workload"])


@query("SELECT CAST(greatest(ceil(conf * 15) - 1, 0) AS INT) AS bin, count(*) AS n, round(avg(conf), 6) AS confidence, round(avg((pred = truth)::INT), 6) AS accuracy, round(abs(avg(conf) - avg((pred = truth)::INT)), 6) AS gap FROM hs GROUP BY 1", _HARD)
def calibration_right(spark, d):
    return metrics.calibration_bins(_hard(spark, d).withColumn("hit", F.col("pred") == F.col("truth")), "conf", "hit")


@query("SELECT round(sum(n * g) / sum(n), 6) AS ece, round(max(g), 6) AS mce FROM (SELECT least(floor(conf * 15), 14) AS b, count(*) AS n, abs(avg(conf) - avg((pred = truth)::INT)) AS g FROM hs GROUP BY 1)", _HARD)
def calibration_left(spark, d):
    return metrics.calibration(metrics.calibration_bins(_hard(spark, d).withColumn("hit", F.col("pred") == F.col("truth")), "conf", "hit", right_closed=False))


@query("SELECT state, round(sum(n * g) / sum(n), 6) AS ece FROM (SELECT state, greatest(ceil(mu * 15) - 1, 0) AS b, count(*) AS n, abs(avg(mu) - avg((state = truth)::INT)) AS g FROM mu GROUP BY 1, 2) GROUP BY 1", MU)
def classwise_ece(spark, d):
    return metrics.classwise_ece(u.memberships(spark, d).select("state", F.col("mu").alias("p"), (F.col("state") == F.col("truth")).alias("hit")))


@query("""SELECT l_returnflag, count(*) AS n, round(avg(abs(x - y)), 6) AS mae, round(sqrt(avg((x - y) * (x - y))), 6) AS rmse, round(median(abs(x - y)), 6) AS median_ae, round(max(abs(x - y)), 6) AS max_ae, round(avg(x - y), 6) AS bias, round(avg(abs(x - y) / abs(y)) FILTER (abs(y) > 1e-12) * 100, 6) AS mape, round(avg(2 * abs(x - y) / (abs(x) + abs(y))) FILTER (abs(x) + abs(y) > 1e-12) * 100, 6) AS smape, round(sum(abs(x - y)) / sum(abs(y)) * 100, 6) AS wape, round(corr(y, x), 6) AS pearson, round(1 - sum((x - y) * (x - y)) / (var_pop(y) * count(*)), 6) AS r2
FROM (SELECT l_returnflag, l_extendedprice AS y, l_quantity * 1500 AS x FROM lineitem) GROUP BY ROLLUP (l_returnflag)""")
def resource_metrics(spark, d):
    return metrics.resources(u.read(spark, d, "lineitem").select("l_returnflag", F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1500).alias("x")), "y", "x", "l_returnflag")


@query("SELECT k, count(*) AS n, round(avg(v), 6) AS mean, round(coalesce(stddev_samp(v), 0), 6) AS std, round(quantile_cont(v, 0.25), 6) AS q25, round(quantile_cont(v, 0.5), 6) AS median, round(quantile_cont(v, 0.75), 6) AS q75, round(quantile_cont(v, 0.75) - quantile_cont(v, 0.25), 6) AS iqr, round(quantile_cont(v, 0.95), 6) AS q95, round(quantile_cont(v, 0.99), 6) AS q99, round(min(v), 6) AS min, round(max(v), 6) AS max, round(avg(v) - 1.96 * coalesce(stddev_samp(v), 0) / sqrt(count(*)), 6) AS ci_low, round(avg(v) + 1.96 * coalesce(stddev_samp(v), 0) / sqrt(count(*)), 6) AS ci_high FROM hm GROUP BY 1", _H)
def summary_stats(spark, d):
    return metrics.summary(_by_h(spark, d), ["k"], "v")


#: Fixed names of metrics, with what is better of each.
_BETTER = (("membership_mae", "lower"), ("f1_macro", "higher"), ("Gain_MAE", "lower"), ("bias", None), ("peak_memory_mb", "lower"), ("elapsed_seconds", "lower"), ("cosine_similarity", "higher"), ("mean_entropy", None), ("coverage", None), ("R2", "higher"), ("error_recall", "lower"), ("ece", "lower"))
_NAMES = ", ".join(f"('{n}', {repr(b) if b else 'NULL'})" for n, b in _BETTER)


@query(f"SELECT l_returnflag || '.' || name AS name, direction FROM (SELECT DISTINCT l_returnflag FROM lineitem), (VALUES {_NAMES}) v(name, direction)")
def metric_direction(spark, d):
    """Metrics of every group of lines, by their names."""
    kinds = u.read(spark, d, "lineitem").select("l_returnflag").distinct()
    names = kinds.select(F.explode(F.transform(F.array(*(F.lit(n) for n, _ in _BETTER)), lambda n: F.concat("l_returnflag", F.lit("."), n))).alias("name"))
    return names.withColumn("direction", metrics.direction(F.col("name")))


@query("SELECT coalesce(a.k, b.k) AS k, round(a.v, 6) AS mean_value, b.n::DOUBLE AS n_events FROM (SELECT event_type AS k, avg(value) AS v FROM events WHERE event_type < 'm' GROUP BY 1) a FULL JOIN (SELECT event_type AS k, count(*) AS n FROM events WHERE event_type >= 'm' GROUP BY 1) b ON a.k = b.k")
def union_missing_cols(spark, d):
    e = u.read(spark, d, "events")
    a = e.where("event_type < 'm'").groupBy(F.col("event_type").alias("k")).agg(F.avg("value").alias("mean_value"))
    b = e.where("event_type >= 'm'").groupBy(F.col("event_type").alias("k")).agg(F.count(F.lit(1)).cast("double").alias("n_events"))
    return a.unionByName(b, allowMissingColumns=True)


@query("SELECT src, count(*) AS reached FROM (SELECT src, dst FROM adj UNION SELECT a.src, b.dst FROM adj a JOIN adj b ON a.dst = b.src WHERE a.src <> b.dst) GROUP BY 1", DEP)
def reachable_2(spark, d):
    return graph.within_two_on(u.incidences(spark, d), _written, _store).select("src", "reached")


@query("SELECT DISTINCT workload, md5(workload::VARCHAR) AS digest FROM u ORDER BY digest, workload LIMIT 25", U)
def seeded_sample(spark, d):
    return sampling.digest_sample(u.usage(spark, d).select("workload").distinct(), "workload", 25).withColumn("digest", F.md5(F.col("workload").cast("string").cast("binary")))


@query("SELECT workload FROM u GROUP BY 1 ORDER BY min(event_id), workload LIMIT 40", U)
def first_seen(spark, d):
    return sampling.first_seen(u.usage(spark, d), "workload", "event_id", 40)


_CDF = ", ".join(f"{c!r}::DOUBLE" for c in metrics.POISSON)
#: Weights of units in 200 draws: how many steps of the Poisson distribution lie at or below 32 bits of a digest.
WEIGHTS = f"wt AS MATERIALIZED (SELECT unit, j AS draw, len(list_filter([{_CDF}], lambda c: c <= ('0x' || substr(md5('7:' || unit || ':' || (j // 4)), CAST(j % 4 * 8 + 1 AS INT), 8))::BIGINT / 4294967296.0::DOUBLE)) AS w FROM (SELECT DISTINCT unit::VARCHAR AS unit FROM un), range(200) t(j))"


@query("SELECT p.k, round(value, 6) AS value, round(coalesce(low, value), 6) AS low, round(coalesce(high, value), 6) AS high FROM (SELECT k, sum(num) / sum(den) AS value, count(*) AS units FROM un GROUP BY k) p LEFT JOIN (SELECT k, quantile_cont(v, 0.025) AS low, quantile_cont(v, 0.975) AS high FROM (SELECT k, draw, sum(num * w) / nullif(sum(den * w), 0) AS v FROM un JOIN wt ON un.unit::VARCHAR = wt.unit GROUP BY 1, 2) GROUP BY 1) q ON p.k = q.k AND units > 1", "un AS (SELECT event_type AS k, user_id AS unit, sum(value) AS num, count(*)::DOUBLE AS den FROM events WHERE value IS NOT NULL GROUP BY 1, 2), " + WEIGHTS)
def bootstrap_ci(spark, d):
    e = u.read(spark, d, "events").select(F.col("event_type").alias("k"), F.col("user_id").alias("origin"), "value", F.lit(1.0).alias("one"))
    return metrics.bootstrap(e, ["k"], "origin", "value", "one", 200)


@query()
def gd_transition(spark, d):
    code = {s: i for i, s in enumerate(sorted(r[0] for r in u.states(spark, d).select("state").distinct().collect()))}
    k = len(code)
    m = F.create_map(*[F.lit(x) for kv in code.items() for x in kv])
    rows = sequences.contexts(u.states(spark, d), ORDER, 1).select(m[F.get("ctx", F.lit(0))].alias("i"), m[F.col("state")].alias("y"))
    rows = rows.select(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda j: (j == F.col("i")).cast("double")).alias("x"), "y")
    _, losses = forecast.train_kernel(rows, k, k, epochs=5)
    return spark.createDataFrame([(i, x) for i, x in enumerate(losses)], "epoch int, loss double")


@query("SELECT bin, count(*) AS n, round(avg(conf), 6) AS confidence, round(avg((pred = truth)::INT), 6) AS accuracy, round(abs(avg(conf) - avg((pred = truth)::INT)), 6) AS gap FROM (SELECT hs.*, greatest(len(list_filter(edges, lambda e: e < conf)) - 1, 0) AS bin FROM hs, (SELECT list_distinct(list_concat([0.0::DOUBLE, 1.0::DOUBLE], list_filter(quantile_cont(conf, [0.2, 0.4, 0.6, 0.8]), lambda x: x > 0 AND x < 1))) AS edges FROM hs)) GROUP BY 1", _HARD)
def calibration_quantile(spark, d):
    h = _hard(spark, d).withColumn("hit", F.col("pred") == F.col("truth"))
    return metrics.edge_bins(h, "conf", "hit", metrics.bin_edges(h, "conf", 5, "quantile"))


@query("SELECT l_returnflag AS run, round(sum(l_extendedprice) / 1048576.0::DOUBLE, 6) AS peak_mb, round(count(*) / sum(l_quantity), 6) AS throughput, round(sum(l_quantity) * 1000 / count(*), 6) AS ms_per_sample FROM lineitem GROUP BY 1")
def efficiency(spark, d):
    runs = u.read(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("run")).agg(F.sum("l_quantity").alias("seconds"), F.count(F.lit(1)).cast("double").alias("samples"), F.sum("l_extendedprice").alias("bytes"))
    return metrics.efficiency(runs, "seconds", "samples", "bytes").select("run", "peak_mb", "throughput", "ms_per_sample")


@query()
def learned_forecast(spark, d):
    """Losses of three epochs over the last next state of every user and day; workloads whose node of most rows is the same are neighbours."""
    s = u.states(spark, d)
    code = {r[0]: i for i, r in enumerate(s.select("state").distinct().orderBy("state").collect())}
    one_hot = {name: F.array(*[(F.col(c) == x).cast("double") for x in code]) for name, c in (("mu", "ctx"), ("target", "state"))}
    pairs = sequences.contexts(s, ORDER, 1).withColumn("ctx", F.get("ctx", F.lit(0)))
    last = pairs.groupBy("workload", "t").agg(F.max_by(F.struct("ctx", "state"), F.struct(*ORDER)).alias("r")).select("workload", "t", "r.*")
    rows = last.select("workload", "t", F.lit(1).alias("h"), *(c.alias(n) for n, c in one_hot.items()), F.lit(None).cast("array<double>").alias("back"))
    packed = learn.pack_slots(rows, ingest.majority_node(u.usage(spark, d)))
    blocks = learn.Blocks(max(len(code), 1), period=7.0, hidden=8)
    trained = learn.train(_store(packed), blocks, np.full((blocks.k, blocks.k), 1 / blocks.k), epochs=3, rate=0.05)
    return spark.createDataFrame(list(enumerate(trained.losses)), "epoch int, loss double")


def _roll_out(spark, d, horizon, folder=None):
    s = u.states(spark, d)
    names = [r[0] for r in s.select("state").distinct().orderBy("state").collect()]
    k = max(len(names), 1)
    code = F.array_position(F.array(*map(F.lit, names)), F.col("state")) - 1
    last = s.groupBy("workload", "t").agg(F.max_by("state", F.struct(*ORDER)).alias("state")).withColumn("state", code.cast("int"))
    mu = last.withColumn("mu", F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: (i == F.col("state")).cast("double")))
    counts = {(r[0], r[1]): r[2] for r in sequences.transition_counts(s, ORDER).collect()}
    prior = np.array([[counts.get((a, b), 0) + 1.0 for b in names] for a in names])
    end, home = s.agg(F.max("t")).first()[0] or 0, ingest.majority_node(u.usage(spark, d))
    origin = spark.range(end, end + 1).withColumnRenamed("id", "origin")
    blocks = learn.Blocks(k, period=7.0)
    return learn.roll_out_whole(mu, home, origin, 30, blocks.start(), blocks, prior / prior.sum(1, keepdims=True), horizon, _store, folder=folder)


@query()
def roll_out(spark, d):
    """Recursive forecasts of all users from the last day, with untrained blocks and the counted transition matrix."""
    return _roll_out(spark, d, 5)


@query("SELECT CAST(h AS INT) AS h, (SELECT count(DISTINCT user_id) FROM events) * (SELECT count(DISTINCT event_type) FROM events) AS n, 0::BIGINT AS different FROM range(1, 4) r(h)")
def resumed_roll_out(spark, d):
    """A roll-out that stops after its first step and goes on in a second call, row by row against one that never stops."""
    folder = f"{u.shared_folder(spark)}/steps-{uuid.uuid4().hex}"
    _roll_out(spark, d, 1, folder)
    again = _roll_out(spark, d, 3, folder).withColumnRenamed("p", "q")
    both = _roll_out(spark, d, 3).join(again, ["origin", "workload", "h", "state"], "full")
    return both.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(F.abs(F.col("p") - F.col("q")) > 1e-9, F.lit(True))).alias("different"))


def run(spark: SparkSession, name: str, d: str) -> DataFrame:
    return QUERIES[name](spark, d)

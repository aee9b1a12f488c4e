"""More registered queries: sources and sinks by round trip, contexts, graphs, blocks and the whole families of metrics."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import arrays
from ..operators import forecast, graph, ingest, markov, metrics, sampling, sequences, shapes
from ..operators.context_store import ContextStore
from ..sources import archives, tables
from ..sources import usage as src
from ..streaming import usage as streams
from . import usage as u
from .queries import _BEST, _CTX, _GATE, DEP, FILL, LINK, M, MU, ORDER, S, WEIGHTS, U, _by_h, _gates, _hard, _labels, _store, query, rounded_as_sql


def _folder(spark: SparkSession, name: str) -> str:
    return f"{u.shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _text(df: DataFrame, name: str, header: bool = False) -> str:
    """The rows as CSV in the shared folder."""
    path = _folder(df.sparkSession, name)
    df.write.option("header", header).csv(path)
    return path


# ---- sources and sinks


def _csv_rows(spark, d, header):
    e = u.read(spark, d, "events").select("user_id", u.seconds("ts").alias("sec"), F.col("value").cast("string").alias("value"), "event_type")
    dirty = spark.createDataFrame([(None, None, None, None), ("", "1", "nan", "x"), ("7", "x", "3", "x"), ("7", "100", "", "x"), ("7", "100", "-5", "x")], "user_id string, sec string, value string, event_type string")
    return _text(e.select(*[F.col(c).cast("string") for c in e.columns]).unionByName(dirty), "usage", header)


def _csv_usage(spark, d, header):
    spec = src.SourceSpec(_csv_rows(spark, d, header), "user_id", "sec", (src.ResourceRule("cpu", "value", 0.01, 0, 400),), node="event_type", fmt="csv", header=header, columns=() if header else ("user_id", "sec", "value", "event_type"))
    obs = src.observations(src.read_source(spark, spec), spec, step=u.DAY)
    return obs.groupBy(F.col("workload").cast("long").alias("workload"), "t").agg(F.count(F.lit(1)).alias("n"), F.avg("cpu").alias("cpu"))


_CSV = "SELECT user_id AS workload, CAST(floor(epoch(ts) / 86400) AS BIGINT) AS t, count(*) AS n, round(avg(value * 0.01), 6) AS cpu FROM events WHERE value BETWEEN 0 AND 400 GROUP BY 1, 2"


@query(_CSV)
def csv_headerless_scan(spark, d):
    return _csv_usage(spark, d, False)


@query(_CSV)
def csv_header_scan(spark, d):
    return _csv_usage(spark, d, True)


def _trace(spark, d, header):
    e = u.read(spark, d, "events").select(F.col("user_id").alias("container_id"), u.seconds("ts").alias("time_stamp"), F.col("event_type").alias("machine"))
    rows = archives.read_trace(spark, _text(e, "trace", header), ["container_id", "time_stamp", "machine"], ("container_id", "time_stamp"))
    return rows.groupBy(F.col("container_id").cast("long").alias("container_id"), "machine").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("time_stamp").cast("long")).alias("last"))


_TRACE = "SELECT user_id AS container_id, event_type AS machine, count(*) AS n, max(CAST(floor(epoch(ts)) AS BIGINT)) AS last FROM events GROUP BY 1, 2"


@query(_TRACE)
def trace_with_header(spark, d):
    return _trace(spark, d, True)


@query(_TRACE)
def trace_without_header(spark, d):
    return _trace(spark, d, False)


@query("SELECT n_regionkey AS region, n_nationkey AS nation, n_name AS name FROM nation")
def side_table_scan(spark, d):
    """Named columns of a headerless side table."""
    n = u.read(spark, d, "nation")
    spec = src.SideSpec(_text(n, "side"), ("n_regionkey", "n_nationkey", "n_name"), fmt="csv", header=False, columns=tuple(n.columns))
    rows = src.read_source(spark, spec)
    return rows.select(F.col("n_regionkey").cast("long").alias("region"), F.col("n_nationkey").cast("long").alias("nation"), F.col("n_name").alias("name"))


def _specs(d):
    rule = (src.ResourceRule("cpu", "value"),)
    return {"usage": src.SourceSpec(f"{d}/events.parquet", "user_id", "ts", rule), "usage_lacks": src.SourceSpec(f"{d}/events.parquet", "user_id", "time", rule, node="machine"), "usage_absent": src.SourceSpec(f"{d}/absent.parquet", "user_id", "ts", rule), "deployment": src.SideSpec(f"{d}/lineitem.parquet", ("l_partkey", "l_orderkey")), "links": src.SideSpec(f"{d}/lineitem.parquet", ("src", "dst", "l_tax"))}


@query("SELECT * FROM (VALUES ('usage', true, true, ''), ('usage_lacks', false, true, 'time,machine'), ('usage_absent', false, false, 'user_id,ts,value'), ('deployment', true, true, ''), ('links', false, true, 'src,dst')) v(source, ok, readable, missing)")
def preflight_reports(spark, d):
    rows = [(name, r["ok"], r["readable"], ",".join(r["missing"])) for name, s in _specs(d).items() for r in [src.preflight(spark, s)]]
    return spark.createDataFrame(rows, "source string, ok boolean, readable boolean, missing string")


@query("SELECT * FROM (VALUES ('usage', 'usage'), ('deployment', 'deployment'), ('links', NULL)) v(kind, used)")
def source_fallback(spark, d):
    """The first usable source by priority; links may be missing."""
    s = _specs(d)
    order = {"usage": ["usage_absent", "usage_lacks", "usage"], "deployment": ["links", "deployment"], "links": ["links"]}
    rows = []
    for kind, names in order.items():
        used = src.resolve(spark, [s[n] for n in names], needed=kind != "links")
        rows.append((kind, next((n for n in names if s[n] == used), None)))
    return spark.createDataFrame(rows, "kind string, used string")


@query("SELECT workload, t, node, round(cpu, 6) AS cpu FROM (SELECT *, row_number() OVER (PARTITION BY workload, t ORDER BY event_id DESC) AS r FROM u) WHERE r = 1", U)
def usage_last_wins(spark, d):
    return tables.last_wins(u.usage(spark, d).select("workload", "t", "node", "cpu", "event_id"), ["workload", "t"], "event_id").select("workload", "t", "node", "cpu")


@query("SELECT src, dst, time_bucket, round(bandwidth, 6) AS bandwidth, bandwidth <> 0 AS live FROM (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY time_bucket DESC) AS r FROM (SELECT time_bucket, src, dst, CASE WHEN (src + dst) % 5 = 0 THEN 0 ELSE bandwidth END AS bandwidth FROM links)) WHERE r = 1", LINK)
def link_features(spark, d):
    """Of a pair's links the last; a link without any feature is not live."""
    l = u.links(spark, d).withColumn("bandwidth", F.when((F.col("src") + F.col("dst")) % 5 == 0, 0.0).otherwise(F.col("bandwidth")))
    out = tables.link_table(l.withColumn("at", F.col("time_bucket")).select("src", "dst", "bandwidth", "time_bucket", "at"), ["bandwidth", "time_bucket"], "at")
    return out.select("src", "dst", "time_bucket", "bandwidth", (F.col("live") & (F.col("bandwidth") != 0)).alias("live"))


@query("SELECT (SELECT count(*) FROM m) AS resources, (SELECT round(sum(cpu), 6) FROM m) AS cpu, (SELECT count(*) FROM (SELECT DISTINCT l_partkey, l_orderkey FROM lineitem)) AS deployment", M)
def prepared_round_trip(spark, d):
    path = _folder(spark, "prepared")
    tables.write_prepared(u.means(spark, d), u.deployment(spark, d), path)
    r, dep = tables.load_prepared(spark, path)
    return r.agg(F.count(F.lit(1)).alias("resources"), F.sum("cpu").alias("cpu")).join(dep.agg(F.count(F.lit(1)).alias("deployment")), how="cross")


def _raw(spark, d):
    e = u.read(spark, d, "events").select("user_id", "event_id", "event_type")
    return _text(e, "raw")


_PICKED = "pick AS (SELECT user_id FROM events GROUP BY 1 HAVING user_id % 7 = 3)"


def _picked(spark, d):
    return u.read(spark, d, "events").select(F.col("user_id").alias("workload")).distinct().where("workload % 7 = 3")


@query("SELECT user_id::VARCHAR AS workload, user_id || ',' || event_id || ',' || event_type AS value FROM events SEMI JOIN pick USING (user_id)", _PICKED)
def raw_rows_chosen(spark, d):
    return archives.chosen_lines(archives.raw_lines(spark, _raw(spark, d)), _picked(spark, d)).select("workload", "value")


@query("SELECT user_id AS workload, user_id || ',' || event_id || ',' || event_type AS value FROM events SEMI JOIN pick USING (user_id)", _PICKED)
def raw_rows_exported(spark, d):
    """Byte for byte, by workload, and read again."""
    out = _folder(spark, "export")
    archives.export_raw(spark, _raw(spark, d), _picked(spark, d), out)
    return spark.read.text(f"{out}/by_workload").select(F.col("workload").cast("long").alias("workload"), "value")


@query("SELECT count(*) AS lines, count(*) FILTER (user_id % 7 = 3) AS taken, count(DISTINCT user_id) FILTER (user_id % 7 = 3) AS workloads FROM events")
def raw_rows_captured(spark, d):
    """A stream over the files takes each once, and a second run nothing more."""
    raw, out, mark = _raw(spark, d), _folder(spark, "capture"), _folder(spark, "mark")
    for _ in range(2):
        archives.capture(spark, raw, _picked(spark, d), out, mark)
    taken = spark.read.schema("workload string, value string").parquet(out)
    return taken.agg(F.count(F.lit(1)).alias("taken"), F.countDistinct("workload").alias("workloads")).join(spark.read.text(raw).agg(F.count(F.lit(1)).alias("lines")), how="cross")


@query("SELECT DISTINCT user_id::VARCHAR AS workload FROM events")
def first_cell_ids(spark, d):
    return archives.first_cells(spark, _text(u.read(spark, d, "events").select("user_id", "event_id"), "cells", True), "user_id")


@query("SELECT workload, t, printf('%.10g', round(cpu / 3, 12)) AS cpu, printf('%.10g', mem * 1e11) AS mem FROM m", M)
def ten_digit_export(spark, d):
    """Numbers as text with ten significant digits, written sorted and read again."""
    m = u.means(spark, d).select("workload", "t", F.round(F.col("cpu") / 3, 12).alias("cpu"), (F.col("mem") * 1e11).alias("mem"))
    path = _folder(spark, "numbers")
    archives.write_numbers(m, path, ["workload", "t"])
    return spark.read.schema("workload long, t long, cpu string, mem string").option("header", True).csv(path)


@query("SELECT workload, t, round(cpu, 6) AS cpu, round(cpu_input, 6) AS cpu_input, target_observed, input_valid, imputed FROM f", FILL)
def portable_slots(spark, d):
    path = _folder(spark, "portable")
    f = u.filled(spark, d).select("workload", "t", "cpu", "cpu_input", "target_observed", "input_valid", "imputed")
    tables.write_bundle(f, path, ("parquet",))
    return spark.read.schema(f.schema).parquet(f"{path}/parquet")


@query("SELECT t % 3 AS \"L\", CASE WHEN workload % 2 = 0 THEN 'test' ELSE 'validation' END AS split, t // 5 AS origin, count(*) AS n, round(sum(cpu), 6) AS cpu FROM m GROUP BY 1, 2, 3", M)
def fragment_layout(spark, d):
    """A folder a unit of evaluation: L=, split=, origin=."""
    path = _folder(spark, "fragments")
    m = u.means(spark, d).select((F.col("t") % 3).alias("L"), F.when(F.col("workload") % 2 == 0, "test").otherwise("validation").alias("split"), F.floor(F.col("t") / 5).alias("origin"), "cpu")
    tables.write_bundle(m, path, ("parquet",), ("L", "split", "origin"))
    back = spark.read.parquet(f"{path}/parquet")
    return back.groupBy(F.col("L").cast("long").alias("L"), "split", F.col("origin").cast("long").alias("origin")).agg(F.count(F.lit(1)).alias("n"), F.sum("cpu").alias("cpu"))


@query("SELECT workload, to_json(list(t ORDER BY t)) AS slots FROM m GROUP BY 1", M)
def nested_csv_cells(spark, d):
    """Nested cells become JSON text in CSV."""
    path = _folder(spark, "nested")
    m = u.means(spark, d).groupBy("workload").agg(F.array_sort(F.collect_list("t")).alias("slots"))
    tables.write_bundle(m, path, ("csv",))
    return spark.read.option("header", True).option("escape", '"').schema("workload long, slots string").csv(f"{path}/csv")


@query("SELECT node, n, rows FROM (SELECT node, count(*) AS n FROM u GROUP BY 1), (SELECT count(*) AS rows FROM (SELECT DISTINCT node FROM u))", U)
def manifest_equal(spark, d):
    """A table's fingerprint does not depend on order or files; a byte copy has the same."""
    t = u.usage(spark, d).groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    one, two = _folder(spark, "one"), _folder(spark, "two")
    t.coalesce(1).write.parquet(one)
    file = spark.read.parquet(one).select("_metadata.file_path").first()
    if file:
        tables.copy_whole(spark, file[0], f"{two}/part.parquet")
    back = spark.read.schema(t.schema).parquet(two) if file else t
    a, b = (tables.manifest(x, ["node"]).first() for x in (t.repartition(3), back))
    if tuple(a) != tuple(b):
        raise AssertionError(f"fingerprints differ: {a}, {b}")
    return back.withColumn("rows", F.lit(int(a["rows"])).cast("long"))


@query("SELECT workload, t, count(*) AS n FROM u, (SELECT min(t) AS lo FROM u) WHERE t >= lo + 3 AND t < lo + 9 GROUP BY 1, 2", U)
def time_range(spark, d):
    """Half-open in time."""
    lo = (u.usage(spark, d).agg(F.min("t")).first()[0] or 0) + 3
    rows = u.read(spark, d, "events").select("user_id", u.seconds("ts").alias("sec"), "value", F.regexp_extract("props", r'"k": *([0-9]+)', 1).alias("k"))
    spec = src.SourceSpec("", "user_id", "sec", u.RULES)
    return src.observations(rows, spec, lo * u.DAY, (lo + 6) * u.DAY, u.DAY).groupBy("workload", "t").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT workload, t, round(cpu, 6) AS cpu FROM m WHERE workload % 7 = 3", M)
def workload_subset(spark, d):
    return src.select_workloads(u.means(spark, d), _picked(spark, d)).select("workload", "t", "cpu")


@query("SELECT c_custkey AS workload, min(o_orderkey) AS node FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def deployment_first(spark, d):
    """Each workload's first node; that none is missing was checked."""
    o = u.read(spark, d, "orders").select(F.col("o_custkey").alias("workload"), F.col("o_orderkey").alias("node"), F.col("o_orderkey").alias("at"))
    asked = u.read(spark, d, "customer").select(F.col("c_custkey").alias("workload"))
    return tables.deployment_nodes(o, asked.join(o, "workload", "left_semi"), "at")


@query("SELECT run, coalesce(n, 0) AS n_rows, n IS NOT NULL AS complete FROM (VALUES ('error'), ('absent'), ('view')) v(run) LEFT JOIN (SELECT event_type AS run, count(*) AS n FROM events GROUP BY 1) USING (run)")
def completeness(spark, d):
    return archives.completeness(u.read(spark, d, "events").select(F.col("event_type").alias("run")), ["error", "absent", "view"])


# ---- sequences, back-off and forecasts


@query("""SELECT workload, t, event, ctx, state FROM (SELECT *, lag(state, 2) OVER r || '>' || lag(state, 1) OVER r AS ctx
FROM (SELECT workload, t, CAST(cpu * 2 AS INT)::VARCHAR AS state, row_number() OVER (ORDER BY workload, t) - 1 AS event, t - row_number() OVER (PARTITION BY workload ORDER BY t) AS run FROM (SELECT workload, t, floor(cpu) AS cpu FROM m)) WINDOW r AS (PARTITION BY workload, run ORDER BY t)) WHERE ctx IS NOT NULL""", M)
def contexts_in_runs(spark, d):
    """Contexts of two states that gaps break, with a number of each event over all."""
    s = u.means(spark, d).select("workload", "t", (F.floor("cpu") * 2).cast("int").cast("string").alias("state"), F.lit(True).alias("input_valid"))
    return sequences.run_contexts(s, 2, _store).withColumn("ctx", F.array_join("ctx", ">"))


_PAIRS = [(long, ahead) for long in (2, 4, 7) for ahead in (1, 3)]
_SERVED = "ok AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT workload, t AS origin, '{a}/{b}' AS pair FROM (SELECT *, sum(input_valid::INT) OVER (PARTITION BY workload ORDER BY t ROWS BETWEEN {a - 1} PRECEDING AND CURRENT ROW) / {a}.0::DOUBLE AS share, lead(target_observed, {b}) OVER (PARTITION BY workload ORDER BY t) AS seen, min(t) OVER (PARTITION BY workload) AS start FROM f) WHERE input_valid AND t - start >= {a - 1} AND share >= 0.8 AND seen" for a, b in _PAIRS) + "), co AS (" + " INTERSECT ".join(f"SELECT workload, origin FROM ok WHERE pair = '{a}/{b}'" for a, b in _PAIRS) + ")"


@query("SELECT f.t AS origin, f.workload, coalesce(string_agg(pair, ' ' ORDER BY pair), '') AS valid, count(co.origin) > 0 AS common FROM f LEFT JOIN ok ON ok.workload = f.workload AND ok.origin = f.t LEFT JOIN co ON co.workload = f.workload AND co.origin = f.t WHERE (f.t - (SELECT min(t) FROM f)) % 2 = 0 GROUP BY 1, 2", f"{FILL}, {_SERVED}")
def common_origins(spark, d):
    """Every second slot: the histories and horizons that each workload can serve there, and where all of them meet."""
    f = u.filled(spark, d)
    lo, hi = f.agg(F.min("t"), F.max("t")).first()
    return ingest.common_origins(f, lo or 0, hi or 0, 2, [2, 4, 7], [1, 3]).withColumn("valid", F.array_join("valid", " "))


@query("""SELECT l.workload, CAST(h AS INT) AS h, last + h * coalesce(step, 1) AS t FROM (SELECT workload, max(t) AS last FROM m GROUP BY 1) l CROSS JOIN range(1, 5) r(h)
LEFT JOIN (SELECT workload, CAST(quantile_disc(x, 0.5) AS BIGINT) AS step FROM (SELECT workload, t - lag(t) OVER (PARTITION BY workload ORDER BY t) AS x FROM m) WHERE x IS NOT NULL GROUP BY 1) c USING (workload)""", M)
def future_times(spark, d):
    return sequences.future_times(u.means(spark, d).select("workload", "t"), 4)


def _direct_sql(digits: str = ", 6)") -> str:
    ctx = {0: "''", 1: "a", 2: "b || '>' || a"}
    parts = ["p0 AS (SELECT *, row_number() OVER o - 1 AS pos, count(*) OVER (PARTITION BY workload) AS n, lag(state, 1) OVER o AS a, lag(state, 2) OVER o AS b FROM s WHERE t < (SELECT max(t) FROM s) WINDOW o AS (PARTITION BY workload ORDER BY sec, event_id))", "cur AS (SELECT workload, '' AS c0, max(state) FILTER (pos = n - 1) AS c1, max(state) FILTER (pos = n - 2) || '>' || max(state) FILTER (pos = n - 1) AS c2 FROM p0 GROUP BY 1)", "base AS (SELECT cur.*, h, state FROM cur CROSS JOIN range(1, 4) r(h) CROSS JOIN (SELECT DISTINCT state FROM s))"]
    sel, joins = "SELECT base.workload, base.h, base.state", " FROM base"
    for k in range(3):
        parts.append(f"o{k} AS (SELECT ctx, h, state, sum(exp(-0.02 * (n - pos + h))) AS c FROM (SELECT {ctx[k]} AS ctx, * FROM p0) CROSS JOIN range(1, 4) r(h) WHERE ctx IS NOT NULL AND pos >= h - 1 GROUP BY 1, 2, 3)")
        sel += f", coalesce(o{k}.c, 0) AS c{k}, coalesce(sum(o{k}.c) OVER w, 0) AS n{k}"
        joins += f" LEFT JOIN o{k} ON o{k}.ctx = base.c{k} AND o{k}.h = base.h AND o{k}.state = base.state"
    parts.append(f"j AS ({sel}, count(*) OVER w AS ks{joins} WINDOW w AS (PARTITION BY base.workload, base.h))")
    ps = ", ".join(f"CASE WHEN n{k} > 0 THEN (c{k} + 1) / (n{k} + ks) ELSE 1.0::DOUBLE / ks END AS p{k}, CASE WHEN n{k} > 0 THEN 1 / (1 + exp(-greatest(least(n{k} - 2, 60), -60))) ELSE 0 END AS g{k}" for k in range(3))
    return f"WITH {S}, " + ", ".join(parts) + f" SELECT workload, CAST(h AS INT) AS h, state, {'round(' if digits else ''}g2 * p2 + (1 - g2) * g1 * p1 + (1 - g2) * (1 - g1) * p0{digits} AS p FROM (SELECT *, {ps} FROM j)"


@query(_direct_sql())
def direct_all_orders(spark, d):
    s = u.states(spark, d)
    return markov.direct_orders(s, ORDER, 3, s.agg(F.max("t")).first()[0] or 0, 2, 0.02, 1.0, s.select("state").distinct())


def _rule(rows: int, columns: int, a: int, b: int) -> list:
    return [[((i * a + j * b) % 11 - 5) / 10 for j in range(columns)] for i in range(rows)]


#: Fixed parameters of direct forecasts over five states, by a rule.
HEAD = forecast.DirectHead(into=_rule(7, 3, 7, 3), into_bias=_rule(1, 3, 0, 4)[0], out=_rule(3, 25, 5, 2), out_bias=_rule(1, 25, 0, 7)[0], prior=[[0.4 if i == j else 0.15 for j in range(5)] for i in range(5)], of_state=_rule(5, 3, 3, 8), of_horizon=_rule(4, 3, 9, 2), correct_bias=_rule(1, 3, 0, 6)[0], correct=_rule(3, 5, 4, 7), longest=8, period=7.0, blend=0.4)


def _head_sql(b) -> str:
    k = range(len(b.prior))
    times = lambda names, rows, j, bias=None: "(" + " + ".join(f"{n} * {rows[i][j]!r}::DOUBLE" for i, n in enumerate(names)) + (f" + {bias[j]!r}::DOUBLE" if bias else "") + ")"
    mu = [f"m{i}" for i in k]
    z = ", ".join(f"tanh({times([*mu, 'sin(t * 2 * pi() / 7)', 'cos(t * 2 * pi() / 7)'], b.into, j, b.into_bias)}) AS z{j}" for j in range(3))
    e = ", ".join(f"exp({times(['z0', 'z1', 'z2'], b.out, i * 5 + j, b.out_bias)} + ln({b.prior[i][j]!r}::DOUBLE)) AS e{i}{j}" for i in k for j in k)
    d = ", ".join(" + ".join(f"m{i} * e{i}{j} / ({' + '.join(f'e{i}{q}' for q in k)})" for i in k) + f" AS d{j}" for j in k)
    features = ["h / 8.0::DOUBLE", "ln(1 + h) / ln(9)", "sin(2 * pi() * h / 8.0::DOUBLE)", "cos(2 * pi() * h / 8.0::DOUBLE)"]
    c = ", ".join(f"tanh({times(mu, b.of_state, j, b.correct_bias)} + {times(features, b.of_horizon, j)}) AS c{j}" for j in range(3))
    w = ", ".join(f"exp(ln(greatest(d{j} * {1 - b.blend!r}::DOUBLE + b[{j + 1}] * {b.blend!r}::DOUBLE, 1e-12)) + {times(['c0', 'c1', 'c2'], b.correct, j)}) AS w{j}" for j in k)
    shares = ", ".join(f"max(n) FILTER (i = {i + 1}) / sum(n)::DOUBLE AS m{i}" for i in k)
    return f"""st AS (SELECT state, row_number() OVER (ORDER BY state) AS i FROM (SELECT DISTINCT state FROM s)),
sm AS (SELECT workload, {shares} FROM (SELECT workload, i, count(x.state) + 1 AS n FROM (SELECT DISTINCT workload FROM s WHERE t < (SELECT max(t) FROM s)) CROSS JOIN st LEFT JOIN (SELECT workload AS u, state FROM s WHERE t < (SELECT max(t) FROM s)) x ON x.u = workload AND x.state = st.state GROUP BY 1, 2) GROUP BY 1),
bk AS (SELECT workload, h, list(p ORDER BY state) AS b FROM ({_direct_sql("")}) GROUP BY 1, 2),
z AS (SELECT *, {z} FROM (SELECT sm.*, h, b, (SELECT max(t) FROM s) - 1 + h AS t FROM sm JOIN bk USING (workload))),
w AS (SELECT *, {w} FROM (SELECT *, {d}, {c} FROM (SELECT *, {e} FROM z)))"""


@query("SELECT workload, h, state, round(([w0, w1, w2, w3, w4])[i] / (w0 + w1 + w2 + w3 + w4), 6) AS p, round(([d0, d1, d2, d3, d4])[i], 6) AS dynamic FROM w, st", f"{S}, {_head_sql(HEAD)}")
def direct_forecast(spark, d):
    """Each user's mix of states before the last day, forecast 1 to 3 days ahead, every day on its own; fixed parameters."""
    s = u.states(spark, d)
    now = s.agg(F.max("t")).first()[0] or 0
    kinds = [r[0] for r in s.select("state").distinct().orderBy("state").collect()]
    past = s.where(F.col("t") < now).groupBy("workload").agg(*(F.count_if(F.col("state") == x).alias(f"n{i}") for i, x in enumerate(kinds)))
    total = sum((F.col(f"n{i}") for i in range(1, len(kinds))), F.col("n0")) + len(kinds)
    mu = past.select("workload", F.array(*((F.col(f"n{i}") + 1) / total for i in range(len(kinds)))).alias("mu"))
    back = markov.direct_orders(s, ORDER, 3, now, 2, 0.02, 1.0, s.select("state").distinct())
    back = back.groupBy("workload", "h").agg(F.transform(F.array_sort(F.collect_list(F.struct("state", "p"))), lambda x: x["p"]).alias("back"))
    rows = mu.join(back, "workload").withColumn("t", F.lit(now - 1) + F.col("h"))
    out = forecast.direct_forecast(rows, ["workload"], HEAD)
    return out.select("workload", "h", F.explode(F.arrays_zip(F.array(*map(F.lit, kinds)).alias("state"), "p", "dynamic")).alias("x")).select("workload", "h", "x.*")


@query("SELECT k AS \"order\", ctx, state, round(sum(exp(-0.02 * (now - t))), 6) AS c FROM (SELECT *, (SELECT max(t) + 1 FROM s) AS now FROM (SELECT 0 AS k, '' AS ctx, t, state FROM o UNION ALL SELECT 1, a, t, state FROM o WHERE a IS NOT NULL UNION ALL SELECT 2, b || '>' || a, t, state FROM o WHERE b IS NOT NULL)) WHERE now - t <= 20 GROUP BY 1, 2, 3", f"{S}, o AS (SELECT *, lag(state, 1) OVER q AS a, lag(state, 2) OVER q AS b FROM s WINDOW q AS (PARTITION BY workload ORDER BY sec, event_id))")
def context_store(spark, d):
    """Sixteen appends, an expiry, an export and an import give the counts that one batch gives."""
    s = u.states(spark, d).select("workload", "t", "sec", "event_id", "state")
    lo, hi = s.agg(F.min("t"), F.max("t")).first()
    store = ContextStore(spark, _folder(spark, "contexts"), 2, ("sec", "event_id"))
    days = max(1, -(-((hi or 0) - (lo or 0) + 1) // 16))
    for i in range(16):
        store.append(s.where((F.col("t") >= (lo or 0) + i * days) & (F.col("t") < (lo or 0) + (i + 1) * days)))
    store.expire((hi or 0) + 1 - 20)
    moved = _folder(spark, "moved")
    store.export(moved)
    other = ContextStore(spark, _folder(spark, "contexts"), 2, ("sec", "event_id"))
    other.load(moved)
    return other.counts((hi or 0) + 1, 0.02, 20).withColumn("ctx", F.array_join("ctx", ">"))


@query("SELECT w.workload, m.b AS state, round(m.p, 6) AS p FROM (SELECT workload, arg_max(state, (sec, event_id)) AS a FROM s GROUP BY 1) w JOIN (SELECT a, state AS b, count(*) / sum(count(*)) OVER (PARTITION BY a)::DOUBLE AS p FROM x WHERE a IS NOT NULL GROUP BY 1, 2) m ON m.a = w.a", f"{S}, {_CTX}")
def static_kernel(spark, d):
    """One step of every workload's last state through the transitions of all, without smoothing."""
    s = u.states(spark, d)
    n = sequences.transition_counts(s, ORDER)
    matrix = n.join(n.groupBy("from_state").agg(F.sum("n").alias("all")), "from_state").select("from_state", "to_state", (F.col("n") / F.col("all")).alias("p"))
    now = s.groupBy("workload").agg(F.max_by("state", F.struct(*ORDER)).alias("state")).withColumn("mu", F.lit(1.0))
    return markov.dynamic(now, matrix)


@query("""SELECT workload, state, round(v / sum(v) OVER (PARTITION BY workload), 6) AS p FROM (SELECT workload, state, 0.7 * coalesce(a.p, 0) + 0.3 * coalesce(b.p, 0) AS v
FROM (SELECT workload, state, count(*) / 10.0::DOUBLE AS p FROM s WHERE state < 'm' GROUP BY 1, 2) a FULL JOIN (SELECT workload, state, count(*) / 5.0::DOUBLE AS p FROM s WHERE state > 'e' GROUP BY 1, 2) b USING (workload, state))""", S)
def blend_two_sides(spark, d):
    """A state that one side alone has keeps its part."""
    s = u.states(spark, d)
    share = lambda rows, by: rows.groupBy("workload", "state").agg((F.count(F.lit(1)) / by).alias("p"))
    return markov.blended(share(s.where("state < 'm'"), 10.0), share(s.where("state > 'e'"), 5.0), 0.3)


# ---- choices, prototypes and memberships


_ORIGINS = "og AS (SELECT unnest(range(lo, hi - 2)) AS origin FROM (SELECT min(t) AS lo, max(t) AS hi FROM m))"


def _origins(spark, d) -> list[int]:
    """Every slot of the table that has three more after it."""
    lo, hi = u.means(spark, d).agg(F.min("t"), F.max("t")).first()
    return [r["origin"] for r in ingest.origins(spark, lo or 0, (hi or 0) + 1, 1, 3, 1).orderBy("origin").collect()]


@query("SELECT DISTINCT o[CAST(round(i * (n - 1) / 9.0::DOUBLE) AS INT) + 1] AS origin FROM (SELECT list(origin ORDER BY origin) AS o, count(*) AS n FROM og), range(10) r(i)", f"{M}, {_ORIGINS}")
def thinned_origins(spark, d):
    return spark.createDataFrame([(x,) for x in sampling.thin(_origins(spark, d), 10)], "origin long")


@query("SELECT epoch, least(4, n) AS n, least(4, n) AS different, true AS inside FROM range(3) r(epoch), (SELECT count(*) AS n FROM og)", f"{M}, {_ORIGINS}")
def epoch_origins(spark, d):
    """Of each epoch's draw from the table's origins: how many, how many of them different, all among the candidates."""
    every = _origins(spark, d)
    drawn = [(e, x) for e in range(3) for x in sampling.epoch_choice(every, 4, 7, e)]
    rows = spark.createDataFrame(drawn, "epoch long, origin long")
    return rows.groupBy("epoch").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("origin").alias("different"), F.every((F.col("origin") >= every[0]) & (F.col("origin") <= every[-1])).alias("inside"))


@query("SELECT row_number() OVER (ORDER BY c) - 1 AS state, round(c[1], 6) AS first FROM (SELECT list(y ORDER BY pos) AS c FROM (SELECT label, pos, avg(x) AS y FROM (SELECT label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY 1, 2) GROUP BY label)")
def centroid_order(spark, d):
    """The means of all labels' vectors, in order of their components."""
    parts = u.read(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("pos", "x"))
    c = parts.groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("y")).groupBy(F.col("label").alias("state")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "y"))), lambda p: p["y"]).alias("c"))
    return shapes.ordered_centroids(c).select("state", F.get("c", F.lit(0)).alias("first"))


_PICK = "c{0} AS MATERIALIZED (SELECT * FROM (SELECT p.id, p.x, p.y FROM pt p CROSS JOIN ({1}) c WHERE p.id NOT IN (SELECT id FROM ({1})) GROUP BY 1, 2, 3 ORDER BY min(round((((p.x - c.x) * (p.x - c.x) + (p.y - c.y) * (p.y - c.y)) / 2), 12)) DESC, p.id LIMIT 1))"
_PICKS = ", ".join(["pt AS MATERIALIZED (SELECT workload * 100000 + t AS id, cpu_input AS x, mem_input AS y FROM f WHERE input_valid)", "c0 AS MATERIALIZED (SELECT id, x, y FROM pt, (SELECT avg(x) AS a, avg(y) AS b FROM pt) ORDER BY round((x - a) * (x - a) + (y - b) * (y - b), 12), id LIMIT 1)", *(_PICK.format(i, " UNION ALL ".join(f"SELECT * FROM c{j}" for j in range(i))) for i in range(1, 5))])


@query(" UNION ALL ".join(f"SELECT {i} AS state, id, round(x, 6) AS cpu, round(y, 6) AS mem FROM c{i}" for i in range(5)), f"{FILL}, {_PICKS}")
def slot_prototypes(spark, d):
    """Five slots of all that lie far apart: the points of flat prototypes."""
    f = u.filled(spark, d).where("input_valid").select((F.col("workload") * 100_000 + F.col("t")).alias("id"), F.array("cpu_input", "mem_input").alias("x"))
    return spark.createDataFrame([(i, int(p), float(x[0]), float(x[1])) for i, (p, x) in enumerate(shapes.spread_out(f, 5))], "state int, id long, cpu double, mem double")


_SPREAD_ROUND = """al{0} AS (SELECT p.id, p.x, c.x AS y, 0::BIGINT AS r, list_prepend({{'c': 0.0::DOUBLE, 'n': 0::BIGINT}}, list_transform(c.x, lambda v: {{'c': 'infinity'::DOUBLE, 'n': 0::BIGINT}})) AS row FROM pw p, w{0} c
  UNION ALL SELECT id, x, y, r + 1, list_reduce(list_transform(range(1, len(y) + 1), lambda q: [{{'c': (x[r + 1] - y[q]) * (x[r + 1] - y[q]), 'n': q}}]), lambda acc, e: list_append(acc, {{'c': (""" + _BEST + """).c + e[1].c, 'n': (""" + _BEST + """).n + 1}}), [{{'c': 'infinity'::DOUBLE, 'n': 0::BIGINT}}]) FROM al{0} WHERE r < len(x)),
n{0} AS MATERIALIZED (SELECT id, x, least({2}round(sqrt(row[len(row)].c / row[len(row)].n), 9)) AS near FROM al{0}{3} WHERE r = len(x)),
w{1} AS MATERIALIZED (SELECT id, x FROM n{0} WHERE id NOT IN ({4}) ORDER BY near DESC, id LIMIT 1)"""
_SPREAD = ", ".join(["ws AS (SELECT workload * 100000 + t AS id, list(CASE WHEN input_valid THEN cpu_input END) OVER o AS xs FROM f WINDOW o AS (PARTITION BY workload ORDER BY t ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))", "wv AS (SELECT id, list_filter(xs, lambda v: v IS NOT NULL) AS v FROM ws)", "pw AS MATERIALIZED (SELECT id, list_transform(range(4), lambda i: v[CAST(floor(i * (len(v) - 1) / 3.0::DOUBLE) AS INT) + 1] * (1 - (i * (len(v) - 1) / 3.0::DOUBLE - floor(i * (len(v) - 1) / 3.0::DOUBLE))) + v[least(CAST(floor(i * (len(v) - 1) / 3.0::DOUBLE) AS INT) + 2, len(v))] * (i * (len(v) - 1) / 3.0::DOUBLE - floor(i * (len(v) - 1) / 3.0::DOUBLE))) AS x FROM wv WHERE len(v) > 0)",
    "w0 AS MATERIALIZED (SELECT id, x FROM pw ORDER BY md5(id::VARCHAR), id LIMIT 1)", *(_SPREAD_ROUND.format(i, i + 1, f"n{i - 1}.near, " if i else "", f" JOIN n{i - 1} USING (id, x)" if i else "", " UNION ALL ".join(f"SELECT id FROM w{j}" for j in range(i + 1))) for i in range(3))])


@query(" UNION ALL ".join(f"SELECT {i} AS state, id, round(x[1], 6) AS first, round(x[4], 6) AS last FROM w{i}" for i in range(4)), f"RECURSIVE {FILL}, {_SPREAD}")
def spread_windows(spark, d):
    """Four windows of five slots, of all that there are, that lie far apart by warped distance."""
    w = Window.partitionBy("workload").orderBy("t").rowsBetween(-4, 0)
    f = u.filled(spark, d).withColumn("xs", F.collect_list(F.when(F.col("input_valid"), F.struct("t", "cpu_input"))).over(w))
    windows = f.select((F.col("workload") * 100_000 + F.col("t")).alias("id"), F.transform(F.array_sort("xs"), lambda x: x["cpu_input"]).alias("series"))
    return spark.createDataFrame([(i, int(n), float(x[0]), float(x[-1])) for i, (n, x) in enumerate(shapes.spread_windows(windows, 4, 4, _store))], "state int, id long, first double, last double")


_VEC = "v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS x FROM embeddings)"


@query("SELECT id, pos, round(CASE WHEN mass > 1e-12 THEN greatest(x, 0) / mass ELSE 1.0::DOUBLE / k END, 6) AS mu FROM (SELECT id, unnest(x) AS x, generate_subscripts(x, 1) - 1 AS pos, list_sum(list_transform(x, lambda e: greatest(e, 0))) AS mass, len(x) AS k FROM v)", _VEC)
def simplex_vectors(spark, d):
    v = u.read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("x"))
    return v.select("id", F.posexplode(arrays.simplex(F.col("x"))).alias("pos", "mu")).withColumn("pos", F.col("pos").cast("long"))


@query("SELECT id, len(list_filter(x, lambda e: NOT isfinite(e) OR e < -1e-6)) = 0 AND abs(list_sum(x) - 1) <= 1e-6 AS raw_ok, list_sum(list_transform(x, lambda e: greatest(e, 0))) > 1e-12 AS normalised_ok FROM v", _VEC)
def simplex_check(spark, d):
    v = u.read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("x"))
    return v.select("id", arrays.is_simplex(F.col("x")).alias("raw_ok"), arrays.is_simplex(arrays.simplex(F.col("x"))).alias("normalised_ok"))


@query("SELECT DISTINCT t, round(sin(t * 2 * pi() / 7), 6) AS s, round(cos(t * 2 * pi() / 7), 6) AS c, round(1 / (1 + exp(-(t % 9 - 4.0::DOUBLE))), 6) AS g, round(tanh((t % 9 - 4) / 2.0::DOUBLE), 6) AS b FROM m", M)
def scalar_functions(spark, d):
    s, c = arrays.phase(F.col("t"), 7)
    x = (F.col("t") % 9 - 4).cast("double")
    return u.means(spark, d).select("t").distinct().select("t", s.alias("s"), c.alias("c"), arrays.sigmoid(x).alias("g"), arrays.bipolar(x).alias("b"))


@query("SELECT workload, t, state, round(exp(z - top) / sum(exp(z - top)) OVER (PARTITION BY workload, t), 6) AS mu FROM (SELECT *, max(z) OVER (PARTITION BY workload, t) AS top FROM (SELECT workload, t, CAST(i AS INT) AS state, -((cpu_input - c) * (cpu_input - c) + (mem_input - c) * (mem_input - c)) / greatest(2 * 0.25 * 0.5, 1e-8) AS z FROM f, (VALUES (0, 0.2::DOUBLE), (1, 0.5::DOUBLE), (2, 1.0::DOUBLE)) v(i, c) WHERE input_valid))", FILL)
def slot_memberships(spark, d):
    f = u.filled(spark, d).where("input_valid")
    mu = arrays.slot_membership(F.array("cpu_input", "mem_input"), F.array(*[F.array(F.lit(x), F.lit(x)) for x in (0.2, 0.5, 1.0)]), 0.5, 0.5)
    return f.select("workload", "t", F.posexplode(mu).alias("state", "mu"))


_WIN = """w AS (SELECT workload, t, list(CASE WHEN input_valid THEN cpu_input END) OVER o AS xs FROM f WINDOW o AS (PARTITION BY workload ORDER BY t ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)),
v AS (SELECT workload, t, list_filter(xs, lambda x: x IS NOT NULL) AS x FROM w),
y AS (SELECT workload, t, CASE WHEN len(x) = 0 THEN [0.0, 0.0, 0.0] WHEN len(x) = 1 THEN [x[1], x[1], x[1]] ELSE list_transform([0, 1, 2], lambda i: x[CAST(floor(i * (len(x) - 1) / 2.0::DOUBLE) AS INT) + 1] * (1 - (i * (len(x) - 1) / 2.0::DOUBLE - floor(i * (len(x) - 1) / 2.0::DOUBLE))) + x[least(CAST(floor(i * (len(x) - 1) / 2.0::DOUBLE) AS INT) + 2, len(x))] * (i * (len(x) - 1) / 2.0::DOUBLE - floor(i * (len(x) - 1) / 2.0::DOUBLE))) END AS y FROM v),
z AS (SELECT workload, t, CAST(s AS INT) AS state, -list_sum(list_transform(y, lambda e: (e - c) * (e - c))) / 3 / 2 / 0.25 AS z FROM y, (VALUES (0, 0.2::DOUBLE), (1, 0.5::DOUBLE), (2, 1.0::DOUBLE)) p(s, c))"""


@query("SELECT workload, t, state, round(exp(z - top) / sum(exp(z - top)) OVER (PARTITION BY workload, t), 6) AS mu FROM (SELECT *, max(z) OVER (PARTITION BY workload, t) AS top FROM z)", f"{FILL}, {_WIN}")
def window_memberships_sql(spark, d):
    """Windows of five slots against flat prototypes of three points."""
    import numpy as np

    f = u.filled(spark, d).select("workload", "t", F.coalesce("cpu_input", F.lit(0.0)).alias("cpu"), "input_valid")
    return shapes.window_memberships(f, ["cpu"], np.stack([np.full((3, 1), x) for x in (0.2, 0.5, 1.0)]), 5).select("workload", "t", F.posexplode("mu").alias("state", "mu"))


# ---- graphs


_NATION = "dp AS (SELECT s_suppkey AS workload, s_nationkey AS node FROM supplier), ln AS (SELECT src, dst, avg(bandwidth) AS bandwidth FROM links GROUP BY 1, 2)"


def _nation_graph(spark, d):
    """All suppliers by nation, and the links between nations over all time."""
    dep = u.read(spark, d, "supplier").select(F.col("s_suppkey").alias("workload"), F.col("s_nationkey").alias("node"))
    return dep, u.links(spark, d).groupBy("src", "dst").agg(F.avg("bandwidth").alias("bandwidth"))


@query("SELECT a.workload AS src, b.workload AS dst, count(*)::DOUBLE AS weight FROM (SELECT src, dst FROM ln WHERE bandwidth <> 0 UNION ALL SELECT DISTINCT node, node FROM dp) e JOIN dp a ON a.node = e.src JOIN dp b ON b.node = e.dst WHERE a.workload <> b.workload GROUP BY 1, 2", f"{LINK}, {_NATION}")
def live_adjacency(spark, d):
    dep, links = _nation_graph(spark, d)
    return graph.live_adjacency(dep, links, ["bandwidth"], _store)


@query("SELECT a.workload AS w_src, b.workload AS w_dst, round(avg(bandwidth), 6) AS bandwidth FROM ln e JOIN dp a ON a.node = e.src JOIN dp b ON b.node = e.dst WHERE a.workload <> b.workload GROUP BY 1, 2", f"{LINK}, {_NATION}")
def projected_links(spark, d):
    dep, links = _nation_graph(spark, d)
    return graph.project_links(dep, links, ["bandwidth"], _store)


@query("SELECT size, hyperedge, count(*) AS nodes FROM (SELECT node, count(*) AS size, count(*) >= 3 AS hyperedge FROM dep GROUP BY 1) GROUP BY 1, 2", DEP)
def node_sizes(spark, d):
    return graph.identifiability(u.deployment(spark, d)).groupBy("size", "hyperedge").agg(F.count(F.lit(1)).alias("nodes"))


@query("SELECT src, dst, 1.0::DOUBLE AS weight FROM adj WHERE src % 3 = 0 AND dst % 3 = 0", DEP)
def masked_adjacency(spark, d):
    dep = u.deployment(spark, d)
    return graph.masked(graph.adjacency(dep), dep.where("workload % 3 = 0"))


@query("""SELECT count(*) AS workloads, count(DISTINCT component) AS components, max(n) AS largest, round(max(n) / count(*), 6) AS largest_ratio FROM (SELECT c_custkey, c_nationkey AS component, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer)""")
def largest_component(spark, d):
    """Customers joined through their nation: components by propagation, whose answer here is the nation itself."""
    dep = u.read(spark, d, "customer").select(F.col("c_custkey").alias("workload"), F.col("c_nationkey").alias("node"))
    star = dep.join(dep.groupBy("node").agg(F.min("workload").alias("hub")), "node").select(F.col("workload").alias("src"), F.col("hub").alias("dst"))
    return graph.largest_component(graph.component_sizes(star, dep, _store))


#: Fixed parameters of a small gated block: two states, one resource, four link features, two hidden numbers, two rounds.
BLOCK = graph.GatedBlock(theta=[[0.7, -0.4], [-0.3, 0.9], [0.5, 0.2]], into=[[0.6, -0.2], [-0.5, 0.8], [0.3, 0.4]], into_bias=[0.05, -0.1], own=[[[0.9, 0.1], [-0.2, 0.7]], [[0.4, -0.6], [0.5, 0.3]]], own_bias=[[0.02, 0.03], [-0.04, 0.01]], message=[[[0.5, -0.3], [0.2, 0.6]], [[-0.4, 0.7], [0.1, 0.5]]], link=[0.4, -0.3, -0.2, 0.5], link_bias=0.1, head=[[0.8, -0.5], [-0.7, 0.6]], head_bias=[0.03, -0.02])


def _gated_sql(b) -> str:
    """The same block as SQL: a common table expression a round."""
    times = lambda names, rows, j, bias=None: " + ".join(f"{n} * {rows[i][j]!r}::DOUBLE" for i, n in enumerate(names)) + (f" + {bias[j]!r}::DOUBLE" if bias else "")
    moved = ", ".join(f"greatest(0.5 * (1 + (2 * m{i} - 1 + e{i}) / greatest(1 + (2 * m{i} - 1) * e{i}, 1e-12)), 0) AS v{i}" for i in (0, 1))
    evidence = ", ".join(f"{b.strength!r}::DOUBLE * tanh({times(['coalesce(nm0, 0)', 'coalesce(nm1, 0)', 'coalesce(neighbours, 0) / 24.0::DOUBLE'], b.theta, i)}) * has AS e{i}" for i in (0, 1))
    score = " + ".join(f"{c} * {w!r}::DOUBLE" for c, w in zip(("bandwidth / 40000", "delay / 25", "loss * 20", "availability * 25"), b.link))
    out = [
        f"ge AS (SELECT time_bucket AS t, dst AS node, src AS near, 1 / (1 + exp(-({b.link_bias!r}::DOUBLE + {score}))) AS gate FROM links)",
        "sh AS (SELECT *, gate / sum(gate) OVER (PARTITION BY t, node) AS share FROM ge)",
        "nd AS (SELECT t, n_nationkey AS node, (1 + (n_nationkey * 7 + t) % 5) / 6.0::DOUBLE AS m0, 1 - (1 + (n_nationkey * 7 + t) % 5) / 6.0::DOUBLE AS m1, n_regionkey / 4.0::DOUBLE AS x0 FROM nation, (SELECT DISTINCT time_bucket AS t FROM links))",
        "nm AS (SELECT sh.t, sh.node, sum(share * m0) AS nm0, sum(share * m1) AS nm1, count(*) AS neighbours, avg(gate) AS gate_mean FROM sh JOIN nd ON nd.t = sh.t AND nd.node = sh.near GROUP BY 1, 2)",
        f"ad AS (SELECT t, node, m0, m1, x0, neighbours, gate_mean, has, v0 / (v0 + v1) AS a0, v1 / (v0 + v1) AS a1 FROM (SELECT *, {moved} FROM (SELECT *, {evidence} FROM (SELECT nd.*, nm0, nm1, neighbours, gate_mean, (nm0 IS NOT NULL)::INT AS has FROM nd LEFT JOIN nm USING (t, node)))))",
        f"h0 AS (SELECT *, {', '.join(f'tanh({times(["a0", "a1", "x0"], b.into, j, b.into_bias)}) AS h{j}' for j in (0, 1))} FROM ad)",
    ]
    for i in range(len(b.own)):
        hidden = ", ".join(f"tanh({times(['p.h0', 'p.h1'], b.own[i], j, b.own_bias[i])} + {times(['coalesce(q.h0, 0)', 'coalesce(q.h1, 0)'], b.message[i], j)}) AS h{j}" for j in (0, 1))
        out.append(f"h{i + 1} AS (SELECT p.t, p.node, m0, m1, neighbours, gate_mean, has, a0, a1, {hidden} FROM h{i} p LEFT JOIN (SELECT sh.t, sh.node, sum(share * h0) AS h0, sum(share * h1) AS h1 FROM sh JOIN h{i} x ON x.t = sh.t AND x.node = sh.near GROUP BY 1, 2) q ON q.t = p.t AND q.node = p.node)")
    logits = ", ".join(f"exp(ln(greatest(a{j}, 1e-12)) + ({times(['h0', 'h1'], b.head, j, b.head_bias)}) * has) AS w{j}" for j in (0, 1))
    out.append(f"fi AS (SELECT *, w0 / (w0 + w1) AS y0, w1 / (w0 + w1) AS y1 FROM (SELECT *, {logits} FROM h{len(b.own)}))")
    return ", ".join(out)


@query("SELECT t, node, round(y0, 6) AS mu0, coalesce(neighbours, 0) AS neighbours, round(gate_mean, 6) AS gate_mean, round(abs(y0 - m0) + abs(y1 - m1), 6) AS shift, round(sqrt(h0 * h0 + h1 * h1), 6) AS context FROM fi", f"{LINK}, {_gated_sql(BLOCK)}")
def gated_messages(spark, d):
    """Nations in each month, joined by the links of that month; fixed parameters."""
    links = u.links(spark, d)
    scaled = F.array(F.col("bandwidth") / 40000, F.col("delay") / 25, F.col("loss") * 20, F.col("availability") * 25)
    edges = links.select(F.col("time_bucket").alias("t"), F.col("dst").alias("node"), F.col("src").alias("near"), F.lit(1.0).alias("weight"), scaled.alias("features"))
    m = (1 + (F.col("n_nationkey") * 7 + F.col("t")) % 5) / F.lit(6.0)
    nodes = u.read(spark, d, "nation").join(F.broadcast(links.select(F.col("time_bucket").alias("t")).distinct()), how="cross")
    nodes = nodes.select("t", F.col("n_nationkey").alias("node"), F.array(m, 1 - m).alias("mu"), F.array(F.col("n_regionkey") / F.lit(4.0)).alias("x"))
    return graph.gated_messages(nodes, edges, ["t"], BLOCK, _store, "features").select("t", "node", F.get("mu", F.lit(0)).alias("mu0"), "neighbours", "gate_mean", "shift", "context")


_W = ((0.8, -0.1), (0.2, 0.5)), ((0.3, 0.1), (-0.2, 0.4))


@query("""SELECT node, round(tanh(x1 * 0.8 + x2 * 0.2 + coalesce(m1 * 0.3 - m2 * 0.2, 0)), 6) AS a, round(tanh(-x1 * 0.1 + x2 * 0.5 + coalesce(m1 * 0.1 + m2 * 0.4, 0)), 6) AS b
FROM (SELECT n_nationkey AS node, n_nationkey / 25.0::DOUBLE AS x1, n_regionkey / 5.0::DOUBLE AS x2 FROM nation) n LEFT JOIN (SELECT dst, sum(gate / s * n_nationkey / 25.0::DOUBLE) AS m1, sum(gate / s * n_regionkey / 5.0::DOUBLE) AS m2 FROM (SELECT *, sum(gate) OVER (PARTITION BY dst) AS s FROM gt) JOIN nation ON n_nationkey = src GROUP BY 1) ON dst = node""", _GATE)
def propagate_vectors(spark, d):
    values = u.read(spark, d, "nation").select(F.col("n_nationkey").alias("node"), F.array(F.col("n_nationkey") / F.lit(25.0), F.col("n_regionkey") / F.lit(5.0)).alias("x"))
    out = graph.propagate_matrix(values, _gates(spark, d), *_W)
    return out.select("node", F.get("x", F.lit(0)).alias("a"), F.get("x", F.lit(1)).alias("b"))


@query("""SELECT workload, CAST(i AS INT) AS state, round(e / sum(e) OVER (PARTITION BY workload), 6) AS mu FROM (SELECT workload, i, greatest(CASE i WHEN 0 THEN m0 ELSE m1 END, 1e-12) * exp(tanh(CASE i WHEN 0 THEN 0.5 * m0 - 0.3 * m1 + 0.2 * c + 0.1 ELSE -0.4 * m0 + 0.6 * m1 - 0.1 * c END)) AS e
FROM (SELECT c_custkey AS workload, (c_custkey % 7) / 7.0::DOUBLE AS m0, 1 - (c_custkey % 7) / 7.0::DOUBLE AS m1, (c_custkey % 5) / 5.0::DOUBLE AS c FROM customer), (VALUES (0), (1)) v(i))""")
def residual_modulation(spark, d):
    x = (F.col("c_custkey") % 7) / F.lit(7.0)
    mu = graph.residual(F.array(x, 1 - x), F.array((F.col("c_custkey") % 5) / F.lit(5.0)), [[0.5, -0.4], [-0.3, 0.6], [0.2, -0.1]], [0.1, 0.0])
    return u.read(spark, d, "customer").select(F.col("c_custkey").alias("workload"), F.posexplode(mu).alias("state", "mu"))


# ---- metrics


def _vectors(spark, d):
    """(workload, h, state, truth, pred): a one-hot truth beside each membership, with a horizon by id."""
    m = u.memberships(spark, d)
    return m.select("workload", (F.col("workload") % 4).alias("h"), "state", (F.col("state") == F.col("truth")).cast("double").alias("truth"), F.col("mu").alias("pred"))


_V = MU + ", vv AS (SELECT workload, workload % 4 AS h, state, (state = truth)::INT::DOUBLE AS t, mu AS p FROM mu)"


@query("""SELECT count(*) AS n_samples, round(avg((y = x)::INT), 6) AS dominant_state_accuracy, round(avg(th), 6) AS mean_true_entropy, round(avg(ph), 6) AS mean_predicted_entropy
FROM (SELECT workload, arg_min(state, (-t, state)) AS y, arg_min(state, (-p, state)) AS x, -sum(t * ln(greatest(t, 1e-12))) AS th, -sum(p * ln(least(greatest(p, 1e-12), 1))) AS ph FROM vv GROUP BY 1)""", _V)
def membership_entropies(spark, d):
    return metrics.membership_entropies(_vectors(spark, d), ["workload"])


@query("SELECT state, round(avg(abs(p - t)), 6) AS mae, round(sqrt(avg((p - t) * (p - t))), 6) AS rmse, round(avg(p - t), 6) AS bias, round(avg(t), 6) AS true_mean, round(avg(p), 6) AS predicted_mean FROM vv GROUP BY 1", _V)
def membership_by_state(spark, d):
    return metrics.membership_by_state(_vectors(spark, d))


@query("""SELECT round(avg(mae), 6) AS mae, round(sqrt(avg(mse)), 6) AS rmse, round(avg(brier), 6) AS brier, round(avg(l1), 6) AS l1, round(avg(l2), 6) AS l2, round(avg(l1 / 2), 6) AS tv, round(avg(kl), 6) AS kl, round(avg(js), 6) AS js, round(avg(hell), 6) AS hellinger, round(avg(cos), 6) AS cosine, round(avg(ce), 6) AS soft_ce, round(avg(th), 6) AS true_entropy, round(avg(ph), 6) AS predicted_entropy
FROM (SELECT workload, avg(abs(t - p)) AS mae, avg((t - p) * (t - p)) AS mse, sum((t - p) * (t - p)) AS brier, sum(abs(t - p)) AS l1, sqrt(sum((t - p) * (t - p))) AS l2, sum(t * ln((t + 1e-12) / (p + 1e-12))) AS kl, sum(t * ln((t + 1e-12) / ((t + p) / 2 + 1e-12))) / 2 + sum(p * ln((p + 1e-12) / ((t + p) / 2 + 1e-12))) / 2 AS js, sqrt(sum((sqrt(t) - sqrt(p)) * (sqrt(t) - sqrt(p))) / 2) AS hell, sum(t * p) / (sqrt(sum(t * t)) * sqrt(sum(p * p))) AS cos, -sum(t * ln(greatest(p, 1e-12))) AS ce, -sum(t * ln(greatest(t, 1e-12))) AS th, -sum(p * ln(greatest(p, 1e-12))) AS ph
FROM (SELECT workload, state, (t + 0.1) / sum(t + 0.1) OVER w AS t, 3 * p / sum(3 * p) OVER w AS p FROM vv WINDOW w AS (PARTITION BY workload)) GROUP BY 1)""", _V)
def membership_normalised(spark, d):
    v = _vectors(spark, d)
    return metrics.membership_normalised(v.withColumns({"truth": F.col("truth") + 0.1, "pred": F.col("pred") * 3}), ["workload"])


@query("SELECT label FROM (SELECT quality AS label FROM labels UNION SELECT toxic FROM labels) WHERE label IS NOT NULL")
def label_domain(spark, d):
    return metrics.label_domain(u.read(spark, d, "labels"), "quality", "toxic")


_CELLS = "cf AS (SELECT quality AS truth, toxic AS pred, count(*)::DOUBLE AS n FROM labels GROUP BY 1, 2), pc AS (SELECT label, coalesce(sum(n) FILTER (truth = label AND pred = label), 0) AS tp, coalesce(sum(n) FILTER (truth = label), 0) AS support, coalesce(sum(n) FILTER (pred = label), 0) AS predicted FROM cf, (VALUES (0), (1), (2)) v(label) GROUP BY 1)"


@query("SELECT label, tp, support, predicted, round(coalesce(tp / nullif(predicted, 0), 0), 6) AS precision, round(coalesce(tp / nullif(support, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(support + predicted, 0), 0), 6) AS f1 FROM pc", _CELLS)
def per_named_label(spark, d):
    """Labels named beforehand, one of which never occurs."""
    l = u.read(spark, d, "labels").select(F.col("quality").cast("int").alias("quality"), F.col("toxic").cast("int").alias("toxic"))
    return metrics.per_label(metrics.confusion(l, "quality", "toxic"), metrics.label_domain(l, "quality", "toxic", [0, 1, 2]))


@query("SELECT round(avg(f1), 6) AS f1_macro, round(avg(rec), 6) AS recall_macro FROM (SELECT tp / support AS rec, 2 * tp / (support + predicted) AS f1 FROM pc WHERE support > 0)", _CELLS)
def class_metrics_supported(spark, d):
    """Macro scores over labels with support alone."""
    return metrics.classification(_labels(spark, d), supported_only=True).select("f1_macro", "recall_macro")


@query("SELECT truth, pred, sum(conf) AS n FROM (SELECT truth, pred, round(conf, 3) AS conf FROM hs) GROUP BY 1, 2", MU + ", hs AS (SELECT workload, truth, min(state) FILTER (mu = top) AS pred, max(mu) AS conf FROM (SELECT *, max(mu) OVER (PARTITION BY workload) AS top FROM mu) GROUP BY 1, 2)")
def confusion_weighted(spark, d):
    return metrics.confusion(_hard(spark, d).withColumn("conf", F.round("conf", 3)), "truth", "pred", "conf")


@query("SELECT count(*) AS n_samples, round(avg(nll), 6) AS nll, round(avg(b), 6) AS brier_one_hot, round(avg(c), 6) AS mean_confidence, round(avg(e), 6) AS mean_entropy FROM (SELECT workload, -sum(t * ln(least(greatest(p, 1e-12), 1))) AS nll, sum((p - t) * (p - t)) AS b, max(p) AS c, -sum(p * ln(least(greatest(p, 1e-12), 1))) AS e FROM vv GROUP BY 1)", _V)
def probability_scores(spark, d):
    return metrics.probability_scores(u.memberships(spark, d).select("workload", "state", F.col("truth").alias("label"), F.col("mu").alias("p")), ["workload"])


@query("""SELECT round(avg(f) + 0.25 * avg(d) + 0.3 * avg(o), 6) AS loss, round(avg(f), 6) AS final_loss, round(avg(d), 6) AS dynamic_loss, round(avg(o), 6) AS order_loss FROM (SELECT workload,
-sum(t / s * ln(greatest(p, 1e-8))) AS f, -sum(t / s * ln(greatest(y, 1e-8))) AS d, -sum(t * (0.3 * ln(greatest(0.6 * y + 0.4 * r, 1e-8)) + 0.7 * ln(greatest(0.6 * y + 0.4 / k, 1e-8)))) AS o
FROM (SELECT workload, t, p, (p + 1.0::DOUBLE / k) / 2 AS y, sum(t) OVER w AS s, k, coalesce(lead(p, 1) OVER v, first_value(p) OVER v) AS r
FROM (SELECT workload, state, CASE WHEN state = truth THEN 0.8 ELSE 0.1 END AS t, mu AS p, count(*) OVER (PARTITION BY workload) AS k, row_number() OVER (PARTITION BY workload ORDER BY state) AS rank FROM mu) WINDOW w AS (PARTITION BY workload), v AS (PARTITION BY workload ORDER BY rank)) GROUP BY workload)""", MU)
def order_loss(spark, d):
    """Memberships as final answers, half-way to uniform as the dynamic part, two orders: the next state's membership, and uniform."""
    rows = u.memberships(spark, d).groupBy("workload").agg(F.array_sort(F.collect_list(F.struct("state", "truth", "mu"))).alias("x"))
    mu, k = F.transform("x", lambda r: r["mu"]), F.size("x")
    target = F.transform("x", lambda r: F.when(r["state"] == r["truth"], 0.8).otherwise(0.1))
    turned = F.concat(F.slice(mu, 2, F.size("x") - 1), F.slice(mu, 1, 1))
    orders = F.array(turned, F.transform(mu, lambda p: 1.0 / F.size("x")))
    rows = rows.select(target.alias("target"), mu.alias("final"), F.transform(mu, lambda p: (p + 1.0 / k) / 2).alias("dynamic"), orders.alias("orders"), F.array(F.lit(0.3), F.lit(0.7)).alias("weights"))
    return metrics.order_loss(rows, 0.25, 0.3, 0.4)


@query("""SELECT a.h, n_samples, round(acc, 6) AS accuracy, round(mae, 6) AS mae, round(rmse, 6) AS rmse, round(brier, 6) AS brier, round(l1, 6) AS l1, round(l2, 6) AS l2, round(tv, 6) AS tv, round(hel, 6) AS hellinger, round(cos, 6) AS cosine, round(kl, 6) AS kl, round(js, 6) AS js, round(ce, 6) AS soft_ce, round(mc, 6) AS mean_confidence, round(ece, 6) AS ece, round(mce, 6) AS mce, round(f1, 6) AS f1_macro, round(ba, 6) AS balanced_accuracy, round((hit * n - sq) / sqrt((n * n - qq) * (n * n - ss)), 6) AS mcc, round((hit / n - sq / (n * n)) / (1 - sq / (n * n)), 6) AS kappa, round(r_mae, 6) AS resource_mae, round(r_rmse, 6) AS resource_rmse, round(r_bias, 6) AS resource_bias
FROM (SELECT h, count(*) AS n_samples, avg((x = y)::INT) AS acc, avg(mae) AS mae, sqrt(avg(mse)) AS rmse, avg(brier) AS brier, avg(l1) AS l1, avg(l2) AS l2, avg(l1) / 2 AS tv, avg(hel) AS hel, avg(cos) AS cos, avg(kl) AS kl, avg(js) AS js, avg(ce) AS ce, avg(conf) AS mc FROM o GROUP BY 1) a
JOIN (SELECT h, sum(n * gap) / sum(n) AS ece, max(gap) AS mce FROM (SELECT h, greatest(ceil(conf * 15) - 1, 0) AS b, count(*) AS n, abs(avg(conf) - avg((x = y)::INT)) AS gap FROM o GROUP BY 1, 2) GROUP BY 1) b ON a.h = b.h
JOIN (SELECT h, avg(2 * tp / (s + q)) AS f1, avg(tp / s) FILTER (s > 0) AS ba, sum(tp) AS hit, sum(s)::DOUBLE AS n, sum(s * q)::DOUBLE AS sq, sum(s * s)::DOUBLE AS ss, sum(q * q)::DOUBLE AS qq FROM (SELECT o.h, l.label, count(*) FILTER (x = l.label AND y = l.label)::DOUBLE AS tp, count(*) FILTER (y = l.label) AS s, count(*) FILTER (x = l.label) AS q FROM o JOIN (SELECT h, y AS label FROM o UNION SELECT h, x FROM o) l ON l.h = o.h GROUP BY 1, 2) GROUP BY 1) c ON c.h = a.h
JOIN (SELECT h, avg(abs(e)) AS r_mae, sqrt(avg(e * e)) AS r_rmse, avg(e) AS r_bias FROM (SELECT h, workload, sum((p - t) * (state * state + 1)) AS e FROM vv GROUP BY 1, 2) GROUP BY 1) d ON d.h = a.h""", _V + """, o AS (SELECT h, workload, arg_min(state, (-t, state)) AS y, arg_min(state, (-p, state)) AS x, max(p) AS conf, avg(abs(p - t)) AS mae, avg((p - t) * (p - t)) AS mse, sum((p - t) * (p - t)) AS brier, sum(abs(p - t)) AS l1, sqrt(sum((p - t) * (p - t))) AS l2, sqrt(sum(pow(sqrt(tc) - sqrt(pc), 2)) / 2) AS hel, sum(t * p) / (sqrt(sum(t * t)) * sqrt(sum(p * p))) AS cos, sum(tc * ln(tc / pc)) AS kl, sum(tc * ln(2 * tc / (tc + pc))) / 2 + sum(pc * ln(2 * pc / (tc + pc))) / 2 AS js, -sum(t * ln(pc)) AS ce FROM (SELECT *, greatest(t, 1e-12) AS tc, least(greatest(p, 1e-12), 1) AS pc FROM vv) GROUP BY 1, 2)""")
def evaluation_by_h(spark, d):
    """All families at once, a row a horizon; a state stands for a resource value of its square and 1."""
    v = _vectors(spark, d)
    values = metrics.decoded(v, ["h", "workload"], F.col("state") * F.col("state") + 1)
    return metrics.evaluate_by(v, ["workload"], "h", resources_of=values).drop(*(f"resource_{c}" for c in ("median_ae", "max_ae", "mape", "smape", "wape", "pearson", "r2")))


_RATIO = "r AS (SELECT user_id AS workload, CAST(floor(epoch(ts) / 86400) AS BIGINT) AS origin, (value IS NOT NULL)::INT::BIGINT AS valid, coalesce(value, 0) AS err, coalesce((value > 60)::INT, 0)::DOUBLE AS hit FROM events)"


@query("SELECT 'origin' AS axis, origin::VARCHAR AS key, sum(valid)::BIGINT AS n, round(sum(err) / nullif(sum(valid), 0), 6) AS err, round(sum(hit) / nullif(sum(valid), 0), 6) AS hit FROM r GROUP BY origin UNION ALL SELECT 'workload', workload::VARCHAR, sum(valid)::BIGINT, round(sum(err) / nullif(sum(valid), 0), 6), round(sum(hit) / nullif(sum(valid), 0), 6) FROM r GROUP BY workload", _RATIO)
def ratios_by_axis(spark, d):
    """Sums over valid targets by origin and by workload, in one pass."""
    e = u.read(spark, d, "events").select(F.col("user_id").alias("workload"), F.floor(u.seconds("ts") / u.DAY).cast("long").alias("origin"), F.col("value").isNotNull().cast("long").alias("valid"), F.coalesce("value", F.lit(0.0)).alias("err"), F.coalesce((F.col("value") > 60).cast("double"), F.lit(0.0)).alias("hit"))
    return metrics.grouped_ratios(e, ["err", "hit"], "valid", ["origin", "workload"])


_TARGETS = """tg AS (SELECT workload, t AS origin, h, CAST(b AS VARCHAR) AS cls, err, (a = b)::INT::DOUBLE AS hit FROM (SELECT workload, t, h, least(floor(cpu_input * 2), 3)::INT AS a, least(floor(x * 2), 3)::INT AS b, abs(cpu_input - x) / (1 + x) AS err FROM (SELECT *, unnest([1, 2, 3, 4, 5]) AS h, unnest([lead(cpu, 1) OVER w, lead(cpu, 2) OVER w, lead(cpu, 3) OVER w, lead(cpu, 4) OVER w, lead(cpu, 5) OVER w]) AS x FROM f WINDOW w AS (PARTITION BY workload ORDER BY t)) WHERE input_valid AND x IS NOT NULL)),
un AS MATERIALIZED (SELECT 'h' AS axis, h::VARCHAR AS key, origin AS unit, count(*) AS n, sum(err) AS err, sum(hit) AS hit FROM tg GROUP BY h, origin UNION ALL SELECT 'cls', cls, origin, count(*), sum(err), sum(hit) FROM tg GROUP BY cls, origin
  UNION ALL SELECT 'workload', workload::VARCHAR, origin, count(*), sum(err), sum(hit) FROM tg GROUP BY workload, origin UNION ALL SELECT 'all', 'all', origin, count(*), sum(err), sum(hit) FROM tg GROUP BY origin UNION ALL SELECT 'origin', origin::VARCHAR, origin, count(*), sum(err), sum(hit) FROM tg GROUP BY origin),
pt AS (SELECT axis, key, count(*) AS units, sum(n)::BIGINT AS n, sum(err) / sum(n) AS err, sum(hit) / sum(n) AS hit FROM un GROUP BY 1, 2),
dr AS (SELECT axis, key, draw, sum(err * w) / nullif(sum(n * w), 0) AS err, sum(hit * w) / nullif(sum(n * w), 0) AS hit FROM un JOIN wt ON un.unit::VARCHAR = wt.unit GROUP BY 1, 2, 3),
ci AS (SELECT axis, key, quantile_cont(err, 0.025) AS el, quantile_cont(err, 0.975) AS eh, quantile_cont(hit, 0.025) AS hl, quantile_cont(hit, 0.975) AS hh FROM dr GROUP BY 1, 2)"""


@query("""SELECT pt.axis, pt.key, units, n, round(err, 6) AS err, round(coalesce(el, err), 6) AS err_low, round(coalesce(eh, err), 6) AS err_high, round(hit, 6) AS hit, round(coalesce(hl, hit), 6) AS hit_low, round(coalesce(hh, hit), 6) AS hit_high,
CASE WHEN pt.axis = 'h' THEN round(err - first_value(err) OVER o, 6) END AS err_degradation, CASE WHEN pt.axis = 'h' THEN round(hit - first_value(hit) OVER o, 6) END AS hit_degradation
FROM pt LEFT JOIN ci ON pt.axis = ci.axis AND pt.key = ci.key AND units > 1 WINDOW o AS (PARTITION BY pt.axis ORDER BY TRY_CAST(pt.key AS DOUBLE), pt.key)""", ", ".join((FILL, _TARGETS.replace("pt AS (", WEIGHTS + ",\npt AS (", 1))))
def metric_bundle(spark, d):
    """A forecast that repeats the last value, 1 to 5 slots ahead: relative errors and hits by horizon, class, workload, origin and over all, with intervals over origins."""
    f = u.filled(spark, d)
    w = Window.partitionBy("workload").orderBy("t")
    ahead = F.array(*[F.struct(F.lit(h).alias("h"), F.lead("cpu", h).over(w).alias("x")) for h in range(1, 6)])
    rows = f.withColumn("ahead", ahead).select("workload", F.col("t").alias("origin"), "input_valid", "cpu_input", F.explode("ahead").alias("a")).where(F.col("input_valid") & F.col("a.x").isNotNull())
    of = lambda c: F.least(F.floor(F.col(c) * 2), F.lit(3)).cast("int")
    rows = rows.select("workload", "origin", "a.h", of("a.x").alias("cls"), (F.abs(F.col("cpu_input") - F.col("a.x")) / (1 + F.col("a.x"))).alias("err"), (of("cpu_input") == of("a.x")).cast("double").alias("hit"), F.lit(1).cast("long").alias("valid"))
    return rounded_as_sql(metrics.bundle(rows, "origin", ["h", "cls", "workload"], "valid", ["err", "hit"], "h", 200))


@query("SELECT k, h // 5 AS h5, count(v) FILTER (NOT isnan(v)) AS n, round(avg(v) FILTER (NOT isnan(v)), 6) AS mean FROM (SELECT k, h, CASE WHEN h % 4 = 0 THEN 'nan'::DOUBLE ELSE v / 7 END AS v FROM hm) GROUP BY 1, 2", "hm AS (SELECT event_type AS k, CAST(floor(epoch(ts) / 86400) AS BIGINT) - (SELECT min(CAST(floor(epoch(ts) / 86400) AS BIGINT)) FROM events) AS h, avg(value) AS v FROM events GROUP BY 1, 2)")
def means_without_nan(spark, d):
    m = _by_h(spark, d).withColumn("v", F.when(F.col("h") % 4 == 0, F.lit(float("nan"))).otherwise(F.col("v") / 7))
    return metrics.summary(m.withColumn("h5", F.floor(F.col("h") / 5)), ["k", "h5"], "v").select("k", "h5", "n", "mean")


@query("SELECT event_type || '.' || n AS name, round(CASE n WHEN 'value.mean' THEN m ELSE c END, 6) AS value FROM (SELECT event_type, avg(value) AS m, count(*)::DOUBLE AS c FROM events GROUP BY 1), (VALUES ('value.mean'), ('n')) v(n)")
def flat_names(spark, d):
    """Nested results by event type, their lists left out, as dotted names."""
    rows = u.read(spark, d, "events").groupBy("event_type").agg(F.avg("value").alias("m"), F.count(F.lit(1)).alias("n")).collect()
    flat = metrics.flatten({r["event_type"]: {"value": {"mean": r["m"], "list": [1, 2]}, "n": float(r["n"])} for r in rows})
    return spark.createDataFrame(list(flat.items()), "name string, value double")


# ---- streams, run to the end of what is there


def _streamed(spark, rows: DataFrame, work) -> DataFrame:
    """rows as files, streamed through work into a table of the shared folder."""
    inp, out, mark = (_folder(spark, x) for x in ("stream", "streamed", "mark"))
    rows.write.parquet(inp)
    done = work(spark.readStream.schema(rows.schema).parquet(inp))
    done.writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).trigger(availableNow=True).outputMode("append").start().awaitTermination()
    return spark.read.schema(done.schema).parquet(out)


def _stream_rows(spark, d):
    """Events, and one far later so that every window before it is over."""
    e = u.read(spark, d, "events").select(F.col("user_id").alias("workload"), F.timestamp_seconds(u.seconds("ts")).alias("ts"), "value")
    return e.unionByName(e.agg(F.lit(-1).cast(dict(e.dtypes)["workload"]).alias("workload"), (F.max("ts") + F.expr("INTERVAL 100 DAYS")).alias("ts"), F.lit(0.0).alias("value")))


@query("SELECT user_id AS workload, CAST(floor(epoch(ts) / 86400) AS BIGINT) AS day, count(*) AS n, round(avg(value), 6) AS value FROM events GROUP BY 1, 2")
def streamed_means(spark, d):
    out = _streamed(spark, _stream_rows(spark, d), lambda s: streams.tumbling_means(s, ["value"], "1 day", "60 days"))
    return out.where("workload >= 0").select("workload", F.floor(F.unix_timestamp("start") / u.DAY).cast("long").alias("day"), "n", "value")


@query("SELECT user_id AS workload, w AS day2, count(*) AS n, round(avg(value), 6) AS value FROM (SELECT *, unnest([CAST(floor(epoch(ts) / 86400) AS BIGINT), CAST(floor(epoch(ts) / 86400) AS BIGINT) - 1]) AS w FROM events) GROUP BY 1, 2")
def streamed_hopping_means(spark, d):
    """Windows of two days, one every day."""
    out = _streamed(spark, _stream_rows(spark, d), lambda s: streams.tumbling_means(s, ["value"], "2 days", "60 days", "1 day"))
    return out.where("workload >= 0").select("workload", F.floor(F.unix_timestamp("start") / u.DAY).cast("long").alias("day2"), "n", "value")


@query("""SELECT workload, min(sec) AS first, max(sec) + 43200 AS last, count(*) AS n FROM (SELECT workload, sec, sum(new) OVER (PARTITION BY workload ORDER BY sec, event_id) AS run FROM (SELECT *, CASE WHEN sec - lag(sec) OVER (PARTITION BY workload ORDER BY sec, event_id) < 43200 THEN 0 ELSE 1 END AS new FROM s)) GROUP BY workload, run""", S)
def streamed_sessions(spark, d):
    out = _streamed(spark, _stream_rows(spark, d), lambda s: streams.sessions(s, "12 hours", "60 days"))
    return out.where("workload >= 0").select("workload", F.unix_timestamp("start").alias("first"), F.unix_timestamp("end").alias("last"), "n")


@query("SELECT a.event_id, round(coalesce(sum(exp(-0.02 * (a.t - b.t))), 0), 6) AS weight FROM s a LEFT JOIN s b ON a.workload = b.workload AND a.state = b.state AND b.t < a.t AND b.t >= a.t - 10 GROUP BY 1", S)
def streamed_decay(spark, d):
    """decayed_range as a stream of two batches, each of them with events that lie before some of the other: a third's, then the rest."""
    e = u.states(spark, d).select("event_id", F.concat_ws("|", "workload", "state").alias("key"), "t")
    inp, out, mark = (_folder(spark, x) for x in ("stream", "streamed", "mark"))
    third = F.pmod("event_id", F.lit(3)) == 0
    for part in (e.where(third), e.where(~third)):
        part.select("key", "t").coalesce(1).write.mode("append").parquet(inp)
    name, want = streams.STATE_STORE
    was = spark.conf.get(name)
    spark.conf.set(name, want)
    try:
        told = streams.rolling_decay(spark.readStream.schema("key string, t long").option("maxFilesPerTrigger", 1).parquet(inp), 0.02, 10, 10_000, u.DAY)
        told.writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).trigger(availableNow=True).outputMode("append").start().awaitTermination()
    finally:
        spark.conf.set(name, was)
    last = spark.read.schema(told.schema).parquet(out).groupBy("key", "t").agg(F.max_by("weight", "version").alias("weight"))
    return e.join(last, ["key", "t"]).select("event_id", "weight")

"""Closed forms, equivalence of two ways, and invariants of the engine's operators."""

import json
import math
import random
import uuid
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomcast.functions import arrays
from loomcast.operators import forecast, graph, ingest, markov, metrics, sampling, sequences, shapes
from loomcast.operators.components import components
from loomcast.sources import tables, usage
from loomcast.streaming import usage as streams


def _put(df, folder):
    path = f"file://{folder}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def test_dtw():
    x = np.array([[0.0, 1.0], [1.0, 0.0], [2.0, 2.0]])
    assert shapes.dtw(x, x) == 0.0
    assert shapes.dtw(np.array([0.0, 0.0]), np.array([1.0, 1.0])) == 1.0
    assert shapes.dtw(np.array([0.0, 1.0, 2.0]), np.array([0.0, 1.0, 1.0, 2.0])) == 0.0
    assert shapes.dtw(np.array([0.0]), np.array([2.0]), weights=[3.0]) == 6.0


def test_segments_cover_and_respect_lengths():
    x = np.array([0.0] * 6 + [5.0] * 5)[:, None]
    assert shapes.segment(x, 3, 8, 0.1) == [(0, 6), (6, 11)]
    assert shapes.segment(x[:2], 3, 8, 0.1) == [(0, 2)]
    assert shapes.segment(x, 12, 20, 0.1) == [(0, 11)]


def test_k_medoids_and_shape_set():
    p = np.array([0.0, 0.1, 0.2, 5.0, 5.1, 9.0])
    d = np.abs(p[:, None] - p[None, :])
    medoids, own = shapes.k_medoids(d, 3)
    assert len({*own[:3]}) == 1 and own[3] == own[4] and len({own[0], own[3], own[5]}) == 3
    assert list(shapes.k_medoids(d, 9)[0]) == list(range(6))
    s = shapes.shape_set(d, 0.9, 6)
    assert s["coverage"] >= 0.9 and all(x >= 1e-3 for x in s["sigma"])


def test_einstein_is_neutral_and_bounded(spark):
    df = spark.range(11).select((F.col("id") / 10).alias("m"))
    rows = df.select("m", arrays.einstein(F.col("m"), F.lit(0.0), 0.6).alias("a"), arrays.einstein(F.col("m"), F.lit(1.0), 0.9).alias("b"), arrays.einstein(F.col("m"), F.lit(-1.0), 0.9).alias("c")).collect()
    assert all(math.isclose(r.m, r.a, abs_tol=1e-12) and 0 <= r.b <= 1 and 0 <= r.c <= 1 for r in rows)


def test_simplex(spark):
    r = spark.range(1).select(arrays.simplex(F.array(F.lit(-1.0), F.lit(1.0), F.lit(3.0))).alias("a"), arrays.simplex(F.array(F.lit(0.0), F.lit(0.0))).alias("b"), arrays.argmax(F.array(F.lit(1.0), F.lit(2.0), F.lit(2.0))).alias("c"), arrays.is_simplex(F.array(F.lit(0.4), F.lit(0.6))).alias("d"), arrays.is_simplex(F.array(F.lit(0.0), F.lit(0.0))).alias("e")).first()
    assert r.a == [0.0, 0.25, 0.75] and r.b == [0.5, 0.5] and r.c == 1 and r.d and not r.e


SPEC = usage.SourceSpec("", "container_id", "time_stamp", (usage.ResourceRule("cpu", "cpu", 0.01, 0), usage.ResourceRule("disk_i", "disk", 0.005, 0, 100), usage.ResourceRule("disk_o", "disk", 0.005, 0, 100)), node="machine_id", fmt="csv", header=False, columns=("container_id", "machine_id", "time_stamp", "cpu", "disk"))


def test_ingest_from_headerless_csv(spark, tmp_path):
    (tmp_path / "u.csv").write_text("c1,m1,0,10,30\nc1,m1,10,20,40\nc1,m2,20,20,101\n\nc2,m2,0,oops,1\nc2,m2,10,5,5\nc2\n")
    spec = usage.SourceSpec(**{**SPEC.__dict__, "path": str(tmp_path / "u.csv")})
    assert usage.preflight(spark, spec)["ok"] and usage.resolve(spark, [usage.SourceSpec(**{**spec.__dict__, "path": "/nowhere"}), spec]) == spec
    obs = usage.observations(usage.read_source(spark, spec), spec, step=10)
    rows = {(r.workload, r.t): (r.cpu, r.disk_i) for r in obs.collect()}
    assert {k: (round(a, 6), round(b, 6)) for k, (a, b) in rows.items()} == {("c1", 0): (0.1, 0.15), ("c1", 1): (0.2, 0.2), ("c2", 1): (0.05, 0.025)}
    assert [tuple(r) for r in ingest.full_span(obs, 0, 3, 2).collect()] == [("c1", 2)]
    assert not usage.preflight(spark, usage.SourceSpec(**{**spec.__dict__, "node": "absent"}))["ok"]


def test_causal_fill_is_bounded(spark):
    m = spark.createDataFrame([(1, 0, 1, 5.0), (1, 6, 1, 7.0)], "workload int, t long, n int, cpu double")
    f = ingest.causal_fill(ingest.dense_grid(m, 0, 8), ["cpu"], 3).orderBy("t").collect()
    assert [r.cpu_input for r in f] == [5.0, 5.0, 5.0, 5.0, None, None, 7.0, 7.0]
    assert [r.imputed for r in f] == [False, True, True, True, False, False, False, True]


def test_splits_and_origins(spark):
    n = spark.range(11520).groupBy(ingest.split_of(F.col("id"), 11520).alias("s")).count().collect()
    assert {r.s: r["count"] for r in n} == {"train": 6912, "validation": 2304, "test": 2304}
    assert [r.origin for r in ingest.origins(spark, 100, 200, 5, 60, 10).orderBy("origin").collect()] == [100, 110, 120, 130]


def test_link_as_of(spark, tmp_path):
    left, snaps = spark.createDataFrame([(5,), (9,), (1,)], "o long"), spark.createDataFrame([(2, "a", 1.0), (6, "a", 2.0), (6, "a", 4.0)], "tb long, k string, v double")
    assert sorted((r.o, r.tb, r.v) for r in ingest.as_of(left, snaps, "o", "tb", ["v"], ["k"], lambda df: _put(df, tmp_path)).collect()) == [(5, 2, 1.0), (9, 6, 3.0)]


def test_direct_back_off_closed_form(spark):
    e = spark.createDataFrame([(1, t, s) for t, s in enumerate("01010")], "workload int, t long, state string")
    states = e.select("state").distinct()
    got = {(r.h, r.state): (r.p, r.support) for r in markov.direct_backoff(e, ["t"], 5, 5, 0.0, 1.0, states).collect()}
    for h, a, b, n in ((1, 0.25, 0.75, 2), (3, 1 / 3, 2 / 3, 1), (5, 0.5, 0.5, 0)):
        assert math.isclose(got[h, "0"][0], a) and math.isclose(got[h, "1"][0], b) and got[h, "0"][1] == n
    slow = {(r.h, r.state): r.support for r in markov.direct_backoff(e, ["t"], 2, 5, 0.02, 1.0, states).collect()}
    assert slow[1, "0"] > slow[2, "0"] or slow[2, "0"] < 2


@pytest.mark.parametrize("mode", ["flat", "hierarchical"])
def test_back_off_is_a_simplex(spark, mode):
    rng = random.Random(1)
    e = spark.createDataFrame([(w, t, str(rng.randrange(4))) for w in range(5) for t in range(20)], "workload int, t long, state string")
    out = markov.backoff(e, ["t"], e.select("state").distinct(), 20, 3, mode).groupBy("workload").agg(F.sum("p").alias("s"), F.min("p").alias("m")).collect()
    assert len(out) == 5 and all(math.isclose(r.s, 1) and r.m > 0 for r in out)


def test_decayed_range_equals_a_scan(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(3), rng.randrange(60)) for _ in range(200)]
    got = sequences.decayed_range(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, k int, t long"), ["k"], 0.02, 15).collect()
    for r in got:
        assert math.isclose(r.weight, sum(math.exp(-0.02 * (r.t - t)) for k, t in rows if k == r.k and 0 < r.t - t <= 15), abs_tol=1e-9)


def test_runs_and_contexts(spark):
    s = spark.createDataFrame([(1, t, t not in (2, 5), "abcdefg"[t]) for t in range(7)], "workload int, t long, input_valid boolean, state string")
    assert sorted((r.run_start, r.run_end) for r in sequences.active_runs(s).collect()) == [(0, 1), (3, 4), (6, 6)]
    assert [r.ctx for r in sequences.contexts(s.where("input_valid"), ["t"], 2).orderBy("t").collect()] == [["a", "b"], ["b", "d"], ["d", "e"]]


def test_graphs(spark):
    dep = spark.createDataFrame([("a", 0), ("b", 0), ("c", 0), ("c", 1), ("d", 1), ("e", 2)], "workload string, node int")
    hyper = {(r.src, r.dst): r.weight for r in graph.hypergraph(dep).collect()}
    assert hyper["a", "b"] == 0.5 and hyper["c", "d"] == 1.0 and ("a", "d") not in hyper
    assert {(r.src, r.dst) for r in graph.two_hop(graph.adjacency(dep)).collect()} == {("a", "d"), ("d", "a"), ("b", "d"), ("d", "b")}
    assert {r.workload: r.component for r in graph.component_sizes(graph.adjacency(dep), dep, lambda x: x).collect()} == {"a": "a", "b": "a", "c": "a", "d": "a", "e": "e"}
    c = graph.coverage(graph.adjacency(dep), dep).first()
    assert (c.workloads, c.edges, c.isolated) == (5, 4, 0.2)
    live = graph.masked(graph.adjacency(dep), dep.where("workload <> 'c'"))
    assert {(r.src, r.dst) for r in live.collect()} == {("a", "b"), ("b", "a")}


def test_components_of_a_chain(spark, tmp_path):
    def store(df):
        path = str(tmp_path / uuid.uuid4().hex)
        df.write.parquet(path)
        return spark.read.parquet(path)

    edges = spark.range(40).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r.label for r in components(edges, store).collect()} == {0}


def test_metrics(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (1, 1), (2, 1)], "y int, p int")
    c = metrics.classification(metrics.confusion(df, "y", "p")).first()
    assert c.accuracy == 0.6 and math.isclose(c.recall_macro, 0.5) and math.isclose(c.f1_macro, (2 / 3 + 2 / 3) / 3)
    same = spark.createDataFrame([(1, s, v, v) for s, v in enumerate((0.2, 0.8))], "i int, state int, truth double, pred double")
    m = metrics.membership(same, ["i"]).first()
    assert m.mae == 0 and abs(m.js) < 1e-9 and math.isclose(m.cosine, 1)
    edge = spark.createDataFrame([(1 / 15,), (1.0,), (0.0,)], "c double")
    assert [r[0] for r in edge.select(metrics.bin_of(F.col("c"), 15, True)).collect()] == [0, 14, 0]
    assert [r[0] for r in edge.select(metrics.bin_of(F.col("c"), 15, False)).collect()] == [1, 14, 0]
    r = {x.g: x for x in metrics.resources(spark.createDataFrame([("a", 1.0, 2.0), ("a", 3.0, 3.0), ("b", 0.0, 1.0)], "g string, y double, x double"), "y", "x", "g").collect()}
    assert r["a"].mae == 0.5 and r[None].n == 3 and math.isclose(r["a"].mape, 50) and r["b"].r2 is None
    one = metrics.bootstrap(spark.createDataFrame([("k", 1, 2.0, 4.0)], "k string, o int, n double, d double"), ["k"], "o", "n", "d").first()
    assert (one.value, one.low, one.high) == (0.5, 0.5, 0.5)


def test_rollout_and_variants(spark):
    rng = random.Random(4)
    h = spark.createDataFrame([(o, w, t, rng.randrange(3)) for o in range(2) for w in range(3) for t in range(15)], "origin long, workload long, t long, state int")
    for name in ("full", "vo_markov", "dyn_trans", "ns_mem", "hypergraph", "multi_hop"):
        out = forecast.recursive_rollout(h, 3, 4, forecast.Variant.named(name))
        assert out.count() == 2 * 3 * 4 * 3
        assert all(math.isclose(r.s, 1) for r in out.groupBy("origin", "workload", "h").agg(F.sum("p").alias("s")).collect())


def test_training_lowers_the_loss(spark):
    rows = spark.createDataFrame([([1.0, float(i % 2)], i % 2) for i in range(50)], "x array<double>, y int")
    _, losses = forecast.train_kernel(rows, 2, 2, epochs=4)
    assert losses == sorted(losses, reverse=True) and losses[-1] < losses[0]


def test_k_means_moves_to_the_means(spark):
    p = spark.createDataFrame([(i, [float(x)]) for i, x in enumerate((0, 1, 10, 11))], "id long, x array<double>")
    c = shapes.k_means(p, spark.createDataFrame([(0, [0.0]), (1, [1.0])], "state int, c array<double>"), 5)
    assert {r.state: r.c for r in c.collect()} == {0: [0.5], 1: [10.5]}


def test_window_membership_prefers_the_nearest(spark):
    s = spark.createDataFrame([(1, t, float(t > 4), t != 2) for t in range(10)], "workload int, t long, cpu double, input_valid boolean")
    out = {r.t: r.mu for r in shapes.window_memberships(s, ["cpu"], np.array([[[0.0]] * 4, [[1.0]] * 4]), 4).collect()}
    assert math.isclose(out[3][0], 1 / (1 + math.exp(-2))) and math.isclose(out[9][1], out[3][0]) and all(math.isclose(sum(v), 1) for v in out.values())


def test_sinks(spark, tmp_path):
    tables.write_json({"b": float("nan"), "a": [1.0, float("inf")]}, str(tmp_path / "x.json"))
    assert json.loads((tmp_path / "x.json").read_text()) == {"a": [1.0, None], "b": None}
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, None)], "k int, v array<double>")
    tables.write_bundle(df, str(tmp_path / "b"))
    assert spark.read.parquet(str(tmp_path / "b/parquet")).count() == 2
    assert tables.manifest(df, ["k"]).first() == tables.manifest(df.orderBy(F.desc("k")), ["k"]).first()
    dup = spark.createDataFrame([(1, 0, "x"), (1, 1, "y")], "k int, o int, v string")
    assert tables.last_wins(dup, ["k"], "o").first().v == "y" and tables.first_wins(dup, ["k"], "o").first().v == "x"


def test_streams_equal_batch(spark, tmp_path):
    rng = random.Random(5)
    rows = spark.createDataFrame([(rng.randrange(3), 60 * rng.randrange(40), rng.random()) for _ in range(300)], "workload int, s long, cpu double").select("workload", F.timestamp_seconds("s").alias("ts"), "cpu")
    rows.write.parquet(str(tmp_path / "in"))
    q = streams.tumbling_means(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), ["cpu"], "5 minutes").writeStream.format("memory").queryName("means").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    batch = {(r.workload, r.start): round(r.cpu, 9) for r in streams.tumbling_means(rows, ["cpu"], "5 minutes").collect()}
    assert {(r.workload, r.start): round(r.cpu, 9) for r in spark.table("means").collect()} == batch


def test_decayed_state_equals_a_scan(spark, tmp_path):
    rng = random.Random(6)
    schema, seen = "ctx string, t long, state int", defaultdict(list)
    for b in range(4):
        rows = [(rng.choice("xy"), 10 * b + rng.randrange(10), rng.randrange(3)) for _ in range(30)]
        for c, t, s in rows:
            seen[c].append((t, s))
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    q = streams.decayed_state(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), 3, 0.05, 15).writeStream.format("memory").queryName("decayed").outputMode("update").start()
    q.processAllAvailable()
    q.stop()
    for c, events in seen.items():
        last = max(t for t, _ in events)
        got = spark.table("decayed").where((F.col("ctx") == c) & (F.col("t") == last)).collect()[-1]
        want = [sum(math.exp(-0.05 * (last - t)) for t, s in events if s == k and t >= last - 15) for k in range(3)]
        assert np.allclose(got.counts, want)


def test_idle_contexts_leave_the_stream(spark, tmp_path):
    schema, held = "ctx string, t long, state int", []
    (tmp_path / "in").mkdir()
    source = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = streams.decayed_state(source, 2, 0.05, 15).writeStream.format("memory").queryName("idle").outputMode("update").start()
    for rows in ([("x", 1, 0), ("y", 2, 1)], [("x", 17, 0)], [("x", 100, 1)], [("y", 101, 0), ("y", 70, 1), ("x", 90, 0)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q.processAllAvailable()
        held.append(q.lastProgress["stateOperators"][0]["numRowsTotal"])
    q.stop()
    assert held == [2, 2, 1, 2]  # y goes once the stream is at 100, and begins anew at 101
    got = {(r.ctx, r.t): r.counts for r in spark.table("idle").collect()}
    assert np.allclose(got["y", 101], [1, 0])  # the event at 70 came too late
    assert np.allclose(got["x", 100], [math.exp(-0.5), 1])  # the one at 90 did not


def test_sampling():
    ids = [f"c{i}" for i in range(30)]
    a = sampling.seeded_choice(ids[::-1], 5, 7)
    assert a == sampling.seeded_choice(ids, 5, 7) == sorted(a) and len(set(a)) == 5 and sampling.seeded_choice(ids, 99, 7) == sorted(ids)
    assert sampling.thin(list(range(11)), 3) == [0, 5, 10] and sampling.thin([1, 2], 5) == [1, 2]
    assert 0 <= sampling.stable_seed(7, "a") < 2**31 and sampling.stable_seed(7, "a") != sampling.stable_seed(7, "b")


def test_prototypes_spread_out():
    p = np.array([[0.0], [0.1], [5.0], [9.0], [9.0]])
    assert {float(x[0, 0]) for x in shapes.slot_prototypes(p, 3, 4)} == {0.0, 5.0, 9.0}
    w = shapes.window_prototypes([np.zeros((3, 1)), np.ones((5, 1)), np.zeros((4, 1))], 2, 6)
    assert w.shape == (2, 6, 1) and {0.0, 1.0} == {float(x.mean()) for x in w}
    assert shapes.slot_prototypes(p[:1], 2, 3).shape == (2, 3, 1)


def test_batched_warping_equals_single():
    r = np.random.default_rng(3)
    a, b = ([r.normal(size=r.integers(1, 12)) for _ in range(40)] for _ in range(2))
    for window in (None, 2):
        assert np.allclose(shapes.dtw_batch(a, b, window), [shapes.dtw(x, y, window=window) for x, y in zip(a, b)])
    a, b = ([r.normal(size=(r.integers(1, 9), 3)) for _ in range(20)] for _ in range(2))
    assert np.allclose(shapes.dtw_batch(a, b, 3), [shapes.dtw(x, y, window=3) for x, y in zip(a, b)])


def test_warped_membership_follows_shape(spark):
    rows = spark.createDataFrame([(1, t, float(v), v >= 0) for t, v in enumerate([0, 0, -1, 0, 1, 2, 3])], "workload long, t long, cpu double, input_valid boolean")
    flat, rise = np.zeros((3, 1)), np.array([[1.0], [2.0], [3.0]])
    out = {r["t"]: r["mu"] for r in shapes.warped_memberships(rows, ["cpu"], [flat, rise], [0.5, 0.5]).collect()}
    assert sorted(out) == [0, 1, 3, 4, 5, 6] and out[3][0] > 0.9 and out[6][1] > 0.9 and all(sum(x) == pytest.approx(1) for x in out.values())


def test_decayed_range_of_a_long_history(spark):
    t = [0, 3, 9, 10, 11, 5_000_000, 5_000_004, 5_000_010]
    rows = spark.createDataFrame([("k", x) for x in t], "k string, t long")
    got = {x["t"]: x["weight"] for x in sequences.decayed_range(rows, ["k"], 0.5, 10).collect()}
    for x in t:
        assert got[x] == pytest.approx(sum(math.exp(-0.5 * (x - y)) for y in t if 0 < x - y <= 10))


def test_components_of_the_whole_deployment(spark):
    from loomcast.plans import queries, usage as roles

    folder = "/root/testdata/sf0.001"
    got = {r["workload"]: r["component"] for r in queries.QUERIES["component_labels"](spark, folder).collect()}
    least = {w: w for w in got}
    pairs = [(r["src"], r["dst"]) for r in graph.adjacency(roles.deployment(spark, folder)).collect()]
    moved = True
    while moved:
        moved = False
        for a, b in pairs:
            if least[b] < least[a]:
                least[a], moved = least[b], True
    assert got == least


def test_segments_prefer_short_last_pieces_and_allow_a_short_first():
    flat = np.ones((11, 1))
    assert shapes.segment(flat, 3, 8, 0.1) == [(0, 8), (8, 11)]
    assert shapes.segment(flat, 6, 6, 0.1) == [(0, 5), (5, 11)]
    assert shapes.segment(flat, 4, 5, 0.1) == [(0, 2), (2, 7), (7, 11)] or sum(b - a for a, b in shapes.segment(flat, 4, 5, 0.1)) == 11
    slope = np.arange(6.0).reshape(-1, 1)
    assert shapes.segment_costs(slope, 6, 0.2)[0] == pytest.approx(17.5 + 0.2)


def test_k_means_seeds_and_empty_clusters(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(c, 0.1, (30, 2)) for c in ((0, 0), (5, 0), (0, 5))])
    p = spark.createDataFrame([(i, [float(a), float(b)]) for i, (a, b) in enumerate(x)], "id long, x array<double>")
    seeds = shapes.seed_centroids(p, 3)
    assert seeds.count() == 3 and sorted(map(tuple, seeds.collect())) == sorted(map(tuple, shapes.seed_centroids(p, 3).collect()))
    c = {tuple(np.round(r["c"])) for r in shapes.k_means(p, seeds, 20).collect()}
    assert c == {(0, 0), (5, 0), (0, 5)}
    lost = spark.createDataFrame([(0, [0.0, 0.0]), (1, [100.0, 100.0]), (2, [101.0, 101.0])], "state long, c array<double>")
    found = shapes.k_means(p, lost, 20).collect()
    assert max(max(r["c"]) for r in found) < 10 and len({tuple(r["c"]) for r in found}) == 3
    assert [r["c"][0] for r in shapes.ordered_centroids(lost).orderBy("state").collect()] == [0.0, 100.0, 101.0]


def test_blended_keeps_states_of_one_side(spark):
    a = spark.createDataFrame([("w", "x", 1.0)], "workload string, state string, p double")
    b = spark.createDataFrame([("w", "y", 1.0)], "workload string, state string, p double")
    assert {r.state: r.p for r in markov.blended(a, b, 0.25).collect()} == {"x": 0.75, "y": 0.25}


def test_contexts_keep_null_states_and_separators(spark):
    s = spark.createDataFrame([("w", 1, "a>b"), ("w", 2, None), ("w", 3, "a"), ("w", 4, "b"), ("w", 5, "c")], "workload string, t long, state string")
    got = [r.ctx for r in sequences.contexts(s, ["t"], 2).orderBy("t").collect()]
    assert got == [["a>b", None], [None, "a"], ["a", "b"]]


def test_resources_take_finite_pairs_only(spark):
    rows = [("g", 1.0, 2.0), ("g", float("inf"), 1.0), ("g", 1.0, float("nan")), ("g", None, 1.0)]
    got = metrics.resources(spark.createDataFrame(rows, "k string, y double, x double"), "y", "x", "k").where("k = 'g'").first()
    assert got.n == 1 and got.mae == 1.0


def test_label_domain_names_each_label_once(spark):
    df = spark.createDataFrame([("a", "b"), (None, "a")], "y string, x string")
    assert {r.label for r in metrics.label_domain(df, "y", "x").collect()} == {"a", "b"}
    for wrong in ([], ["a", "a"], ["b"]):
        with pytest.raises(ValueError):
            metrics.label_domain(df, "y", "x", wrong)


def test_unique_join_deals_hot_keys_apart(spark):
    from loomcast.operators.joins import unique_join

    big = spark.createDataFrame([(1, i) for i in range(50)] + [(i, i) for i in range(2, 20)] + [(None, 7)] * 9, "k long, v long")
    small = spark.createDataFrame([(i, f"n{i}") for i in range(1, 40, 2)], "k long, name string")
    keep = lambda df: df.checkpoint() if spark.sparkContext._jsc.sc().getCheckpointDir().isDefined() else df.cache()
    for how in ("inner", "left", "left_semi", "left_anti"):
        want = sorted(map(str, big.join(small, "k", how).collect()))
        for bound, hot in ((-1, 10), (-1, 10**6), (10**9, 10)):
            assert sorted(map(str, unique_join(big, small, ["k"], how, keep, bound, hot).collect())) == want, (how, bound, hot)


def test_ten_digits(spark):
    values = [0.0, 1.0, -1.5, 1 / 3, 123456789.125, 1e10, 9999999999.5, 1.5e-5, 1e-4, 12345.678901234, -2e300, 2.5e-300, 1e22, None, float("nan")]
    from loomcast.sources.archives import ten_digits

    got = [r.s for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").select("i", ten_digits(F.col("v")).alias("s")).orderBy("i").collect()]
    assert got == [None if v is None or v != v else f"{v:.10g}" for v in values]


def test_within_two_against_sets(spark):
    rng = np.random.default_rng(2)
    near = {i: set() for i in range(700)}
    for a, b in rng.integers(0, 700, (900, 2)).tolist():
        if a != b:
            near[a].add(b)
            near[b].add(a)
    adj = spark.createDataFrame([(f"w{a}", f"w{b}") for a in near for b in near[a]], "src string, dst string")
    got = {r.src: (r.direct, r.reached) for r in graph.within_two(adj, lambda df: df.cache()).collect()}
    assert got == {f"w{a}": (len(n), len(n | {c for b in n for c in near[b]} - {a}) - (a in n)) for a, n in near.items() if n}


def test_direct_orders_against_counting(spark):
    import math
    from collections import defaultdict

    rng = np.random.default_rng(3)
    events = [(w, t, "abc"[rng.integers(3)]) for w in range(4) for t in range(12)]
    s = spark.createDataFrame(events, "workload long, t long, state string")
    got = {(r.workload, r.h, r.state): r.p for r in markov.direct_orders(s, ["t"], 3, 10, 2, 0.1, 1.0, s.select("state").distinct()).collect()}
    past = {w: [x for v, t, x in events if v == w and t < 10] for w in range(4)}
    for w in range(4):
        for h in (1, 2, 3):
            p, left = {x: 0.0 for x in "abc"}, 1.0
            for k in (2, 1, 0):
                c = defaultdict(float)
                for seq in past.values():
                    for pos, x in enumerate(seq):
                        if pos >= max(k, h - 1) and seq[pos - k : pos] == past[w][len(past[w]) - k :]:
                            c[x] += math.exp(-0.1 * (len(seq) - pos + h))
                n = sum(c.values())
                g = (1 / (1 + math.exp(-(n - 2))) if n else 0.0) if k else 1.0
                for x in "abc":
                    p[x] += left * g * ((c[x] + 1) / (n + 3) if n else 1 / 3)
                left *= 1 - g
            assert all(abs(got[w, h, x] - p[x]) < 1e-9 for x in "abc")


def test_ten_digits_where_a_decimal_ends_in_five(spark):
    """The bits decide, not the shortest decimal: 0.085304761905 lies below its decimal, 0.285714285715 above or below as C has it."""
    from loomcast.sources.archives import ten_digits

    values = [0.085304761905, 0.285714285715, 0.123456789050, 1.2345678905, 12345678905.0, 98765432115.0, -0.085304761905]
    got = [r.s for r in spark.createDataFrame(list(enumerate(values)), "i int, v double").select("i", ten_digits(F.col("v")).alias("s")).orderBy("i").collect()]
    assert got == ["%.10g" % v for v in values]


def test_within_two_over_many_cells(spark):
    """Ranges so small that every source's neighbours and what they reach lie in several; no set of what is reached is a row of the plan."""
    rng = np.random.default_rng(5)
    near = {i: set() for i in range(120)}
    for a, b in rng.integers(0, 120, (260, 2)).tolist():
        if a != b:
            near[a].add(b)
            near[b].add(a)
    adj = spark.createDataFrame([(a, b) for a in near for b in near[a]] * 2, "src long, dst long")
    sizes = []

    def keep(df):
        sizes.append(df.cache().count())
        return df

    got = {r.src: (r.direct, r.reached) for r in graph.within_two(adj, keep, 16, 10).collect()}
    assert got == {a: (len(n), len(n | {c for b in n for c in near[b]} - {a})) for a, n in near.items() if n}
    assert len(sizes) == 3  # names twice and the neighbour lists: edges are not stored beside them


def test_stars_have_the_components_of_all_pairs(spark):
    rng = random.Random(8)
    dep = spark.createDataFrame([(rng.randrange(60), rng.randrange(45)) for _ in range(70)] + [(900 + i, 99) for i in range(30)], "workload long, node long").distinct()
    of = lambda edges: sorted(map(tuple, graph.component_sizes(edges, dep, lambda df: df.cache()).collect()))
    assert of(graph.stars(dep)) == of(graph.adjacency(dep))
    assert graph.stars(dep).where("src >= 900").count() == 29


def test_pairs_between_kinds_against_plain_loops(spark):
    """Workloads of one node, of several, of the same several times, without any; kinds of more workloads than a pack holds."""
    rng = random.Random(4)
    dep = [(w, w % 3) for w in range(60)] + [(100 + w, n) for w in range(12) for n in rng.choices(range(5), k=3)] + [(200, None)]
    links = [(a, b, float(a + 2 * b - 3)) for a in range(5) for b in range(5) if a != b and rng.random() < 0.7]
    lists = lambda df: sorted(map(tuple, df.collect()))
    d, l = spark.createDataFrame(dep, "workload long, node long"), spark.createDataFrame(links, "src long, dst long, v double")
    live, mean = defaultdict(float), defaultdict(list)
    edges = [(a, b) for a, b, v in links if v != 0] + [(n, n) for n in range(5)]
    for (w, n), (x, m) in ((p, q) for p in dep for q in dep if p[0] != q[0]):
        live[w, x] += edges.count((n, m))
        mean[w, x] += [v for a, b, v in links if (a, b) == (n, m)]
    was, graph.TOGETHER = graph.TOGETHER, 7
    try:
        got, want = lists(graph.live_adjacency(d, l, ["v"], lambda df: df.cache())), sorted((*k, v) for k, v in live.items() if v)
        assert got == want
        got = {(a, b): v for a, b, v in lists(graph.project_links(d, l, ["v"], lambda df: df.cache()))}
        assert got.keys() == {k for k, v in mean.items() if v} and all(abs(got[k] - sum(mean[k]) / len(mean[k])) < 1e-9 for k in got)
    finally:
        graph.TOGETHER = was


def test_interval_ends_have_the_bits_of_sql(spark):
    """Ends of intervals are DuckDB's quantile_cont to the last bit."""
    duckdb = pytest.importorskip("duckdb")
    rng = np.random.default_rng(6)
    rows = [(k, i, float(rng.integers(9)), float(rng.integers(1, 9))) for k in range(40) for i in range(6)]
    df = spark.createDataFrame(rows, "k long, unit long, v double, n double")
    drawn = df.select("k", "v", "n", F.posexplode(metrics.draws_of(F.col("unit"), 40, 7)).alias("draw", "w")).where("w > 0")
    one = drawn.groupBy("k", "draw").agg((F.sum(F.col("w") * F.col("v")) / F.sum(F.col("w") * F.col("n"))).alias("x")).toPandas()
    ends = duckdb.sql("SELECT k, quantile_cont(x, 0.025), quantile_cont(x, 0.975) FROM one GROUP BY k").fetchall()
    want = {(k, end): v for k, *both in ends for end, v in zip(("v_low", "v_high"), both)}
    got = metrics.intervals(df, ["k"], "unit", "n", ["v"], 40, 7).collect()
    assert {(r.k, end): r[end] for r in got for end in ("v_low", "v_high")} == want


def test_rounding_of_sql(spark):
    """Numbers that end in a 5 after 6 digits round as DuckDB's round does, where Spark's goes the other way."""
    import duckdb
    from loomcast.plans.queries import rounded, rounded_as_sql

    values = [0.5126875, 0.6615624999999999, 0.5375624999999999, -0.5126875, 0.0078125, 1 / 3, 0.0, None]
    df = spark.createDataFrame(list(enumerate(values)), "i int, v double")
    got = [r.v for r in rounded(rounded_as_sql(df)).orderBy("i").collect()]
    assert got == [v if v is None else duckdb.execute("SELECT round(?::DOUBLE, 6)", [v]).fetchone()[0] for v in values]
    assert got != [r.v for r in rounded(df).orderBy("i").collect()]


def test_within_two_on_against_sets(spark):
    """Blocks so small that most pairs lie across two; rows repeat, some workloads are alone, and no pair of workloads shuffles as a row."""
    rng = np.random.default_rng(6)
    dep = [(f"w{a}", int(b)) for a, b in zip(rng.integers(0, 150, 260), rng.integers(0, 130, 260))] + [("alone", 999), (None, 3), ("w1", None)]
    near = {w: set() for w, _ in dep}
    for w, n in dep:
        near[w] |= {v for v, m in dep if m == n and m is not None and v is not None and v != w}
    del near[None]
    want = {w: (len(s), len((s | {c for b in s for c in near[b]}) - {w})) for w, s in near.items() if s}
    rows = []

    def keep(df):
        rows.append(df.cache().count())
        return df

    df = spark.createDataFrame(dep * 2, "workload string, node long")
    got = {r.src: (r.direct, r.reached) for r in graph.within_two_on(df, keep, keep, 20, 50, 64).collect()}
    assert got == want
    assert rows[1] <= 8 and sum(rows) < 150  # a row a block and a block's part of a pack

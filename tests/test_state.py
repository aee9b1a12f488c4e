"""State that grows: streams that go back in time, versioned counts, resumed roll-outs, draws, gated blocks, series and origins, against plain Python."""

import math
import os
import random
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomcast.operators import graph, ingest, learn, metrics, sequences, shapes
from loomcast.operators.context_store import ContextStore
from loomcast.streaming import usage as streams


@pytest.fixture
def store(spark, tmp_path):
    def put(df):
        path = f"file://{tmp_path}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    return put


def streamed(spark, folder, batches, decay, max_age, late, stop=None):
    """Latest weights after the batches; the query is started anew before batch `stop`, from its checkpoint."""
    name, want = streams.STATE_STORE
    was = spark.conf.get(name)
    spark.conf.set(name, want)
    try:
        for i, batch in enumerate(batches):
            spark.createDataFrame(batch, "key string, t long").coalesce(1).write.mode("append").parquet(f"{folder}/in")
            if stop is None or i >= stop or i == len(batches) - 1:
                told = streams.rolling_decay(spark.readStream.schema("key string, t long").parquet(f"{folder}/in"), decay, max_age, late)
                told.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/mark").trigger(availableNow=True).outputMode("append").start().awaitTermination()
    finally:
        spark.conf.set(name, was)
    rows = spark.read.parquet(f"{folder}/out").collect()
    best = {}
    for r in rows:
        if (r.key, r.t) not in best or best[r.key, r.t][0] < r.version:
            best[r.key, r.t] = (r.version, r.weight)
    return {k: w for k, (_, w) in best.items()}


def plain(events, decay, max_age):
    return {(k, t): sum(math.exp(-decay * (t - s)) for q, s in events if q == k and t - max_age <= s < t) for k, t in events}


def test_a_stream_that_goes_back_rebuilds_its_sums(spark, tmp_path):
    rng = random.Random(1)
    events = [(rng.choice("ab"), rng.randrange(60)) for _ in range(80)] + [("c", 5)]
    rng.shuffle(events)
    batches = [events[:30], events[30:31], events[31:], [(None, 3), ("a", None)]]
    got = streamed(spark, f"file://{tmp_path}", batches, 0.1, 12, 1000)
    want = plain(events, 0.1, 12)
    assert got.keys() == want.keys() and all(abs(got[k] - w) < 1e-9 for k, w in want.items())


def test_state_is_forgotten_and_late_events_are_dropped(spark, tmp_path):
    batches = [[("a", 10), ("b", 11)], [("b", 500)], [("b", 501), ("a", 12)], [("a", 502)]]
    got = streamed(spark, f"file://{tmp_path}", batches, 0.1, 12, 20)
    assert ("a", 12) not in got and got["a", 502] == 0.0 and abs(got["b", 501] - math.exp(-0.1)) < 1e-9


def test_context_store_by_version(spark, tmp_path):
    rng = random.Random(2)
    events = [(w, t, rng.choice("xyz") if rng.random() < 0.9 else None) for w in range(6) for t in sorted(rng.sample(range(40), 15))]
    table = lambda rows: spark.createDataFrame(rows, "workload long, t long, state string")

    def counted(lo, hi, now):
        out = {}
        for w in range(6):
            mine = [(t, s) for v, t, s in events if v == w and t < hi]
            for i, (t, s) in enumerate(mine):
                for k in range(min(i, 2) + 1):
                    if lo <= t < now:
                        key = (k, tuple(x for _, x in mine[i - k : i]), s)
                        out[key] = out.get(key, 0) + math.exp(-0.1 * (now - t))
        return out

    def held(s, now, **how):
        return {(r.order, tuple(r.ctx), r.state): r.c for r in s.counts(now, 0.1, **how).collect()}

    def same(a, b):
        assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-9 for k in a)

    s = ContextStore(spark, f"file://{tmp_path}/s", 2, ("t",))
    cuts = [0, 7, 8, 20, 33, 40]
    assert [s.append(table([e for e in events if a <= e[1] < b])) for a, b in zip(cuts, cuts[1:])] == [0, 1, 2, 3, 4]
    same(held(s, 40), counted(0, 40, 40))
    same(held(s, 40, version=2), counted(0, 20, 40))
    same(held(s, 25), counted(0, 40, 25))
    assert s.expire(15) == 5
    same(held(s, 40), counted(15, 40, 40))
    same(held(s, 40, version=4), counted(0, 40, 40))
    s.export(f"file://{tmp_path}/out", 3)
    other = ContextStore(spark, f"file://{tmp_path}/t", 2, ("t",))
    assert other.load(f"file://{tmp_path}/out") == 0
    same(held(other, 40), counted(0, 33, 40))
    assert other.append(table([e for e in events if e[1] >= 33])) == 1
    same(held(other, 40), counted(0, 40, 40))
    (tmp_path / "t" / "counts" / "version=2").mkdir()  # an append that was stopped before its commit
    same(held(other, 40), counted(0, 40, 40))
    assert other.append(table([])) == 2


def test_steps_that_were_made_are_not_made_again(spark, tmp_path, store, monkeypatch):
    blocks = learn.Blocks(2, period=7.0)
    rows = [(w, t, [0.8, 0.2] if (w + t) % 3 else [0.3, 0.7], 0 if (w + t) % 3 else 1) for w in range(6) for t in range(8)]
    mu = spark.createDataFrame(rows, "workload long, t long, mu array<double>, state int")
    home = spark.createDataFrame([(w, w % 2) for w in range(6)], "workload long, node long")
    origins = spark.createDataFrame([(5,), (7,)], "origin long")
    folder = f"file://{tmp_path}/steps"
    prior = np.array([[0.7, 0.3], [0.4, 0.6]])

    def go(h, at):
        return {(r.origin, r.workload, r.h, r.state): r.p for r in learn.roll_out_whole(mu, home, origins, 5, blocks.start(), blocks, prior, h, store, folder=at).collect()}

    want = go(4, None)
    go(2, folder)
    before = os.path.getmtime(tmp_path / "steps" / "step=2" / "_SUCCESS")
    (tmp_path / "steps" / "step=3").mkdir()  # a step that was stopped before its commit
    got = go(4, folder)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    assert os.path.getmtime(tmp_path / "steps" / "step=2" / "_SUCCESS") == before


def test_draws_are_poisson_and_merge(spark):
    units = spark.range(400).select(F.col("id").alias("u"))
    w = np.array([r.w for r in units.select(metrics.draws_of(F.col("u"), 50, 3).alias("w")).collect()])
    assert w.shape == (400, 50) and abs(w.mean() - 1) < 0.03 and abs(w.var() - 1) < 0.06 and (np.bincount(w.ravel())[:2] / w.size > 0.35).all()
    rng = random.Random(5)
    rows = [(k, u, rng.random(), 1.0) for k in "ab" for u in range(30) for _ in range(rng.randint(1, 3))] + [("one", 1, 0.5, 1.0), ("none", 2, None, 1.0), (None, 3, 0.25, 1.0)]
    df = spark.createDataFrame(rows, "k string, u long, num double, den double")
    got = {r.k: (r.value, r.low, r.high) for r in metrics.bootstrap(df.repartition(7), ["k"], "u", "num", "den", 100, 9).collect()}
    weights = {r.u: r.w for r in units.select("u", metrics.draws_of(F.col("u"), 100, 9).alias("w")).collect()}
    for k in "ab":
        draws = []
        for j in range(100):
            n = sum(weights[u][j] * d for q, u, _, d in rows if q == k)
            draws.append(sum(weights[u][j] * x for q, u, x, _ in rows if q == k) / n)
        own = [x for q, _, x, _ in rows if q == k]
        want = (sum(own) / len(own), *np.percentile(draws, [2.5, 97.5]))
        assert np.allclose(got[k], want)
    assert got["one"] == (0.5, 0.5, 0.5) and got[None] == (0.25, 0.25, 0.25) and "none" not in got


def test_bundle_of_all_axes(spark):
    rows = [(o, w, h, 1, float(o + w * h), 1.0) for o in range(4) for w in range(3) for h in (1, 2)]
    df = spark.createDataFrame(rows, "origin long, workload long, h int, valid long, err double, hit double")
    got = {(r.axis, r.key): r for r in metrics.bundle(df, "origin", ["h", "workload"], "valid", ["err", "hit"], "h", 60).collect()}
    assert len(got) == 2 + 3 + 1 + 4 and got["all", "all"].n == 24 and got["h", "1"].err_degradation == 0.0
    assert got["h", "2"].err_degradation == pytest.approx(1.0) and got["origin", "2"].err_low == got["origin", "2"].err == pytest.approx(2 + 1.5)
    assert got["all", "all"].err_low <= got["all", "all"].err <= got["all", "all"].err_high and got["workload", "1"].hit_low == got["workload", "1"].hit_high == 1.0
    assert metrics.bundle(df.limit(0), "origin", ["h"], "valid", ["err"]).count() == 0


def gated(nodes, edges, b, names):
    """One graph by matrices."""
    at = {n: i for i, n in enumerate(names)}
    mu, x = np.array([nodes[n][0] for n in names]), np.array([nodes[n][1] for n in names])
    a, gate = np.zeros((len(names),) * 2), np.zeros((len(names),) * 2)
    for i, j, w, f in edges:
        if w > 0:
            a[at[i], at[j]] = w
            gate[at[i], at[j]] = 1.0 if f is None else 1 / (1 + math.exp(-(np.dot(f, b.link) + b.link_bias)))
    g = a * gate
    total = g.sum(1, keepdims=True)
    share, has = g / np.maximum(total, 1e-12), (total > 1e-12).astype(float)
    degree = (a > 0).sum(1, keepdims=True) / max(len(names) - 1, 1)
    e = b.strength * np.tanh(np.hstack([share @ mu, degree]) @ np.array(b.theta)) * has
    c = 2 * mu - 1
    v = np.maximum(0.5 * (1 + (c + e) / np.maximum(1 + c * e, 1e-12)), 0)
    v = v / v.sum(1, keepdims=True)
    h = np.tanh(np.hstack([v, x]) @ np.array(b.into) + np.array(b.into_bias))
    for own, bias, message in zip(b.own, b.own_bias, b.message):
        h = np.tanh(h @ np.array(own) + np.array(bias) + share @ (h @ np.array(message)))
    z = np.exp(np.log(np.maximum(v, 1e-12)) + (h @ np.array(b.head) + np.array(b.head_bias)) * has)
    out = z / z.sum(1, keepdims=True)
    return {n: (out[i].tolist(), int((a[i] > 0).sum()), float(np.abs(out[i] - mu[i]).sum()), float(np.linalg.norm(h[i]))) for n, i in at.items()}


def test_gated_messages_equal_matrices(spark, store):
    rng = np.random.default_rng(3)
    m = lambda *shape: rng.normal(0, 0.7, shape).tolist()
    b = graph.GatedBlock(m(4, 3), m(5, 4), m(4), m(2, 4, 4), m(2, 4), m(2, 4, 4), m(3), 0.2, m(4, 3), m(3), 0.5)
    nodes, edges = {}, {}
    for t in (1, 2):
        nodes[t] = {n: (rng.dirichlet([1, 1, 1]).tolist(), m(2)) for n in range(7)}
        edges[t] = [(i, j, float(rng.integers(0, 3)), None if (i + j) % 5 == 0 else m(3)) for i in range(6) for j in range(6) if i != j and rng.random() < 0.5]  # the last node has none
    table = spark.createDataFrame([(t, n, *v) for t in nodes for n, v in nodes[t].items()], "t long, node long, mu array<double>, x array<double>")
    links = spark.createDataFrame([(t, *e) for t in edges for e in edges[t]], "t long, node long, near long, weight double, f array<double>")
    got = graph.gated_messages(table, links, ["t"], b, store, "f").collect()
    assert len(got) == 14
    for r in got:
        mu, n, shift, context = gated(nodes[r.t], edges[r.t], b, range(7))[r.node]
        assert np.allclose(r.mu, mu) and r.neighbours == n and r.shift == pytest.approx(shift) and r.context == pytest.approx(context)
    alone = graph.gated_messages(table.where("t = 1").drop("t"), links.where("t = 1").drop("t"), [], b, store).collect()
    assert {r.node: r.mu for r in alone}[6] == pytest.approx(nodes[1][6][0])


def test_nearest_by_warped_distance(spark, store):
    rng = random.Random(4)
    series = {i: [round(rng.random() * (1 + i % 3), 2) for _ in range(rng.randint(3, 9))] for i in range(30)}
    series |= {100: series[3], 101: series[3], 102: [0.5]}
    df = spark.createDataFrame([*series.items(), (200, None), (201, [])], "id long, series array<double>")
    got = {r.id: (r.nearest, r.distance) for r in shapes.nearest_warped(df, store, 3, 8, 2).collect()}
    assert got.keys() == series.keys()
    for i, x in series.items():
        want = min((round(shapes.dtw(*(series[k] for k in sorted((i, j))), window=3), 6), j) for j in series if j != i)
        assert got[i] == (want[1], want[0])
    low = shapes.warped_bounds([np.array(x) for x in series.values()], [np.array(x) for x in series.values()], 3)
    for a, x in enumerate(series.values()):
        for b, y in enumerate(series.values()):
            assert low[a, b] <= shapes.dtw(x, y, window=3) + 1e-9
    assert shapes.nearest_warped(df.limit(0), store).count() == 0 and shapes.nearest_warped(df.where("id = 102"), store).count() == 0


@pytest.mark.parametrize("n,m,window,scale", [(30, 30, 5, 1.0), (30, 27, 5, 1e6), (9, 7, 3, 1e-3), (12, 4, 2, 1.0), (5, 5, 0, 1.0), (1, 6, 2, 1.0), (1, 1, 3, 1.0)])
def test_pairs_that_cannot_be_near_are_not_aligned(n, m, window, scale):
    rng = np.random.default_rng(5)
    x, y = rng.exponential(0.5, (40, n)) * scale, rng.exponential(0.5, (70, m)) * scale
    x[0], y[0] = 0.0, 0.0
    d = shapes.cheapest(x, y, window)
    assert d[3, 4] == shapes.dtw(x[3], y[4], window=window)
    for most in (np.full(d.shape, 0.0), np.minimum(d.min(1)[:, None], d.min(0)[None, :]), np.full(d.shape, np.median(d)), np.full(d.shape, np.inf)):
        kept = np.zeros(d.shape, bool)
        kept[shapes.maybe_within(x, y, most, window)] = True
        assert kept[d <= most].all() and kept.sum() <= (d <= most * 1.1 + 1e-5).sum()


def test_nearest_over_lengths_and_odd_series(spark, store):
    rng = np.random.default_rng(6)
    series = {f"s{i}": np.round(rng.exponential(0.5, int(rng.choice([1, 6, 7, 7, 7, 20]))), 2).tolist() for i in range(90)}
    odd = {"null": [1.0, None], "nan": [1.0, float("nan")], "inf": [float("inf")] * 7, "none": None}
    df = spark.createDataFrame([*series.items(), *odd.items()], "id string, series array<double>")
    got = {r.id: (r.nearest, r.distance) for r in shapes.nearest_warped(df, store, 2, 8, 1).collect()}
    d = {(i, j): round(shapes.dtw(series[i], series[j], window=2), 6) for i in series for j in series if i < j}
    want = {i: min((d[min(i, j), max(i, j)], j) for j in series if j != i) for i in series}
    assert {i: (v, j) for i, (j, v) in got.items()} == want


def test_points_and_windows_far_apart(spark, store):
    points = {0: [0.0, 0.0], 1: [0.1, 0.0], 2: [5.0, 5.0], 3: [5.0, 5.0], 4: [9.0, 0.0], 5: [4.0, 2.0]}
    df = spark.createDataFrame(list(points.items()), "id long, x array<double>")
    got = [i for i, _ in shapes.spread_out(df, 6)]
    d = np.array([[np.sum((np.array(a) - b) ** 2) for b in points.values()] for a in points.values()])
    assert got[:5] == shapes.farthest_points(d, 5) and sorted(got) == list(range(6)) and shapes.spread_out(df.limit(0), 3) == []
    windows = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [7.0]), (4, []), (5, None)], "id long, series array<double>")
    chosen = shapes.spread_windows(windows, 5, 3, store)
    assert sorted(i for i, _ in chosen) == [1, 2, 3] and all(len(x) == 3 for _, x in chosen) and 3 in [i for i, _ in chosen[:2]]
    assert dict(chosen)[1] == [1.0, 1.5, 2.0] and dict(chosen)[3] == [7.0] * 3


def test_segments_in_the_jvm_equal_those_in_python(spark):
    rng = np.random.default_rng(7)
    rows, want = [], []
    for w in range(8):
        n = int(rng.integers(1, 40))
        t = np.cumsum(rng.choice([1, 1, 1, 1, 3], n))
        x = rng.integers(0, 3, (n, 2)).astype(float)  # ties abound
        rows += [(w, int(a), *map(float, b)) for a, b in zip(t, x)]
        for run in np.split(np.arange(n), np.flatnonzero(np.diff(t) != 1) + 1):
            want += [(w, int(t[run[a]]), int(t[run[b - 1]])) for a, b in shapes.segment(x[run], 3, 6, 0.3)]
    df = spark.createDataFrame(rows, "workload long, t long, a double, b double")
    got = [tuple(r) for r in shapes.segment_runs(df, ["a", "b"], 3, 6, 0.3).collect()]
    assert sorted(got) == sorted(want)


def test_common_origins(spark):
    rng = random.Random(8)
    rows = [(w, t, rng.random() < 0.85, rng.random() < 0.8) for w in range(3) for t in range(10, 40)]
    got = {(r.origin, r.workload): (r.valid, r.common) for r in ingest.common_origins(spark.createDataFrame(rows, "workload long, t long, input_valid boolean, target_observed boolean"), 12, 38, 3, [3, 5], [1, 2], 0.6).collect()}
    by = {(w, t): (a, b) for w, t, a, b in rows}
    assert len(got) == 3 * len(range(12, 39, 3))
    for (t, w), (valid, common) in got.items():
        want = [f"{n}/{h}" for n in (3, 5) for h in (1, 2) if by[w, t][0] and t - 10 >= n - 1 and sum(by[w, s][0] for s in range(t - n + 1, t + 1)) / n >= 0.6 and by.get((w, t + h), (0, False))[1]]
        assert valid == want and common == (len(want) == 4)


def test_a_gap_of_just_the_length_ends_a_session(spark):
    rows = spark.createDataFrame([("a", 0), ("a", 59), ("a", 119), ("a", 178), ("b", 5), ("b", 65)], "workload string, t long").select("workload", F.timestamp_seconds("t").alias("ts"))
    got = streams.sessions(rows, "60 seconds").select("workload", F.unix_micros("start"), F.unix_micros("end"), "n").collect()
    assert sorted(map(tuple, got)) == [("a", 0, 119_000_000, 2), ("a", 119_000_000, 238_000_000, 2), ("b", 5_000_000, 65_000_000, 1), ("b", 65_000_000, 125_000_000, 1)]


def test_a_batch_reads_and_writes_a_keys_state_once():
    """Each call to the state store is a message to the JVM: one read and one write a key and batch, however many times it has."""
    import pandas as pd

    calls, value, timers = [], [None], set()

    class Value:
        def get(self):
            calls.append("get")
            return value[0]

        def update(self, x):
            calls.append("update")
            value[0] = x

    class Handle:
        def getValueState(self, *_):
            return Value()

        def registerTimer(self, t):
            timers.add(t)

        def deleteTimer(self, t):
            timers.remove(t)

    work = streams.RollingDecay(0.1, 12, 20, 1)
    work.init(Handle())
    events, got = [[3, 9, 9, 15], [4, 16], [8, 60, 61]], {}
    for batch in events:
        for out in work.handleInputRows(("a",), iter([pd.DataFrame({"t": batch})]), None):
            got.update(zip(out["t"], out["weight"]))
    want = plain([("a", t) for b in events for t in b], 0.1, 12)
    assert got.keys() == {t for _, t in want} and all(abs(got[t] - w) < 1e-9 for (_, t), w in want.items())
    assert calls == ["get", "update"] * 3 and timers == {(61 + 12 + 20 + 1 + streams.AHEAD) * 1000}

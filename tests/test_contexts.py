"""Back-off as a growing state against a scan; recursive forecasts, variants, resumption."""

import json

import numpy as np
import pytest

from loomcast.operators import learn
from loomcast.operators.contexts import DecayedContexts
from pyspark.sql import functions as F


def _events(n=60, seed=5):
    r = np.random.default_rng(seed)
    return [(int(w), float(t), int(s), r.dirichlet(np.ones(3))) for t, w, s in zip(np.sort(r.choice(500, n, replace=False)), r.integers(0, 3, n), r.integers(0, 3, n))]


def _scan(events, ctx, now, decay, max_age):
    out = np.zeros(3)
    for w in {e[0] for e in events}:
        mine = [e for e in events if e[0] == w]
        for i, (_, t, _, target) in enumerate(mine):
            if i >= len(ctx) and tuple(e[2] for e in mine[i - len(ctx) : i]) == ctx and now - max_age <= t < now:
                out += np.exp(-decay * (now - t)) * target
    return out


def test_counts_equal_a_scan_in_any_order_of_arrival():
    events = _events()
    a, b = (DecayedContexts(3, 2, 0.02, 150) for _ in range(2))
    for e in events:
        a.append(*e)
        a.predict([0, 1], e[1])  # queries between appends use the same index
    for i in np.random.default_rng(1).permutation(len(events)):
        b.append(*events[i])
    for now in (100.0, 300.0, 501.0):
        for ctx in ((), (0,), (1, 2), (2, 2)):
            want = _scan(events, ctx, now, 0.02, 150)
            assert np.allclose(a.counts(ctx, now), want) and np.allclose(b.counts(ctx, now), want)


def test_pruned_cloned_and_stored_states_answer_alike():
    a = DecayedContexts(3, 2, 0.02, 150)
    for e in _events():
        a.append(*e)
    b, c = a.clone(), DecayedContexts.restored(json.loads(json.dumps(a.exported())))
    b.prune(501)
    assert sum(map(len, b.events.values())) < sum(map(len, a.events.values()))
    for ctx in ([], [0], [1, 2]):
        want, order = a.predict(ctx, 501)
        assert want.sum() == pytest.approx(1)
        for other in (b, c):
            got, o = other.predict(ctx, 501)
            assert np.allclose(got, want) and o == order
    with pytest.raises(RuntimeError):
        a.freeze().append(0, 600, 1)
    a.clone().append(0, 600, 1)


def test_without_events_all_is_even_and_hard_falls_back():
    a = DecayedContexts(2, 2, 0.0, 10)
    assert a.predict([0, 1], 5)[0].tolist() == [0.5, 0.5] and a.predict([], 5) [1] == 0
    a.append("x", 1, 1)
    a.append("y", 1, 1)
    assert a.predict([0], 5, hard=True)[1] == 0 and np.allclose(a.predict([0], 5, hard=True)[0], [0.25, 0.75])


def _packed(spark):
    states = [(w, t, (t + w) % 3) for w in range(4) for t in range(12) if (w, t) != (2, 7)]
    mu = spark.createDataFrame([(w, t, np.eye(3)[s].tolist(), s) for w, t, s in states], "workload long, t long, mu array<double>, state int")
    edges = spark.createDataFrame([(0, 1, 1.0), (1, 0, 0.5), (3, 77, 1.0)], "src long, dst long, weight double")
    return learn.pack_histories(mu, edges, spark.createDataFrame([(9,), (11,)], "origin long"), 8)


def test_roll_outs_follow_a_cycle_and_variants_differ(spark):
    packed, b = _packed(spark).cache(), learn.Blocks(3, blend=0.9)
    r = np.random.default_rng(0)
    p = {k: v + r.normal(0, 0.3, v.shape) for k, v in b.start().items()}
    out = learn.roll_out(packed, b.start(), b, np.full((3, 3), 1 / 3), 4, order=2)
    top = {(x["origin"], x["workload"], x["h"]): x["s"] for x in out.groupBy("origin", "workload", "h").agg(F.max_by("state", "p").alias("s")).collect()}
    assert len(top) == 2 * 4 * 4 and all(s == (o + w + h) % 3 for (o, w, h), s in top.items())
    prior = r.dirichlet(np.ones(3), 3)
    sums = {}
    for name in ("full", "ns_mem", "dyn_trans", "multi_hop", "vo_markov"):
        rows = learn.roll_out(packed, p, learn.variant(b, name), prior, 3, order=1 if name == "vo_markov" else 2, hard=name == "vo_markov").toPandas()
        assert np.allclose(rows.groupby(["origin", "workload", "h"])["p"].sum(), 1)
        sums[name] = rows.sort_values(["origin", "workload", "h", "state"])["p"].to_numpy()
    assert all(not np.allclose(sums["full"], v) for k, v in sums.items() if k != "full")


def test_stopped_roll_outs_go_on(spark, tmp_path):
    packed, b, path = _packed(spark), learn.Blocks(3), str(tmp_path / "f")
    args = (b.start(), b, np.full((3, 3), 1 / 3), 2)
    assert learn.roll_out_to(path, packed.where("origin = 9"), *args).select("origin").distinct().count() == 1
    both = learn.roll_out_to(path, packed, *args)
    whole = learn.roll_out(packed, *args)
    assert sorted(map(tuple, both.collect())) == sorted(map(tuple, whole.collect()))

"""Forecasts rest on all workloads of an origin, however they are numbered."""

import datetime

import numpy as np
import pytest
from loomcast.operators import forecast, graph, ingest, learn
from loomcast.plans import queries, usage


def _events(spark, folder, step):
    """Twelve users over nine days; their numbers are `step` apart."""
    r, rows = np.random.default_rng(5), []
    for i in range(420):
        w = int(r.integers(12))
        ts = datetime.datetime(2024, 1, 1) + datetime.timedelta(days=int(r.integers(9)), seconds=i)
        rows.append((i, ts, w * step, "abc"[int(r.integers(3)) if w % 3 else i % 2], float(r.integers(300)), f'{{"k": {i % 90}}}'))
    df = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    df.write.mode("overwrite").parquet(f"{folder}/events.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["learned_forecast", "roll_out", "recursive_forecast"])
def test_numbers_of_workloads_do_not_matter(spark, tmp_path, name):
    near, far = (queries.run(spark, name, _events(spark, tmp_path / str(step), step)).toPandas() for step in (1, 83))
    if "workload" in near:
        near["workload"] *= 83
        assert near["origin"].nunique() == far["origin"].nunique() == 1
    same = near.merge(far, on=[c for c in near if c not in ("p", "loss")])
    assert len(same) == len(near) == len(far) > 0
    value = "p" if "p" in near else "loss"
    assert np.allclose(same[f"{value}_x"], same[f"{value}_y"], atol=2e-6)


def test_training_sees_every_pair_of_a_slot(spark, tmp_path, monkeypatch):
    seen = []
    monkeypatch.setattr(learn, "train", lambda packed, b, *a, **o: seen.append((packed.collect(), b.k)) or learn.Training.fresh(b))
    folder = _events(spark, tmp_path, 83)
    queries.run(spark, "learned_forecast", folder).collect()
    degree = lambda adj: adj.degree if hasattr(adj, "degree") else (adj > 0).sum(1)
    rows, k = seen[0]
    got = {int(t[0]): int(np.sum(degree(adj))) for r in rows for _, adj, t, *_ in learn._dense(r["cohort"], k)}
    home = {r["workload"]: r["node"] for r in ingest.majority_node(usage.usage(spark, folder)).collect()}
    slots: dict = {}
    for r in rows:
        for x in r["cohort"]:
            slots.setdefault(x["t"], []).append(x["workload"])
    pairs = {t: sum(a != b and home[a] == home[b] for a in ws for b in ws) for t, ws in slots.items()}
    assert got == pairs and sum(pairs.values()) > 0


@pytest.mark.parametrize("hard,max_age", [(False, None), (False, 4.0), (True, None)])
def test_whole_roll_outs_equal_one_packed_cohort(spark, hard, max_age):
    r, k = np.random.default_rng(3), 3
    rows = [(w * 61, t, r.dirichlet(np.ones(k)).tolist(), int(r.integers(k))) for w in range(14) for t in range(12) if r.random() < 0.8]
    mu = spark.createDataFrame(rows, "workload long, t long, mu array<double>, state int")
    home = spark.createDataFrame([(w * 61, f"n{w % 3}" if w else "alone") for w in range(13)], "workload long, node string")
    origins = spark.createDataFrame([(8,), (11,)], "origin long")
    b = learn.Blocks(k, period=7.0)
    p = {n: v + r.normal(0, 0.4, v.shape) for n, v in b.start().items()}
    prior, options = r.dirichlet(np.ones(k), k), {"order": 2, "decay": 0.1, "max_age": max_age, "hard": hard}
    whole = learn.roll_out_whole(mu, home, origins, 6, p, b, prior, 3, lambda x: x.localCheckpoint(), **options)
    one = learn.roll_out(learn.pack_histories(mu, graph.hypergraph(home), origins, 6), p, b, prior, 3, **options)
    keys = ["origin", "workload", "h", "state"]
    x, y = (df.toPandas()[[*keys, "p"]].sort_values(keys).to_numpy() for df in (whole, one))
    assert x.shape == y.shape and len(x) > 200 and np.allclose(x, y)


def test_nodes_are_their_pairs(spark):
    at, r = ["a", "b", "a", None, "a", "c", "b", None], np.random.default_rng(0)
    pairs = np.array([[float(i != j and x is not None and x == y) for j, y in enumerate(at)] for i, x in enumerate(at)])
    b = learn.Blocks(3)
    values = {n: v + r.normal(0, 0.4, v.shape) for n, v in b.start().items()}
    mu, got = r.dirichlet(np.ones(3), len(at)), []
    for adjacency in (learn.Nodes(at), pairs):
        vs = {n: learn.Var(v) for n, v in values.items()}
        out = learn.modulated(vs, b, mu, adjacency)
        got.append((out.x, learn.gradients(learn.soft_ce(out, mu, np.ones(len(at))), vs)))
    assert np.allclose(got[0][0], got[1][0]) and all(np.allclose(got[0][1][n], got[1][1][n]) for n in values)


def test_alike_workloads_of_a_large_slot_are_one_row(spark):
    r, k = np.random.default_rng(9), 3
    f = np.eye(k).tolist()
    rows = [(w, t, 1, f[int(r.integers(k))], f[int(r.integers(k))] if w % 7 else None, None if w % 2 else [0.2, 0.3, 0.5]) for t in (4, 5) for w in range(300 if t == 4 else 20)]
    df = spark.createDataFrame(rows, "workload long, t long, h int, mu array<double>, target array<double>, back array<double>")
    home = spark.createDataFrame([(w, "ab"[w % 2] if w % 5 else None) for w in range(290)], "workload long, node string")
    b = learn.Blocks(k, period=7.0)
    p = {n: v + r.normal(0, 0.4, v.shape) for n, v in b.start().items()}
    prior, whole, few = np.full((k, k), 1 / k), learn.pack_slots(df, home, None), learn.pack_slots(df, home, 100)
    size = {x["origin"]: len(x["cohort"]) for x in few.collect()}
    assert size[4] <= 2 * 3 * k * (k + 1) and size[5] == 20 and sum(c["n"] for x in few.collect() for c in x["cohort"]) == 320
    (la, na, ga), (lb, nb, gb) = (learn.loss_and_gradients(x, p, b, prior) for x in (whole, few))
    assert na == nb and la == pytest.approx(lb) and all(np.allclose(ga[n], gb[n]) and np.abs(ga[n]).max() > 0 for n in ("theta", "res_w", "mlp_in"))
    assert learn.forecast(whole, p, b, prior).count() == 320 * k
    with pytest.raises(Exception, match="alike=None"):
        learn.forecast(few, p, b, prior).collect()


def test_recursive_forecasts_share_counts_over_all_workloads(spark):
    """Workload 5000 was never in state 1 before its end; only the others tell that 1 is followed by 2."""
    seqs = {w * 250: [0, 1, 2] * 6 for w in range(20)} | {5000: [0, 0, 1]}
    h = spark.createDataFrame([(7, w, t, s) for w, x in seqs.items() for t, s in enumerate(x)], "origin long, workload long, t long, state int")
    first = {r["state"]: r["p"] for r in forecast.recursive_rollout(h, 3, 2).where("workload = 5000 and h = 1").collect()}
    counts, pairs = forecast._mix(list(seqs.values()), 3, 2, 0.02), np.ones((3, 3))
    for x in seqs.values():
        np.add.at(pairs, (x[:-1], x[1:]), 1)
    mine = 0.5 * (pairs / pairs.sum(1, keepdims=True))[1] + 0.5 * forecast._predict(counts, [0, 1], 3, 2, 1.0, 2.0, 1.0)
    assert np.allclose([first[s] for s in range(3)], mine / mine.sum()) and first[2] > 0.9

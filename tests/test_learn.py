"""Learned blocks: gradients against differences, neutrality, training, resume."""

import numpy as np
import pytest
from loomcast.operators import learn
from pyspark.sql import types as T

B = learn.Blocks(3, hidden=5, horizon=4)


def _case(n=4, seed=0):
    r = np.random.default_rng(seed)
    soft = lambda: r.dirichlet(np.ones(3), n)
    adj = np.array([[0, 1, 1, 0], [1, 0, 0, 0], [1, 0, 0, 0], [0, 0, 0, 0]], float)
    return soft(), adj, np.arange(n) * 100.0, soft(), soft(), r.dirichlet(np.ones(3), 3)


def _loss(p, case, h):
    mu, adj, t, back, target, prior = case
    vs = {k: learn.Var(v) for k, v in p.items()}
    out, dyn = learn.step(vs, B, mu, adj, t, back, prior, h)
    ones = np.ones(len(t))
    return learn.soft_ce(out, target, ones) + learn.soft_ce(dyn, target, ones) * 0.5 + learn.brier(out, target, ones), vs


def test_gradients_equal_differences():
    r = np.random.default_rng(1)
    p = {k: v + r.normal(0, 0.2, v.shape) for k, v in B.start().items()}
    case, h = _case(), np.array([1.0, 2, 3, 4])
    loss, vs = _loss(p, case, h)
    got = learn.gradients(loss, vs)
    for k in p:
        for at in list(np.ndindex(p[k].shape))[:6]:
            up, down = ({**p, k: p[k].copy()} for _ in range(2))
            up[k][at] += 1e-5
            down[k][at] -= 1e-5
            want = (_loss(up, case, h)[0].x.item() - _loss(down, case, h)[0].x.item()) / 2e-5
            assert got[k][at] == pytest.approx(want, abs=1e-6), (k, at)


def test_untrained_blocks_are_neutral():
    mu, adj, t, back, _, prior = _case()
    p = {k: learn.Var(v) for k, v in B.start().items()}
    assert np.allclose(learn.modulated(p, B, mu, adj).x, mu)
    assert np.allclose(learn.moved(p, B, mu, t, prior).x, mu @ prior)
    assert np.allclose(learn.corrected(p, B, back, mu, np.array([1.0, 2, 3, 4])).x, back)
    assert np.allclose(learn.moved(p, learn.variant(B, "dyn_trans"), mu, t, prior).x, mu @ prior)


def _rows(spark, null_target=False):
    """A state moves on by one in even periods and back by one in odd ones: only phase tells."""
    f, rows = np.eye(3), []
    for origin in range(12):
        for w in range(4):
            s, odd = (origin + w) % 3, origin % 2
            target = f[(s + (2 if odd else 1)) % 3].tolist()
            rows.append((origin, w, origin * 720, 1, f[s].tolist(), None if null_target and w == 0 else target, None))
    a = T.ArrayType(T.DoubleType())
    schema = T.StructType([T.StructField(n, T.LongType()) for n in ("origin", "workload", "t", "h")] + [T.StructField(n, a) for n in ("mu", "target", "back")])
    edges = spark.createDataFrame([(0, 1, 1.0), (1, 0, 1.0), (2, 9, 1.0)], "src long, dst long, weight double")
    return learn.pack(spark.createDataFrame(rows, schema), edges)


def test_training_learns_phase_and_resumes(spark):
    packed, prior, b = _rows(spark, True).cache(), np.full((3, 3), 1 / 3), learn.Blocks(3, hidden=6, blend=0.1)
    kept = []
    full = learn.train(packed, b, prior, epochs=8, rate=0.1, batches=2, patience=9, on_epoch=lambda s: kept.append(s.dump()))
    assert full.losses[-1] < 0.7 * full.losses[0]
    again = learn.train(packed, b, prior, epochs=8, rate=0.1, batches=2, patience=9, state=learn.Training.load(kept[3]))
    assert np.allclose(full.losses, again.losses) and all(np.allclose(full.p[k], again.p[k]) for k in full.p)
    out = learn.forecast(packed, full.best, b, prior).toPandas()
    assert len(out) == 12 * 4 * 3 and np.allclose(out.groupby(["origin", "workload"])["p"].sum(), 1)
    p2, b2 = learn.decoded(learn.encoded(full.best, b))
    assert b2 == b and all((p2[k] == full.best[k]).all() for k in p2)


def test_training_without_rows_changes_nothing(spark):
    b = learn.Blocks(3)
    s = learn.train(_rows(spark).where("origin < 0"), b, np.full((3, 3), 1 / 3), epochs=2)
    assert s.steps == 0 and all((s.p[k] == v).all() for k, v in b.start().items())

"""Recursive roll-outs, training of a transition kernel, persistence, and ablation switches."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import EPS, affine, phase, simplex, softmax


@dataclass(frozen=True)
class Variant:
    """Strategy switches: each names what is replaced."""

    spatial: bool = True
    hypergraph: bool = True
    dynamic: bool = True
    max_order: int = 2
    rounds: int = 2

    @classmethod
    def named(cls, name: str) -> Variant:
        return {"full": cls(), "ns_mem": cls(spatial=False), "hypergraph": cls(hypergraph=False), "dyn_trans": cls(dynamic=False), "vo_markov": cls(max_order=1), "multi_hop": cls(rounds=1)}[name]


def _mix(history: list[list[int]], k: int, top: int, decay: float) -> dict[tuple, np.ndarray]:
    """Counts by context of every order up to top: a context's counts decay with age in steps."""
    out: dict[tuple, np.ndarray] = {}
    for states in history:
        n = len(states)
        for i, s in enumerate(states):
            w = np.exp(-decay * (n - i))
            for o in range(min(top, i) + 1):
                key = tuple(states[i - o : i])
                out.setdefault(key, np.zeros(k))[s] += w
    return out


def _predict(counts: dict, ctx: list[int], k: int, top: int, smoothing: float, threshold: float, temperature: float) -> np.ndarray:
    left, out = 1.0, np.zeros(k)
    for o in range(min(top, len(ctx)), -1, -1):
        c = counts.get(tuple(ctx[len(ctx) - o :]))
        if c is None:
            continue
        gate = 1.0 if o == 0 else 1 / (1 + np.exp(-(c.sum() - threshold) / temperature))
        out += left * gate * (c + smoothing) / (c.sum() + smoothing * k)
        left *= 1 - gate
    return out / out.sum() if out.sum() > 0 else np.full(k, 1 / k)


def recursive_rollout(history: DataFrame, k: int, horizon: int, variant: Variant = Variant(), beta: float = 0.5, smoothing: float = 1.0, threshold: float = 2.0, temperature: float = 1.0, decay: float = 0.02) -> DataFrame:
    """(origin, workload, h, state, p) from (origin, workload, t, state int).

    Step by step: the transition matrix moves each workload's soft state, back-off answers its context, and
    the blend's most likely state extends the context. All workloads of an origin share counts and transitions,
    however many they are: Spark sums them, and the sums, whose number is bounded by k, the order and the origins,
    are sent to the tasks that roll the workloads out. A workload's own history is one row.
    """
    top, kind = variant.max_order, dict(history.dtypes)["workload"]
    seqs = history.groupBy("origin", "workload").agg(F.sort_array(F.collect_list(F.struct("t", F.col("state").cast("int").alias("s")))).alias("a")).select(F.col("origin").cast("long").alias("origin"), "workload", F.transform("a", lambda x: x["s"]).alias("states"))

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for origin, g in b.groupby("origin"):
                states = [x.tolist() for x in g["states"]]
                pairs = np.zeros((k, k))
                for x in states:
                    np.add.at(pairs, (x[:-1], x[1:]), 1)
                rows += [(origin, "counts", list(c), i, v) for c, got in _mix(states, k, top, decay).items() for i, v in enumerate(got) if v]
                rows += [(origin, "pairs", [i], j, pairs[i, j]) for i, j in zip(*np.nonzero(pairs))]
            yield pd.DataFrame(rows, columns=["origin", "kind", "ctx", "state", "v"])

    models: dict = {}
    sums = seqs.select("origin", "states").mapInPandas(part, "origin long, kind string, ctx array<int>, state int, v double")
    for r in sums.groupBy("origin", "kind", "ctx", "state").agg(F.sum("v").alias("v")).collect():
        counts, pairs = models.setdefault(r["origin"], ({}, np.full((k, k), smoothing)))
        if r["kind"] == "pairs":
            pairs[r["ctx"][0], r["state"]] += r["v"]
        else:
            counts.setdefault(tuple(r["ctx"]), np.zeros(k))[r["state"]] += r["v"]
    shared = history.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matrices = {o: pairs / pairs.sum(1, keepdims=True) for o, (_, pairs) in shared.value.items()}
        for b in batches:
            rows = []
            for origin, name, seq in zip(b["origin"], b["workload"], b["last"]):
                counts, mu, ctx = shared.value[origin][0], np.eye(k)[seq[-1]], seq.tolist()
                for h in range(1, horizon + 1):
                    mu = (1 - beta) * (mu @ matrices[origin]) + beta * _predict(counts, ctx, k, top, smoothing, threshold, temperature)
                    mu = mu / mu.sum()
                    ctx = [*ctx, int(mu.argmax())][-max(top, 1) :]
                    rows += [(origin, name, h, s, float(mu[s])) for s in range(k)]
            yield pd.DataFrame(rows, columns=["origin", "workload", "h", "state", "p"])

    keep = F.lit(max(top, 1))
    last = F.slice("states", F.greatest(F.size("states") - keep, F.lit(0)) + 1, keep)
    return seqs.select("origin", "workload", last.alias("last")).mapInPandas(run, f"origin long, workload {kind}, h int, state int, p double")


def train_kernel(pairs: DataFrame, features: int, k: int, epochs: int = 20, rate: float = 0.5, l2: float = 1e-3) -> tuple[np.ndarray, list[float]]:
    """Full-batch gradient descent of softmax(x W) on (x array<double>, y int): each epoch sums gradients on the executors.

    Only a features x k gradient and the loss reach the driver.
    """
    w, losses = np.zeros((features, k)), []
    for _ in range(epochs):
        now = w.copy()

        def part(batches, now=now):
            g, loss, n = np.zeros((features, k)), 0.0, 0
            for b in batches:
                if len(b):
                    x, y = np.stack(b["x"].to_numpy()), b["y"].to_numpy(int)
                    z = x @ now
                    z -= z.max(1, keepdims=True)
                    p = np.exp(z) / np.exp(z).sum(1, keepdims=True)
                    loss -= float(np.log(np.maximum(p[np.arange(len(y)), y], 1e-12)).sum())
                    p[np.arange(len(y)), y] -= 1
                    g, n = g + x.T @ p, n + len(y)
            yield pd.DataFrame({"i": np.arange(g.size + 2), "v": np.concatenate([g.ravel(), [loss, n]])})

        got = {r[0]: r[1] for r in pairs.select("x", "y").mapInPandas(part, "i int, v double").groupBy("i").agg(F.sum("v")).collect()}
        n = max(got.get(features * k + 1, 0), 1)
        w -= rate * (np.array([got.get(i, 0.0) for i in range(features * k)]).reshape(features, k) / n + l2 * w)
        losses.append(got.get(features * k, 0.0) / n)
    return w, losses


def persistence_gain(df: DataFrame, truth: str, model: str, base: str, keys: list[str]) -> DataFrame:
    """(keys, model_mae, persistence_mae, gain)."""
    a, b = F.avg(F.abs(F.col(truth) - F.col(model))), F.avg(F.abs(F.col(truth) - F.col(base)))
    return df.groupBy(*keys).agg(a.alias("model_mae"), b.alias("persistence_mae"), (b - a).alias("gain"))


@dataclass(frozen=True)
class DirectHead:
    """Parameters of direct forecasts over k states: a transition network of (k + 2) x g and g x k*k with biases, a prior
    of k x k, and a correction from k memberships and 4 features of the horizon through c hidden numbers to k."""

    into: list
    into_bias: list
    out: list
    out_bias: list
    prior: list
    of_state: list
    of_horizon: list
    correct_bias: list
    correct: list
    longest: int
    period: float
    blend: float = 0.5


def direct_forecast(rows: DataFrame, keys: list[str], head: DirectHead) -> DataFrame:
    """(keys, h, dynamic, p): every horizon from one origin, none through another, all in one pass over the rows.

    rows has keys, h, t (the time forecast), mu (the origin's memberships after its neighbours' say) and back
    (what back-off gives for h; null counts as mu). dynamic is mu through a transition matrix that depends on
    mu and on the time's phase; it is blended with back and corrected by mu and the horizon. Matrices are
    literals in the plan, so a forecast is a projection and nothing shuffles.
    """
    k = len(head.prior)
    mu, eps = [F.get("mu", F.lit(i)) for i in range(k)], F.lit(EPS)
    sine, cosine = phase(F.col("t"), head.period)
    hidden = affine([*mu, sine, cosine], head.into, head.into_bias)
    rows = rows.withColumns({f"_z{i}": F.tanh(c) for i, c in enumerate(hidden)})
    learned = affine([F.col(f"_z{i}") for i in range(len(hidden))], head.out, head.out_bias)
    rows = rows.withColumns({f"_r{i}": softmax(F.array(*(learned[i * k + j] + math.log(max(head.prior[i][j], EPS)) for j in range(k)))) for i in range(k)})
    moved = simplex(F.array(*(sum((mu[i] * F.get(f"_r{i}", F.lit(j)) for i in range(1, k)), mu[0] * F.get("_r0", F.lit(j))) for j in range(k))))
    rows = rows.withColumn("dynamic", moved).withColumn("back", F.coalesce("back", "mu"))
    rows = rows.withColumn("_base", simplex(F.zip_with("dynamic", "back", lambda a, b: a * (1 - head.blend) + b * head.blend)))
    share = F.col("h") / F.lit(float(head.longest))
    features = [share, F.log1p(F.col("h").cast("double")) / math.log1p(head.longest), F.sin(2 * math.pi * share), F.cos(2 * math.pi * share)]
    moves = affine([F.tanh(a + b) for a, b in zip(affine(mu, head.of_state, head.correct_bias), affine(features, head.of_horizon))], head.correct)
    final = softmax(F.array(*(F.ln(F.greatest(F.get("_base", F.lit(j)), eps)) + moves[j] for j in range(k))))
    return rows.withColumn("p", final).select(*keys, "h", "dynamic", "p")

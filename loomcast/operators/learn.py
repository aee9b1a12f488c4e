"""Learned blocks: message passing over neighbours, a time-aware transition, a horizon head, and their training.

Parameters are small arrays on the driver. An origin's cohort is packed in one row, so that a step of
training is one pass without a shuffle: executors differentiate the loss over their rows, and only
gradients, which have the size of the parameters, are summed.
"""

from __future__ import annotations

import base64
import io
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, replace
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EPS = 1e-12


class Var:
    """An array with the means to pass gradients to what it came from."""

    __array_priority__ = 1

    def __init__(self, x, *sources):
        self.x, self.sources, self.g = np.asarray(x, float), sources, None

    def __add__(self, o):
        o = var(o)
        return Var(self.x + o.x, (self, lambda g: g), (o, lambda g: g))

    def __mul__(self, o):
        o = var(o)
        return Var(self.x * o.x, (self, lambda g: g * o.x), (o, lambda g: g * self.x))

    def __truediv__(self, o):
        o = var(o)
        return Var(self.x / o.x, (self, lambda g: g / o.x), (o, lambda g: -g * self.x / o.x**2))

    def __matmul__(self, o):
        o = var(o)
        return Var(self.x @ o.x, (self, lambda g: g @ o.x.T), (o, lambda g: self.x.T @ g))

    __radd__, __rmul__ = __add__, __mul__

    def __neg__(self):
        return self * -1.0

    def __sub__(self, o):
        return self + -var(o)

    def tanh(self):
        y = np.tanh(self.x)
        return Var(y, (self, lambda g: g * (1 - y * y)))

    def log(self):
        inside = np.maximum(self.x, EPS)
        return Var(np.log(inside), (self, lambda g: g * (self.x >= EPS) / inside))

    def softmax(self):
        e = np.exp(self.x - self.x.max(-1, keepdims=True))
        y = e / e.sum(-1, keepdims=True)
        return Var(y, (self, lambda g: y * (g - (g * y).sum(-1, keepdims=True))))

    def clip(self, lo, hi):
        return Var(np.clip(self.x, lo, hi), (self, lambda g: g * ((self.x >= lo) & (self.x <= hi))))

    def reshape(self, *shape):
        return Var(self.x.reshape(shape), (self, lambda g: g.reshape(self.x.shape)))

    def sum(self, axis):
        return Var(self.x.sum(axis, keepdims=True), (self, lambda g: np.broadcast_to(g, self.x.shape)))


def var(x) -> Var:
    return x if isinstance(x, Var) else Var(x)


def beside(*parts) -> Var:
    """Columns of several arrays side by side."""
    parts = [var(p) for p in parts]
    ends = np.cumsum([0, *(p.x.shape[1] for p in parts)])
    return Var(np.concatenate([p.x for p in parts], 1), *[(p, lambda g, a=a, b=b: g[:, a:b]) for p, a, b in zip(parts, ends, ends[1:])])


def gradients(loss: Var, of: dict[str, Var]) -> dict[str, np.ndarray]:
    order, seen, todo = [], set(), [(loss, False)]
    while todo:
        v, done = todo.pop()
        if done:
            order.append(v)
        elif id(v) not in seen:
            seen.add(id(v))
            todo += [(v, True), *((s, False) for s, _ in v.sources)]
    loss.g = np.ones_like(loss.x)
    for v in reversed(order):
        for s, back in v.sources:
            g = back(v.g)
            g = g.sum(tuple(range(g.ndim - s.x.ndim))) if g.ndim > s.x.ndim else g
            g = g.sum(tuple(i for i, n in enumerate(s.x.shape) if n == 1 and g.shape[i] > 1), keepdims=True)
            s.g = g if s.g is None else s.g + g
    return {k: np.zeros_like(v.x) if v.g is None else v.g for k, v in of.items()}


@dataclass(frozen=True)
class Blocks:
    """Shape of the learned model. spatial off: memberships pass unchanged; dynamic off: the prior matrix for all."""

    k: int
    rounds: int = 2
    strength: float = 0.5
    period: float = 1440.0
    hidden: int = 16
    blend: float = 0.5
    spatial: bool = True
    dynamic: bool = True
    horizon: int = 1

    def start(self, seed: int = 7) -> dict[str, np.ndarray]:
        """Residual, transition and horizon outputs begin at zero, so an untrained model changes nothing and moves by the prior."""
        r, k, h = np.random.default_rng(seed), self.k, self.hidden
        return {"theta": r.normal(0, 0.1, (k + 1, k)), "res_w": np.zeros((2 * k, k)), "res_b": np.zeros((1, k)), "mlp_in": r.normal(0, 0.3, (k + 2, h)), "mlp_b": np.zeros((1, h)), "mlp_out": np.zeros((h, k * k)), "head_mu": r.normal(0, 0.3, (k, h)), "head_h": r.normal(0, 0.3, (4, h)), "head_out": np.zeros((h, k))}


def horizon_features(h: np.ndarray, top: int) -> np.ndarray:
    """Share of the horizon, its logarithm's share, and a wave of one turn."""
    s = h / top
    return np.stack([s, np.log1p(h) / np.log1p(top), np.sin(2 * np.pi * s), np.cos(2 * np.pi * s)], 1)


class Nodes:
    """Workloads on one node are one another's neighbours, all equally near. A node's total stands for its pairs.

    at: each workload's node, any value; None for a workload without node, which has no neighbours. n: how many
    workloads of that node, all alike, a row stands for.
    """

    def __init__(self, at: list, n: list | None = None):
        self.n = np.ones(len(at)) if n is None else np.asarray(n, float)
        names = {x: i for i, x in enumerate(dict.fromkeys(x for x in at if x is not None))}
        self.at = np.array([names.get(x, len(names)) for x in at], int)
        size = np.bincount(self.at, self.n, len(names) + 1).astype(int)
        size[-1] = 1
        self.degree = (size - 1)[self.at].reshape(-1, 1)

    def __len__(self) -> int:
        return int(self.n.sum())

    def _less_own(self, total: np.ndarray, x: np.ndarray) -> np.ndarray:
        return np.where(self.degree > 0, (total - x) / np.maximum(self.degree, 1), 0.0)

    def _totals(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(self.at, x[:, j], self.at.max(initial=0) + 1) for j in range(x.shape[1])], 1)[self.at]

    def mean(self, h: Var) -> Var:
        # a node's workloads have one degree, so the map is its own transpose, but for the number that a row stands for
        n = self.n.reshape(-1, 1)
        return Var(self._less_own(self._totals(h.x * n), h.x), (h, lambda g: self._less_own(self._totals(g) * n, g)))


def _near(adjacency, h: Var) -> Var:
    if isinstance(adjacency, Nodes):
        return adjacency.mean(h)
    return var(adjacency / np.maximum(adjacency.sum(1, keepdims=True), EPS)) @ h


def told(p: dict[str, Var], b: Blocks, h: Var, near, deg: np.ndarray, n) -> Var:
    """One round: memberships h, moved by the neighbours' mean near; deg of n workloads are neighbours."""
    m = (beside(near, deg / np.maximum(n - 1, 1)) @ p["theta"]).tanh() * (deg > 0) * b.strength
    r = h * 2.0 - 1.0
    h = ((r + m) / (r * m + 1.0).clip(EPS, np.inf) * 0.5 + 0.5).clip(EPS, 1.0)
    return h / h.sum(1)


def settled(p: dict[str, Var], mu: Var, h: Var) -> Var:
    return (mu.log() + (beside(mu, h) @ p["res_w"] + p["res_b"]).tanh()).softmax()


def modulated(p: dict[str, Var], b: Blocks, mu, adjacency) -> Var:
    """Memberships (n, k) after rounds of neighbours' messages and a residual. A workload without neighbours gets no message.

    adjacency: a matrix of weights, or Nodes.
    """
    mu = var(mu)
    if not b.spatial:
        return mu
    deg = adjacency.degree if isinstance(adjacency, Nodes) else (adjacency > 0).sum(1, keepdims=True)
    h = mu
    for _ in range(b.rounds):
        h = told(p, b, h, _near(adjacency, h), deg, len(adjacency))
    return settled(p, mu, h)


def moved(p: dict[str, Var], b: Blocks, mu, t: np.ndarray, prior: np.ndarray) -> Var:
    """Memberships one step on: each row's own transition matrix, a correction of the log prior by state and phase."""
    mu = var(mu)
    if not b.dynamic:
        return mu @ prior
    a = 2 * np.pi * t.reshape(-1, 1) / b.period
    z = (beside(mu, np.sin(a), np.cos(a)) @ p["mlp_in"] + p["mlp_b"]).tanh() @ p["mlp_out"]
    matrix = (z.reshape(len(t), b.k, b.k) + np.log(np.maximum(prior, EPS))).softmax()
    return (matrix * mu.reshape(len(t), b.k, 1)).sum(1).reshape(len(t), b.k)


def corrected(p: dict[str, Var], b: Blocks, base, mu, h: np.ndarray) -> Var:
    """A base forecast for horizon h, corrected by the current state and the horizon."""
    return (var(base).log() + (var(mu) @ p["head_mu"] + var(horizon_features(h, b.horizon)) @ p["head_h"]).tanh() @ p["head_out"]).softmax()


def step(p: dict[str, Var], b: Blocks, mu, adjacency, t, back, prior, h=None) -> tuple[Var, Var]:
    """(blended, dynamic): one forecast of every workload of a cohort; with h, directly for that horizon."""
    return answered(p, b, modulated(p, b, mu, adjacency), t, back, prior, h)


def answered(p: dict[str, Var], b: Blocks, now: Var, t, back, prior, h=None) -> tuple[Var, Var]:
    """(blended, dynamic) from memberships that neighbours have already moved."""
    dyn = moved(p, b, now, t, prior)
    out = dyn * (1 - b.blend) + var(back) * b.blend
    return (corrected(p, b, out, now, h) if h is not None else out), dyn


def soft_ce(p: Var, target: np.ndarray, weight: np.ndarray) -> Var:
    """Sum, over rows and by weight, of the cross entropy with soft targets."""
    return -(p.log() * target * weight.reshape(-1, 1)).sum((0, 1))


def brier(p: Var, target: np.ndarray, weight: np.ndarray) -> Var:
    d = p - target
    return (d * d * weight.reshape(-1, 1)).sum((0, 1))


def pack(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """(origin, cohort): one row per origin, from (origin, workload, t, mu, target, back, h) and edges (src, dst, weight).

    A cohort is one experiment's workloads, a bounded parameter; edges join on their source, never all to all.
    A null target is not scored; a null back counts as no evidence (uniform). Edges out of the cohort are void.
    """
    near = edges.groupBy(F.col("src").alias("workload")).agg(F.sort_array(F.collect_list(F.struct("dst", F.col("weight").cast("double").alias("weight")))).alias("near"))
    one = rows.join(near, "workload", "left").select("origin", F.struct("workload", "t", "h", "mu", "target", "back", "near").alias("r"))
    return one.groupBy("origin").agg(F.sort_array(F.collect_list("r")).alias("cohort"))


#: Rows of a slot up to which each workload has a row of its own.
ALIKE = 4096


def pack_slots(rows: DataFrame, home: DataFrame, alike: int | None = ALIKE) -> DataFrame:
    """(origin, cohort): one row per slot t, from (workload, t, mu, target, back, h) and home (workload, node).

    Messages stay inside a slot, so a slot with all its workloads is whole: no edge is lost. Neighbours are those
    of one node, kept by name and not as pairs. In a slot of more than `alike` workloads those that are alike in all,
    node too, are one row with their number n: they send, get and answer the same, so losses and gradients stay what
    they are and a row's size is the number of kinds. Forecasts by workload need alike=None.
    """
    one = rows.join(home.select("workload", "node"), "workload", "left")
    large = one.groupBy("t").agg(F.count(F.lit(1)).alias("_size")).where(F.lit(False) if alike is None else F.col("_size") > alike)
    one = one.join(F.broadcast(large), "t", "left").withColumn("_own", F.when(F.col("_size").isNull(), F.col("workload")))
    one = one.groupBy("t", "h", "mu", "target", "back", "node", "_own").agg(F.min("workload").alias("workload"), F.count(F.lit(1)).alias("n"))
    return one.groupBy(F.col("t").alias("origin")).agg(F.sort_array(F.collect_list(F.struct("workload", "t", "h", "mu", "target", "back", "node", "n"))).alias("cohort"))


def _dense(cohort, k: int):
    """A cohort's arrays: for each distinct (t, h) the workloads that have it, so that a message never crosses slots."""
    slots: dict[tuple, list] = {}
    for r in cohort:
        slots.setdefault((r["t"], r["h"]), []).append(r)
    for (t, h), rs in slots.items():
        at = {r["workload"]: i for i, r in enumerate(rs)}
        adj = Nodes([r["node"] for r in rs], [r["n"] for r in rs]) if "node" in rs[0] else np.zeros((len(rs), len(rs)))
        for i, r in enumerate(rs) if "node" not in rs[0] else ():
            for e in r["near"] if r["near"] is not None else ():
                j = at.get(e["dst"])
                if j is not None and j != i:
                    adj[i, j] = e["weight"]
        even = np.full(k, 1 / k)
        get = lambda name: np.stack([even if r[name] is None else np.asarray(r[name], float) for r in rs])
        scored = np.array([float(r["target"] is not None) for r in rs]) * (adj.n if isinstance(adj, Nodes) else 1)
        yield [r["workload"] for r in rs], adj, np.full(len(rs), float(t)), np.full(len(rs), float(h)), get("mu"), get("target"), get("back"), scored


def _names(p: dict) -> list[tuple[str, tuple]]:
    return [(n, p[n].shape) for n in sorted(p)]


def loss_and_gradients(packed: DataFrame, p: dict[str, np.ndarray], b: Blocks, prior: np.ndarray, dyn_weight: float = 0.5, want_gradient: bool = True) -> tuple[float, float, dict]:
    """(loss sum, rows scored, gradient sums) over packed cohorts."""

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n, g = 0.0, 0.0, {k: np.zeros_like(v) for k, v in p.items()}
        for batch in batches:
            for cohort in batch["cohort"]:
                for _, adj, t, h, mu, target, back, scored in _dense(cohort, b.k):
                    vs = {k: Var(v) for k, v in p.items()}
                    out, dyn = step(vs, b, mu, adj, t, back, prior, h if b.horizon > 1 else None)
                    loss = soft_ce(out, target, scored) + soft_ce(dyn, target, scored) * dyn_weight
                    total, n = total + loss.x.item(), n + scored.sum()
                    if want_gradient:
                        for k, v in gradients(loss, vs).items():
                            g[k] += v
        flat = np.concatenate([g[k].ravel() for k, _ in _names(p)] if want_gradient else [np.zeros(0)])
        yield pd.DataFrame({"i": np.arange(len(flat) + 2), "v": np.concatenate([[total, n], flat])})

    got = {r[0]: r[1] for r in packed.select("cohort").mapInPandas(part, "i int, v double").groupBy("i").agg(F.sum("v")).collect()}
    out, at = {}, 2
    for k, shape in _names(p) if want_gradient else []:
        size = int(np.prod(shape))
        out[k], at = np.array([got.get(at + i, 0.0) for i in range(size)]).reshape(shape), at + size
    return got.get(0, 0.0), got.get(1, 0.0), out


@dataclass
class Training:
    """All that a resumed run needs: parameters, moments, the best so far."""

    p: dict
    m: dict
    v: dict
    best: dict
    steps: int = 0
    epoch: int = 0
    best_loss: float = float("inf")
    waited: int = 0
    losses: tuple = ()

    @classmethod
    def fresh(cls, b: Blocks, seed: int = 7) -> Training:
        p = b.start(seed)
        zero = lambda: {k: np.zeros_like(x) for k, x in p.items()}
        return cls(p, zero(), zero(), {k: x.copy() for k, x in p.items()})

    def dump(self) -> bytes:
        out = io.BytesIO()
        arrays = {f"{part}.{k}": x for part in ("p", "m", "v", "best") for k, x in getattr(self, part).items()}
        np.savez(out, _state=np.array([self.steps, self.epoch, self.best_loss, self.waited]), _losses=np.array(self.losses, float), **arrays)
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> Training:
        z = np.load(io.BytesIO(data), allow_pickle=False)
        part = lambda name: {k.split(".", 1)[1]: z[k] for k in z.files if k.startswith(name + ".")}
        s = z["_state"]
        return cls(part("p"), part("m"), part("v"), part("best"), int(s[0]), int(s[1]), float(s[2]), int(s[3]), tuple(z["_losses"].tolist()))


def adamw(s: Training, g: dict, rate: float, decay: float, clip: float) -> None:
    """One step on mean gradients, clipped by their common norm; biases decay too, as all start near zero."""
    norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
    scale = min(1.0, clip / (norm + EPS))
    s.steps += 1
    for k, x in g.items():
        x = x * scale
        s.m[k] = 0.9 * s.m[k] + 0.1 * x
        s.v[k] = 0.999 * s.v[k] + 0.001 * x * x
        s.p[k] = s.p[k] * (1 - rate * decay) - rate * (s.m[k] / (1 - 0.9**s.steps)) / (np.sqrt(s.v[k] / (1 - 0.999**s.steps)) + 1e-8)


def train(packed: DataFrame, b: Blocks, prior: np.ndarray, validation: DataFrame | None = None, epochs: int = 10, batches: int = 1, rate: float = 0.02, decay: float = 1e-4, clip: float = 1.0, patience: int = 3, seed: int = 7, state: Training | None = None, on_epoch=None) -> Training:
    """Mini-batch training: each epoch deals the origins into so many batches by a seeded hash, one job per batch.

    Stops when patience epochs bring no better validation loss (the training loss without validation rows);
    state.best holds the best parameters. on_epoch gets the state after each epoch, to be kept for a resume:
    a run resumed from it goes on exactly as if never stopped.
    """
    s = state or Training.fresh(b, seed)
    while s.epoch < epochs and s.waited < patience:
        total = n = 0.0
        for i in range(batches):
            rows = packed.where(F.pmod(F.xxhash64(F.col("origin"), F.lit(seed), F.lit(s.epoch)), F.lit(batches)) == i) if batches > 1 else packed
            loss, count, g = loss_and_gradients(rows, s.p, b, prior)
            if count:
                adamw(s, {k: x / count for k, x in g.items()}, rate, decay, clip)
                total, n = total + loss, n + count
        if validation is not None:
            total, n, _ = loss_and_gradients(validation, s.p, b, prior, want_gradient=False)
        now = total / n if n else 0.0
        s.losses, s.epoch = (*s.losses, now), s.epoch + 1
        if now < s.best_loss - 1e-9:
            s.best_loss, s.waited, s.best = now, 0, {k: x.copy() for k, x in s.p.items()}
        else:
            s.waited += 1
        if on_epoch:
            on_epoch(s)
    return s


def forecast(packed: DataFrame, p: dict[str, np.ndarray], b: Blocks, prior: np.ndarray, kind: str = "long") -> DataFrame:
    """(origin, workload, h, state, p) of packed cohorts: every row's horizon directly from its own slot."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vs = {k: Var(v) for k, v in p.items()}
        for batch in batches:
            rows = []
            for origin, cohort in zip(batch["origin"], batch["cohort"]):
                for names, adj, t, h, mu, _, back, _ in _dense(cohort, b.k):
                    if len(adj) > len(names):
                        raise ValueError("rows that stand for several workloads have no forecast by workload: pack_slots(alike=None)")
                    out = step(vs, b, mu, adj, t, back, prior, h if b.horizon > 1 else None)[0].x
                    rows += [(origin, w, int(h[i]), s, float(out[i, s])) for i, w in enumerate(names) for s in range(b.k)]
            yield pd.DataFrame(rows, columns=["origin", "workload", "h", "state", "p"])

    return packed.mapInPandas(run, f"origin long, workload {kind}, h int, state int, p double")


def encoded(p: dict[str, np.ndarray], b: Blocks) -> dict:
    """Parameters and shape as a JSON-ready record."""
    out = io.BytesIO()
    np.savez(out, **p)
    return {"blocks": asdict(b), "parameters": base64.b64encode(out.getvalue()).decode()}


def decoded(record: dict) -> tuple[dict[str, np.ndarray], Blocks]:
    z = np.load(io.BytesIO(base64.b64decode(record["parameters"])), allow_pickle=False)
    return {k: z[k] for k in z.files}, Blocks(**record["blocks"])


def variant(b: Blocks, name: str) -> Blocks:
    """Blocks of an ablation variant; 'hypergraph' and 'vo_markov' change the edges and the back-off that rows bring."""
    changes = {"full": {}, "ns_mem": {"spatial": False}, "dyn_trans": {"dynamic": False}, "multi_hop": {"rounds": 1}, "hypergraph": {}, "vo_markov": {}}
    return replace(b, **changes[name])


def pack_histories(mu: DataFrame, edges: DataFrame, origins: DataFrame, history: int, part: F.Column | None = None) -> DataFrame:
    """(origin, cohort): per origin its workloads with what each showed in the last `history` slots, from (workload, t, mu, state).

    A slot is sent to the origins that may see it, so all joins are on equality. Slots without a state are skipped.
    part, of workload, cuts the workloads of an origin into cohorts, each a row of its own.
    """
    seen = mu.where("state is not null").withColumn("origin", F.explode(F.sequence(F.col("t"), F.col("t") + history - 1)))
    seen = seen.join(origins.select("origin").distinct(), "origin")
    past = seen.groupBy("origin", "workload").agg(F.sort_array(F.collect_list(F.struct("t", "state", "mu"))).alias("past"))
    near = edges.groupBy(F.col("src").alias("workload")).agg(F.sort_array(F.collect_list(F.struct("dst", F.col("weight").cast("double").alias("weight")))).alias("near"))
    rows = past.join(near, "workload", "left").select("origin", (F.lit(0) if part is None else part).alias("part"), F.struct("workload", "past", "near").alias("r"))
    return rows.groupBy("origin", "part").agg(F.sort_array(F.collect_list("r")).alias("cohort")).drop("part")


def roll_out(packed: DataFrame, p: dict[str, np.ndarray], b: Blocks, prior: np.ndarray, horizon: int, order: int = 3, decay: float = 0.02, max_age: float | None = None, hard: bool = False, kind: str = "long") -> DataFrame:
    """(origin, workload, h, state, p): recursive forecasts of packed histories, all workloads of an origin in step.

    Each step's soft answer is the next step's state, its likeliest state extends the context, and the
    answer joins the counts that back-off uses. The graph stays as it is at the origin. hard: first order
    or none, nothing mixed. A cohort is one task's work; its size is a parameter of the experiment.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from .contexts import DecayedContexts

        vs = {k: Var(v) for k, v in p.items()}
        for batch in batches:
            for origin, cohort in zip(batch["origin"], batch["cohort"]):
                names = [r["workload"] for r in cohort]
                at = {w: i for i, w in enumerate(names)}
                adj = np.zeros((len(names), len(names)))
                for i, r in enumerate(cohort):
                    for e in r["near"] if r["near"] is not None else ():
                        if e["dst"] in at and at[e["dst"]] != i:
                            adj[i, at[e["dst"]]] = e["weight"]
                back = DecayedContexts(b.k, order, decay, max_age or np.inf)
                for r in cohort:
                    for x in r["past"]:
                        back.append(r["workload"], x["t"], x["state"], x["mu"])
                mu, rows = np.stack([np.asarray(r["past"][-1]["mu"], float) for r in cohort]), []
                for h in range(1, horizon + 1):
                    now = float(origin + h)
                    answers = np.stack([back.predict(back.context(w, now), now, hard)[0] for w in names])
                    mu = step(vs, b, mu, adj, np.full(len(names), now - 1), answers, prior)[0].x
                    mu = mu / mu.sum(1, keepdims=True)
                    for i, w in enumerate(names):
                        back.append(w, now, int(mu[i].argmax()), mu[i])
                        rows += [(origin, w, h, s, float(mu[i, s])) for s in range(b.k)]
                yield pd.DataFrame(rows, columns=["origin", "workload", "h", "state", "p"])

    return packed.mapInPandas(run, f"origin long, workload {kind}, h int, state int, p double")


def roll_out_whole(mu: DataFrame, home: DataFrame, origins: DataFrame, history: int, p: dict[str, np.ndarray], b: Blocks, prior: np.ndarray, horizon: int, store: Callable, order: int = 3, decay: float = 0.02, max_age: float | None = None, hard: bool = False, folder: str | None = None) -> DataFrame:
    """roll_out over all workloads of each origin, however many: from (workload, t, mu, state) and home (workload, node).

    Workloads of one node are neighbours. A node's total, less a workload's own part, is what its neighbours say, so
    no pairs are made; totals and context counts are summed in Spark over all workloads. Per origin, only sums by
    context and slot reach the driver: their number is bounded by states, order, history and horizon.
    store keeps a step's rows (one row per workload) and ends their lineage. With a folder, a shared one, a step's
    rows go there instead and a log names the origins that have made it, written last: a call that is stopped and
    made again, with the same origins and parameters, goes on after the last step that all origins made.
    """
    from .contexts import DecayedContexts

    spark, kind, k = mu.sparkSession, dict(mu.dtypes)["workload"], b.k
    sums_of = lambda c: F.array(*[F.sum(F.col(c)[i]) for i in range(k)])
    past = pack_histories(mu, spark.createDataFrame([], f"src {kind}, dst {kind}, weight double"), origins, history, F.col("workload")).select("origin", F.col("cohort")[0].alias("r"))
    past = store(past.select("origin", "r.workload", "r.past").join(home.select("workload", "node"), "workload", "left"))
    size = {r[0]: r[1] for r in past.groupBy("origin").count().collect()}
    backs = {o: DecayedContexts(k, order, decay, max_age or np.inf) for o in size}

    def enter(events: DataFrame) -> None:
        """events: (origin, t, before, target), before being up to `order` earlier states."""
        cut = F.transform(F.sequence(F.lit(0), F.size("before")), lambda o: F.slice("before", F.size("before") - o + 1, o))
        for r in events.select("origin", "t", "target", F.explode(cut).alias("ctx")).groupBy("origin", "ctx", "t").agg(sums_of("target").alias("c")).orderBy("origin", "ctx", "t").collect():
            backs[r["origin"]].enter(tuple(r["ctx"]), r["t"], r["c"])

    tail = lambda c, n, upto: F.slice(c, F.greatest(upto - n, F.lit(0)) + 1, F.least(upto, F.lit(n)))
    states = F.transform("past", lambda x: x["state"])
    event = past.withColumn("states", states).select("origin", "states", F.posexplode("past").alias("i", "x"))
    enter(event.select("origin", F.col("x.t").alias("t"), tail("states", order, F.col("i")).alias("before"), F.col("x.mu").alias("target")))
    now = past.select("origin", "workload", "node", tail(states, order, F.size("past")).alias("ctx"), F.element_at("past", -1)["mu"].alias("mu"))
    columns = f"origin long, workload {kind}, node {dict(home.dtypes)['node']}, ctx array<int>, mu array<double>"
    answers = []

    def round_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vs = {n: Var(v) for n, v in p.items()}
        for x in batches:
            if len(x):
                h, deg = np.stack(x["h"].to_numpy()), np.maximum(x["d"].to_numpy(float) - 1, 0).reshape(-1, 1)
                total = np.stack(x["total"].to_numpy())
                near = np.where(deg > 0, (total - h) / np.maximum(deg, 1), 0.0)
                n = x["origin"].map(size).to_numpy(float).reshape(-1, 1)
                x = x.assign(h=list(told(vs, b, var(h), near, deg, n).x))
                yield x[["origin", "workload", "node", "ctx", "mu", "h"]]

    def ended(step_at: int, models):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            vs, memo = {n: Var(v) for n, v in p.items()}, {}
            for x in batches:
                if len(x):
                    then, ctx = x["origin"].to_numpy() + float(step_at), [tuple(c.tolist()) for c in x["ctx"]]
                    for key in set(zip(x["origin"], ctx)):
                        if key not in memo:
                            memo[key] = models.value[key[0]].predict(list(key[1][-order:]) if order else [], float(key[0] + step_at), hard)[0]
                    back, own = np.stack([memo[key] for key in zip(x["origin"], ctx)]), var(np.stack(x["mu"].to_numpy()))
                    moved_on = settled(vs, own, var(np.stack(x["h"].to_numpy()))) if b.spatial else own
                    out = answered(vs, b, moved_on, then - 1, back, prior)[0].x
                    out = out / out.sum(1, keepdims=True)
                    yield x[["origin", "workload", "node"]].assign(ctx=[[*c[max(len(c) - order, 0) :], int(s)] for c, s in zip(ctx, out.argmax(1))], mu=list(out))

        return run

    made = steps_made(spark, folder, size) if folder else 0
    for h in range(1, horizon + 1):
        x = now.withColumn("h", F.col("mu"))
        for _ in range(b.rounds if b.spatial and h > made else 0):
            total = x.where("node is not null").groupBy("origin", "node").agg(F.count(F.lit(1)).alias("d"), sums_of("h").alias("total"))
            x = x.join(total, ["origin", "node"], "left").withColumn("d", F.coalesce("d", F.lit(1))).withColumn("total", F.coalesce("total", "h"))
            x = x.mapInPandas(round_of, f"{columns}, h array<double>")
        if h > made:
            models = spark.sparkContext.broadcast(backs)
            done = x.mapInPandas(ended(h, models), columns)
            if folder:
                done.write.mode("overwrite").parquet(f"{folder}/step={h}")
                spark.createDataFrame([(o, h) for o in sorted(size)], "origin long, step int").coalesce(1).write.mode("append").parquet(f"{folder}/log")
        now = spark.read.schema(columns).parquet(f"{folder}/step={h}") if folder else store(done)
        answers.append(now.select("origin", "workload", F.lit(h).alias("h"), F.posexplode("mu").alias("state", "p")))
        if h < horizon:
            enter(now.select("origin", (F.col("origin") + h).alias("t"), tail("ctx", order, F.size("ctx") - 1).alias("before"), F.col("mu").alias("target")))
    return reduce(DataFrame.unionAll, answers)


def steps_made(spark, folder: str, origins) -> int:
    """The last step that the folder's log names for each of the origins; 0 without a log."""
    try:
        rows = spark.read.schema("origin long, step int").parquet(f"{folder}/log").groupBy("origin").agg(F.max("step").alias("step")).collect()
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return 0
    by = dict(map(tuple, rows))
    return min((by.get(o, 0) for o in origins), default=0)


def roll_out_to(path: str, packed: DataFrame, *args, **options) -> DataFrame:
    """roll_out written under path by origin; origins that an earlier, stopped call finished are not run again.

    The write's commit puts all origins of a call in place or none, so what is there is whole.
    """
    spark = packed.sparkSession
    try:
        done = spark.read.parquet(path).select("origin").distinct()
        packed = packed.join(done, "origin", "left_anti")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
    roll_out(packed, *args, **options).write.mode("append").parquet(path)
    return spark.read.parquet(path)

"""Back-off over physical time as a state that grows: events are appended, aged out, queried, copied and stored."""

from __future__ import annotations

from bisect import insort
from collections import defaultdict

import numpy as np


class DecayedContexts:
    """Soft targets by context of up to `order` earlier states of the same workload, pooled over workloads.

    At time t an event of time s counts exp(-decay * (t - s)) if t - max_age <= s < t. Contexts skip gaps.
    Events may arrive out of order: a late one re-derives the contexts of its workload.
    """

    def __init__(self, k: int, order: int, decay: float, max_age: float, smoothing: float = 1.0, threshold: float = 2.0, temperature: float = 1.0):
        self.k, self.order, self.decay, self.max_age = k, order, decay, max_age
        self.smoothing, self.threshold, self.temperature = smoothing, threshold, temperature
        self.events: dict = defaultdict(list)  # workload -> [(t, state, target)] in order of time
        self.index: dict | None = None
        self.memo: dict = {}  # counts since the last change, by context and time
        self.frozen = False

    def append(self, workload, t: float, state: int, target=None) -> None:
        """target: the soft state, or none for the hard one. Of two events of a workload at one time both stay, by state."""
        if self.frozen:
            raise RuntimeError("a frozen state takes no events")
        soft = tuple(np.eye(self.k)[state]) if target is None else tuple(float(x) for x in target)
        mine, event = self.events[workload], (float(t), int(state), soft)
        late = bool(mine) and event < mine[-1]
        insort(mine, event)
        self.memo = {}
        if late:
            self.index = None
        elif self.index is not None:
            self._enter(mine, len(mine) - 1)

    def enter(self, ctx: tuple, t: float, target) -> None:
        """Targets of one context and time that were summed elsewhere; a state fed so holds no events of its own."""
        self.index, self.memo = self._indexed(), {}
        times, targets = self.index.setdefault(ctx, ([], []))
        times.append(float(t))
        targets.append(tuple(float(x) for x in target))

    def _enter(self, mine: list, i: int) -> None:
        for o in range(min(self.order, i) + 1):
            times, targets = self.index.setdefault(tuple(x[1] for x in mine[i - o : i]), ([], []))
            times.append(mine[i][0])
            targets.append(mine[i][2])

    def _indexed(self) -> dict:
        if self.index is None:
            self.index = {}
            for mine in self.events.values():
                for i in range(len(mine)):
                    self._enter(mine, i)
        return self.index

    def prune(self, now: float) -> None:
        """Drops what no query at now or later can see; the states that contexts of kept events need stay."""
        for mine in self.events.values():
            gone = sum(e[0] < now - self.max_age for e in mine)
            del mine[: max(0, gone - self.order)]
        self.index, self.memo = None, {}

    def freeze(self) -> DecayedContexts:
        self.frozen = True
        return self

    def clone(self) -> DecayedContexts:
        out = DecayedContexts.restored(self.exported())
        out.frozen = False
        return out

    def exported(self) -> dict:
        names = ("k", "order", "decay", "max_age", "smoothing", "threshold", "temperature", "frozen")
        return {n: getattr(self, n) for n in names} | {"events": [[w, list(e)] for w, mine in self.events.items() for e in mine]}

    @classmethod
    def restored(cls, record: dict) -> DecayedContexts:
        rest = {n: v for n, v in record.items() if n not in ("events", "frozen")}
        out = cls(**rest)
        for w, (t, state, target) in record["events"]:
            out.append(w, t, state, target)
        out.frozen = record["frozen"]
        return out

    def context(self, workload, before: float) -> list[int]:
        """The workload's last states before a time, at most `order`."""
        return [e[1] for e in self.events.get(workload, ()) if e[0] < before][-self.order :] if self.order else []

    def counts(self, ctx: tuple, now: float) -> np.ndarray:
        if (ctx, now) not in self.memo:
            self.memo[ctx, now] = self._counted(ctx, now)
        return self.memo[ctx, now]

    def _counted(self, ctx: tuple, now: float) -> np.ndarray:
        times, targets = self._indexed().get(ctx, ((), ()))
        if not times:
            return np.zeros(self.k)
        age = now - np.asarray(times)
        w = np.where((age > 0) & (age <= self.max_age), np.exp(-self.decay * np.maximum(age, 0)), 0.0)
        return w @ np.asarray(targets)

    def predict(self, ctx: list[int], now: float, hard: bool = False) -> tuple[np.ndarray, int]:
        """(distribution, the order that weighs most). hard: the first order if it has support, else order 0, nothing mixed."""
        orders = [self.counts(tuple(ctx[len(ctx) - o :]), now) if o <= len(ctx) else np.zeros(self.k) for o in range(self.order + 1)]
        smooth = [(c + self.smoothing) / (c + self.smoothing).sum() for c in orders]
        if hard:
            o = int(self.order > 0 and orders[1].sum() > 0)
            return smooth[o], o
        left, weights = 1.0, np.zeros(self.order + 1)
        for o in range(self.order, 0, -1):
            n = orders[o].sum()
            g = 1 / (1 + np.exp(-np.clip((n - self.threshold) / self.temperature, -60, 60))) if n > 0 else 0.0
            weights[o], left = left * g, left * (1 - g)
        weights[0] = left
        return weights @ np.stack(smooth) / weights.sum(), int(weights.argmax())

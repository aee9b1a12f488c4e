"""Every query with SQL gives the rows that DuckDB gives, on the smallest tables."""

import os

import pandas as pd
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float) and v == v:
        return round(v, 6) + 0.0
    return None if v is None or v is pd.NA or v != v else v.item() if hasattr(v, "item") else v


def rows(df):
    return sorted(repr(tuple(float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else x for x in map(plain, r))) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(FOLDER):
        pytest.skip("no tables")
    con = duckdb.connect()
    for name in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{FOLDER}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_rows(spark, duck, name):
    got, want = entry.queries()[name](spark, FOLDER).toPandas(), duck.sql(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def sums_to_one(t, keys, value):
    assert len(t) and ((t.groupby(keys)[value].sum() - 1).abs() < 1e-4).all() and t[value].between(0, 1).all()


def forecasts(t):
    """Every workload at every horizon has one distribution over all states."""
    sums_to_one(t, ["origin", "workload", "h"], "p")
    states = t["state"].nunique()
    assert (t.groupby(["origin", "workload", "h"]).size() == states).all() and (t.groupby("workload")["h"].nunique() == t["h"].nunique()).all()


def falling(t, by="epoch", value="loss"):
    x = t.sort_values(by)[value].to_numpy()
    assert len(x) >= 3 and (x[1:] < x[:-1]).all()


def one_way(x, y, band):
    """Least sum over all alignments, by recursion over their ends, with its number of points; up, then left, then diagonal."""
    import functools

    @functools.cache
    def end(i, j):
        if i < 0 or j < 0 or abs(i - j) > band:
            return (0.0, 0) if i == j == -1 else (float("inf"), 0)
        before = [end(i - 1, j), end(i, j - 1), end(i - 1, j - 1)]
        cost, n = before[min(range(3), key=lambda k: before[k][0])]
        return cost + (x[i] - y[j]) ** 2, n + 1

    cost, n = end(len(x) - 1, len(y) - 1)
    return (cost / n) ** 0.5


def series(duck):
    from loomcast.plans.queries import FILL

    t = duck.sql(f"WITH {FILL} SELECT workload, t, cpu_input, mem_input FROM f WHERE input_valid ORDER BY workload, t").df()
    return {w: g for w, g in t.groupby("workload")}


def held(name, check):
    """Queries with SQL of their own, held against plain Python too."""

    def test(spark, duck):
        check(entry.queries()[name](spark, FOLDER).toPandas(), duck)

    return test


def warped(t, duck):
    x = series(duck)
    assert len(t) == len(x) * (len(x) - 1) // 2
    for i, j, d in t.sort_values(["i", "j"]).iloc[::9][["i", "j", "distance"]].itertuples(index=False):
        a, b = x[i]["cpu_input"].tolist(), x[j]["cpu_input"].tolist()
        assert abs(one_way(a, b, max(5, abs(len(a) - len(b)))) - d) < 1e-5


def segments(t, duck):
    """Pieces tile each run; no other cut into pieces of 3 to 8 slots, the first of 1 to 8, costs less."""
    import functools

    import numpy as np

    def cost(p):
        return ((p - p.mean(0)) ** 2).sum() + 0.2 * (((p[-1] - p[0]) / max(len(p) - 1, 1)) ** 2).sum() + 0.05

    checked = 0
    for w, g in series(duck).items():
        mine = t[t["workload"] == w].sort_values("seg_start")
        slots, x = g["t"].to_numpy(), g[["cpu_input", "mem_input"]].to_numpy()
        assert sorted(s for a, b in zip(mine["seg_start"], mine["seg_end"]) for s in range(a, b + 1)) == slots.tolist()
        cuts = [0, *(np.flatnonzero(np.diff(slots) != 1) + 1), len(slots)]
        for a, b in zip(cuts, cuts[1:]):
            y, n = x[a:b], b - a
            if n < 3:
                continue

            @functools.cache
            def least(start, y=y, n=n):
                return 0.0 if start == n else min((cost(y[start:e]) + least(e) for e in range(start + (3 if start else 1), min(start + 8, n) + 1)), default=float("inf"))

            got = [(s - slots[a], e - slots[a] + 1) for s, e in zip(mine["seg_start"], mine["seg_end"]) if slots[a] <= s <= slots[b - 1]]
            assert abs(sum(cost(y[p:q]) for p, q in got) - least(0)) < 1e-9
            checked += 1
    assert checked


test_warped_distances = held("dtw_pairs", warped)
test_segments = held("segment_runs", segments)


def medoids(t, duck):
    """The whole growth of medoids again, by loops over distances from the recursion above."""
    import numpy as np

    x = series(duck)
    ids = sorted(x)
    n = len(ids)
    d = [[0.0] * n for _ in range(n)]
    for i in range(n):
        for j in range(i):
            a, b = x[ids[j]]["cpu_input"].tolist(), x[ids[i]]["cpu_input"].tolist()
            d[i][j] = d[j][i] = round(one_way(a, b, max(5, abs(len(a) - len(b)))), 6)
    radius = max(float(np.quantile([min(d[i][j] for j in range(n) if j != i) for i in range(n)], 0.75)), 1e-3)
    for k in range(1, 9):
        chosen = [int(np.random.default_rng(7 + k).integers(n))]
        while len(chosen) < k:
            chosen.append(max((i for i in range(n) if i not in chosen), key=lambda i: (min(d[i][c] for c in chosen), -i)))
        for _ in range(50):
            own = [min(range(k), key=lambda c: d[i][chosen[c]]) for i in range(n)]
            new = [min((i for i in range(n) if own[i] == c), key=lambda i: (sum(d[i][j] for j in range(n) if own[j] == c), i)) for c in range(k)]
            if new == chosen:
                break
            chosen = new
        own = [min(range(k), key=lambda c: d[i][chosen[c]]) for i in range(n)]
        near = [d[i][chosen[own[i]]] for i in range(n)]
        covered = sum(v <= radius for v in near) / n
        if covered >= 0.9:
            break
    mine = [[near[i] for i in range(n) if own[i] == c] for c in range(k)]
    want = sorted((ids[m], len(v), round(max(float(np.median(v)), float(np.std(v)), 1e-3), 5), round(covered, 6)) for m, v in zip(chosen, mine))
    assert sorted((m, c, round(s, 5), v) for m, c, s, v in t[["medoid", "members", "sigma", "coverage"]].itertuples(index=False)) == want


CHECKS = {
    "recursive_forecast": lambda t, duck: forecasts(t),
    "roll_out": lambda t, duck: forecasts(t),
    "learned_forecast": lambda t, duck: falling(t),
    "gd_transition": lambda t, duck: falling(t),
    "window_membership": lambda t, duck: sums_to_one(t, ["workload", "t"], "mu"),
    "shape_set": medoids,
}


@pytest.mark.parametrize("name", sorted(k for k in set(entry.queries()) - set(entry.oracle_sql()) if not k.startswith("op") and k != "pipeline"))
def test_without_sql(spark, duck, name):
    CHECKS[name](entry.queries()[name](spark, FOLDER).toPandas(), duck)


def test_entry(spark, duck):
    assert entry.entry(spark).count() > 0

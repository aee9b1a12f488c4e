"""Pattern dictionaries: segmentation, warped distances, medoids, centroids, window memberships."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import sqdist


def segment_costs(x: np.ndarray, length: int, trend_weight: float) -> np.ndarray:
    """For each piece of a length, by its start: squared error around its mean plus weighted squared mean slope."""
    pieces = np.lib.stride_tricks.sliding_window_view(x, length, axis=0)
    error = ((pieces - pieces.mean(2, keepdims=True)) ** 2).sum((1, 2))
    slope = (pieces[:, :, -1] - pieces[:, :, 0]) / max(length - 1, 1)
    return error + trend_weight * (slope**2).sum(1)


def segment(x: np.ndarray, shortest: int, longest: int, penalty: float, trend_weight: float = 0.2) -> list[tuple[int, int]]:
    """Pieces [a, b) of least total cost, each shortest..longest long, a penalty each; of equals the shortest last piece.

    Where no such pieces end at a place, one piece of at most longest from the run's start does, however
    short. A run below shortest, or one that nothing fits, stays whole.
    """
    n = len(x)
    if n < shortest:
        return [(0, n)] if n else []
    longest = max(shortest, min(longest, n))
    costs = {k: segment_costs(x, k, trend_weight) for k in range(1, longest + 1)}
    total, last = [0.0], [0]
    for end in range(1, n + 1):
        fits = [(total[end - k] + costs[k][end - k] + penalty, k) for k in range(shortest, min(longest, end) + 1) if last[end - k] is not None]
        cost, k = min(fits) if fits else (costs[end][0] + penalty, end) if end <= longest else (np.inf, None)
        total.append(float(cost))
        last.append(k)
    if last[n] is None:
        return [(0, n)]
    ends = [n]
    while ends[-1]:
        ends.append(ends[-1] - last[ends[-1]])
    return list(zip(ends[:0:-1], ends[-2::-1]))


def segment_runs(slots: DataFrame, channels: list[str], shortest: int, longest: int, penalty: float, trend_weight: float = 0.2) -> DataFrame:
    """(workload, seg_start, seg_end): the pieces that `segment` gives of each workload's active runs, in the JVM.

    A run is one row with an array a channel, as long as the time axis at most. The cheapest last piece at
    every end is a fold over the run that looks back at pieces of shortest..longest slots alone; a second fold
    walks back from the run's end. Costs count to 9 digits, so that the order of additions decides no tie.
    """
    w = Window.partitionBy("workload").orderBy("t")
    rows = slots.select("workload", "t", *[F.col(c).cast("double").alias(c) for c in channels]).withColumn("_run", F.col("t") - F.row_number().over(w))
    runs = rows.groupBy("workload", "_run").agg(F.min("t").alias("first"), F.count(F.lit(1)).cast("int").alias("n"), F.array_sort(F.collect_list(F.struct("t", *channels))).alias("x"))
    of = lambda c: F.transform("x", lambda p: p[c])
    runs = runs.withColumns({f"_{c}": of(c) for c in channels})
    add = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, v: s + v)

    def cost(end, k):
        """Of the k slots before end."""
        out = F.lit(0.0)
        for c in channels:
            v = F.slice(f"_{c}", end - k + 1, k)
            error = F.aggregate(F.transform(F.array(v), lambda v: F.struct(v.alias("v"), (add(v) / k).alias("m"))), F.lit(0.0), lambda s, q: s + F.aggregate(q["v"], F.lit(0.0), lambda e, y: e + (y - q["m"]) * (y - q["m"])))
            slope = (F.get(v, k - 1) - F.get(v, F.lit(0))) / F.greatest(k - 1, F.lit(1))
            out = out + error + F.lit(float(trend_weight)) * slope * slope
        return F.round(out, 9)

    most = F.greatest(F.lit(shortest), F.least(F.lit(longest), F.col("n")))

    def step(acc, end):
        lengths = F.filter(F.sequence(F.lit(shortest), F.greatest(F.least(most, end), F.lit(shortest))), lambda k: (k <= end) & F.get(acc["last"], end - k).isNotNull())
        fits = F.transform(lengths, lambda k: F.struct(F.round(F.get(acc["total"], end - k) + cost(end, k) + penalty, 9).alias("c"), k.alias("k")))
        whole = F.when(end <= most, F.struct(F.round(cost(end, end) + penalty, 9).alias("c"), end.alias("k")))
        best = F.coalesce(F.array_min(fits), whole)
        return F.struct(F.concat(acc["total"], F.array(best["c"])).alias("total"), F.concat(acc["last"], F.array(best["k"])).alias("last"))

    start = F.struct(F.array(F.lit(0.0)).alias("total"), F.array(F.lit(0)).alias("last"))
    runs = runs.withColumn("last", F.when(F.col("n") >= shortest, F.aggregate(F.sequence(F.lit(1), F.col("n")), start, step, lambda acc: acc["last"])))
    back = F.aggregate("last", F.struct(F.col("n").alias("end"), F.array().cast("array<struct<a:int,b:int>>").alias("cuts")), lambda acc, _: F.when(acc["end"] > 0, F.struct((acc["end"] - F.get("last", acc["end"])).alias("end"), F.concat(acc["cuts"], F.array(F.struct((acc["end"] - F.get("last", acc["end"])).alias("a"), acc["end"].alias("b")))).alias("cuts"))).otherwise(acc), lambda acc: acc["cuts"])
    one = F.array(F.struct(F.lit(0).alias("a"), F.col("n").alias("b")))
    pieces = F.when(F.get("last", F.col("n")).isNull(), one).otherwise(back)
    return runs.select("workload", "first", F.explode(pieces).alias("p")).select("workload", (F.col("first") + F.col("p.a")).cast("long").alias("seg_start"), (F.col("first") + F.col("p.b") - 1).cast("long").alias("seg_end"))


def dtw(a: np.ndarray, b: np.ndarray, weights: np.ndarray | None = None, window: int | None = None, normalize: bool = True) -> float:
    """dtw_batch of one pair."""
    return float(dtw_batch([np.asarray(a, float)], [np.asarray(b, float)], window, weights, normalize)[0])


def dtw_batch(a: list, b: list, window: int | None = None, weights: np.ndarray | None = None, normalize: bool = True) -> np.ndarray:
    """Warped distances of many pairs of series, of one channel or several, at once: the cheapest alignment's sum of
    squared weighted differences, divided by the number of aligned points, rooted.

    Points further apart than a pair's band, window or the difference of its lengths, are not aligned. Of equal
    alignments the one that repeats a point of b is taken, then one that repeats a point of a. Three diagonals
    of cells are held, all pairs side by side; cells outside every band are not computed.
    """
    n, m = np.array([len(x) for x in a]), np.array([len(x) for x in b])

    def pad(xs: list, size: int) -> np.ndarray:
        wide = [np.asarray(x, float).reshape(len(x), -1) for x in xs]
        out = np.zeros((size, len(xs), wide[0].shape[1]))
        for i, x in enumerate(wide):
            out[: len(x), i] = x
        return out

    x, y = pad(a, n.max()), pad(b, m.max())
    if weights is not None:
        x, y = x * np.asarray(weights, float), y * np.asarray(weights, float)
    band = np.maximum(n, m) if window is None else np.maximum(window, np.abs(n - m))
    reach, alike = int(band.max()), bool((band == band[0]).all())
    rows, columns = len(x), len(y)
    out, points = np.full(len(a), np.inf), np.ones(len(a), int)
    cost, count = np.full((3, rows + 1, len(a)), np.inf), np.zeros((3, rows + 1, len(a)), np.int32)
    cost[0, 0] = 0.0
    for d in range(2, rows + columns + 1):  # cells (i, d - i); up and left lie on the diagonal before, the third on the one before that
        now, last, third = d % 3, (d - 1) % 3, (d - 2) % 3
        cost[now] = np.inf
        lo, hi = max(1, d - columns, -((reach - d) // 2)), min(rows, d - 1, (d + reach) // 2)
        if lo <= hi:
            near = ((x[lo - 1 : hi] - y[d - hi - 1 : d - lo][::-1]) ** 2).sum(2)
            best, steps = cost[last, lo - 1 : hi], count[last, lo - 1 : hi]
            for other, its in ((cost[last, lo : hi + 1], count[last, lo : hi + 1]), (cost[third, lo - 1 : hi], count[third, lo - 1 : hi])):
                better = other < best
                best, steps = np.where(better, other, best), np.where(better, its, steps)
            best = best + near
            if not alike:
                best[np.abs(2 * np.arange(lo, hi + 1) - d)[:, None] > band] = np.inf
            cost[now, lo : hi + 1], count[now, lo : hi + 1] = best, steps + 1
        ends = np.flatnonzero(n + m == d)
        out[ends], points[ends] = cost[now, n[ends], ends], count[now, n[ends], ends]
    return np.sqrt(out / points if normalize else out)


def pairwise_dtw(items: DataFrame, window: int | None = 5, at_once: int = 512, weights: list[float] | None = None) -> DataFrame:
    """(i, j, distance) for i < j of (id, series array<double>). Meant for candidate sets of a stated, small size (hundreds)."""

    @F.pandas_udf("double")
    def distance(x: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in x:
            parts = [dtw_batch(a[i : i + at_once].tolist(), b[i : i + at_once].tolist(), window, weights) for i in range(0, len(a), at_once)]
            yield pd.Series(np.concatenate(parts) if parts else [], dtype=float)

    ids = items.agg(F.sort_array(F.collect_list("id")).alias("ids"))
    left = items.join(F.broadcast(ids), how="cross").select(F.col("id").alias("i"), F.col("series").alias("a"), F.explode("ids").alias("j")).where("i < j")
    return left.join(items.select(F.col("id").alias("j"), F.col("series").alias("b")), "j").select("i", "j", distance("a", "b").alias("distance"))


#: Pairs of series that are aligned at once.
AT_ONCE = 2048


def warped_bounds(x: list, y: list, window: int) -> np.ndarray:
    """For each of x and each of y a number that their warped distance does not undercut, from envelopes.

    Every point is aligned with some point of the other series at most a band away, so it costs at least its
    distance from the least and greatest of these; an alignment has at most as many points as both series
    less one. The better of both directions counts.
    """

    def padded(items: list) -> tuple[np.ndarray, np.ndarray]:
        n = np.array([len(i) for i in items])
        return np.stack([np.pad(np.asarray(i, float), (0, n.max() - len(i)), constant_values=np.nan) for i in items]), n

    def one(a: np.ndarray, n: np.ndarray, b: np.ndarray, m: np.ndarray) -> np.ndarray:
        out = np.zeros((len(a), len(b)))
        for gap in np.unique(np.abs(n[:, None] - m[None, :])):
            band, rows = max(window, int(gap)), np.abs(n[:, None] - m[None, :]) == gap
            wide = np.pad(b, ((0, 0), (band, band + max(0, a.shape[1] - b.shape[1]))), constant_values=np.nan)
            near = np.lib.stride_tricks.sliding_window_view(wide, 2 * band + 1, axis=1)[:, : a.shape[1]]
            low, high = np.fmin.reduce(near, axis=2), np.fmax.reduce(near, axis=2)
            for i in np.flatnonzero(rows.any(1)):
                at = np.flatnonzero(rows[i])
                off = np.fmax(np.fmax(a[i] - high[at], low[at] - a[i]), 0.0)
                out[i, at] = np.nansum(off * off, axis=1)
        return out

    (a, n), (b, m) = padded(x), padded(y)
    cost = np.maximum(one(a, n, b, m), one(b, m, a, n).T)
    return np.sqrt(cost / (n[:, None] + m[None, :] - 1))


#: Series of two lists that meet at once; the share of pairs left below which the others leave the tables.
TILE, KEEP = (64, 128), 0.3
#: Series of a block at most; so many blocks at least, where there are series enough.
MOST, SPREAD = 4096, 16


def maybe_within(x: np.ndarray, y: np.ndarray, most: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (p, q) of the pairs of x (A, n) and y (B, m) whose warped distance may be at most `most` (A, B), to 6 digits; all others are above it.

    An alignment's mean cost is at most a bound where its costs, each less the bound, sum to at most 0. The least
    such sum over all alignments is found diagonal by diagonal as in dtw_batch, in single precision with room for
    what that rounds. A pair leaves as soon as the points still to come cannot bring its sum back to 0.
    """
    n, m = x.shape[1], y.shape[1]
    size = max(np.abs(x).max(), np.abs(y).max()) or 1.0
    u, v = (x.T / size).astype(np.float32), (y.T / size).astype(np.float32)
    bound = np.minimum((most.ravel() + 1e-6) / size, 2.0) ** 2  # no two points are further apart than 2
    room = (1e-6 * (n + m) * (np.sqrt(bound) + bound * (n + m)) + 1e-12).astype(np.float32)
    bound, reach, pairs = bound.astype(np.float32), max(window, abs(n - m)), None
    sums = np.empty((3, n + 2, most.size), np.float32)
    sums[:, :3] = np.inf
    sums[0, 0] = 0.0
    for d in range(2, n + m + 1):
        now, last, third = sums[d % 3], sums[(d - 1) % 3], sums[(d - 2) % 3]
        lo, hi = max(1, d - m, -((reach - d) // 2)), min(n, d - 1, (d + reach) // 2)
        if lo > hi:  # only where no two neighbours are aligned: every other diagonal is empty
            now[:] = np.inf
            continue
        cells, a, b = now[lo : hi + 1], u[lo - 1 : hi], v[d - hi - 1 : d - lo][::-1]
        if pairs is None:
            np.subtract(a[:, :, None], b[:, None, :], out=cells.reshape(len(a), *most.shape))
        else:
            np.subtract(a, b, out=cells)
        cells *= cells
        cells -= bound
        best = np.minimum(last[lo - 1 : hi], last[lo : hi + 1])
        cells += np.minimum(best, third[lo - 1 : hi], out=best)
        now[lo - 1] = now[hi + 1] = np.inf
        if d % 4 == 0 and d < n + m:
            low = np.minimum(cells.min(0), last[lo - 1 : hi + 2].min(0))
            alive = np.flatnonzero(low <= room + bound * (n + m - d + 1))
            if len(alive) < KEEP * len(low):
                u, v = (u[:, alive // most.shape[1]], v[:, alive % most.shape[1]]) if pairs is None else (u[:, alive], v[:, alive])
                pairs, bound, room = alive if pairs is None else pairs[alive], bound[alive], room[alive]
                left = np.empty((3, n + 2, len(alive)), np.float32)
                for k in (d % 3, (d - 1) % 3):  # nothing else of the table is looked at again
                    left[k, lo - 1 : hi + 2] = sums[k, lo - 1 : hi + 2].take(alive, axis=1)
                sums = left
                if not len(pairs):
                    break
    ends = np.flatnonzero(sums[(n + m) % 3, n] <= room) if pairs is None or len(pairs) else np.zeros(0, int)
    return np.divmod(ends if pairs is None else pairs[ends], most.shape[1])


def nearest_warped(items: DataFrame, store: Callable[[DataFrame], DataFrame], window: int = 5, block: int = 256, first: int = 4) -> DataFrame:
    """(id, nearest, distance): of each of (id, series array<double>) the other one at the least warped distance.

    Exact over all items, of equal distances (to 6 digits) the least id. Items lie in blocks by length, copies of a
    series together unless they are very many. In its own block an item is aligned with the few of a part of it that are cheapest to align, then with all that may be nearer
    than the nearest so far. Then every two blocks meet in a task of their own, with what both have found: pairs that
    maybe_within rules out are not aligned. A block's size is block, for more than SPREAD blocks a SPREADth of the
    items, and MOST at most. Null or empty series and those that hold nulls or no finite numbers are no items, a single
    item has no nearest.
    """
    kind = dict(items.dtypes)["id"]
    finite = F.forall("series", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = items.where((F.size("series") > 0) & finite).select("id", "series", F.size("series").alias("n"))
    lengths = sorted((r["n"], r["count"]) for r in rows.groupBy("n").count().collect())
    total = sum(c for _, c in lengths)
    blocks = max(1, -(-total // MOST), min(-(-total // block), SPREAD))
    before = {n: at for (n, _), at in zip(lengths, np.cumsum([0, *(c for _, c in lengths)]).tolist())}
    starts = F.create_map(*[F.lit(x) for n, c in lengths for x in (n, before[n] / total)]) if lengths else F.lit(None)
    shares = F.create_map(*[F.lit(x) for n, c in lengths for x in (n, c / total)]) if lengths else F.lit(None)
    if not lengths:
        return rows.select("id", F.col("id").alias("nearest"), F.lit(0.0).alias("distance"))
    rows = rows.withColumn("h", F.xxhash64(F.transform("series", lambda v: F.round(v, 6))))
    common = rows.groupBy("h").count().where(F.col("count") > MOST // 8).select("h", F.lit(True).alias("common"))
    rows = rows.join(F.broadcast(common), "h", "left").withColumn("h", F.when(F.col("common"), F.xxhash64("id")).otherwise(F.col("h")))
    place = starts[F.col("n")] + shares[F.col("n")] * F.pmod("h", F.lit(1 << 20)) / float(1 << 20)
    rows = store(rows.select("id", "series", F.least(F.floor(place * blocks), F.lit(blocks - 1)).cast("int").alias("b")))

    def align(pairs: list, ids: list, xs: list) -> np.ndarray:
        """Distances of pairs of places, each from the lesser id to the greater, to 6 digits."""
        out = []
        for at in range(0, len(pairs), AT_ONCE):
            ordered = [(p, q) if ids[p] < ids[q] else (q, p) for p, q in pairs[at : at + AT_ONCE]]
            out.append(dtw_batch([xs[p] for p, _ in ordered], [xs[q] for _, q in ordered], window))
        return np.array([round(float(v), 6) for d in out for v in d])

    def search(ids: list, xs: list, most: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple]:
        """(id, nearest, distance) between left and right, or within left where they are the same; most is what each item has already, and is kept up."""
        found: list[tuple] = [(np.inf, None)] * len(ids)
        n, alike = np.array([len(x) for x in xs]), left is right

        def take(pairs: list) -> None:
            for (a, b), d in zip(pairs, align(pairs, ids, xs).tolist()):
                for own, other in ((a, b), (b, a)):
                    if found[own][1] is None or (d, ids[other]) < found[own]:
                        found[own] = (d, ids[other])
                    most[own] = min(most[own], d)

        groups = lambda at: [at[n[at] == k] for k in np.unique(n[at])]
        table = {int(k): np.stack([xs[i] for i in np.flatnonzero(n == k)]) for k in np.unique(n)}
        place = np.zeros(len(xs), int)
        for k in table:
            place[n == k] = np.arange(len(table[k]))
        of = lambda at: table[int(n[at[0]])][place[at]]
        if alike:  # without a distance nothing can be ruled out
            few = left[:: max(1, len(left) // TILE[1])][: TILE[1]]
            for g in groups(left):
                for at in range(0, len(g), TILE[0]):
                    a = g[at : at + TILE[0]]
                    near = np.concatenate([cheapest(of(a), of(c), window) for c in groups(few)], axis=1)
                    order = np.concatenate(groups(few))
                    near[a[:, None] == order[None, :]] = np.inf
                    picks = np.argsort(near, axis=1, kind="stable")[:, :first]
                    take([(int(i), int(order[k])) for r, i in enumerate(a) for k in picks[r] if order[k] != i])
        for g in groups(left):
            for at in range(0, len(g), TILE[0]):
                a, pairs = g[at : at + TILE[0]], []
                for h in groups(right):
                    h = h[h > a[0]] if alike else h
                    for start in range(0, len(h), TILE[1]):
                        c = h[start : start + TILE[1]]
                        if len(a) * len(c) < 64:
                            p, q = np.divmod(np.arange(len(a) * len(c)), len(c))
                        else:
                            p, q = maybe_within(of(a), of(c), np.maximum(most[a][:, None], most[c][None, :]), window)
                        p, q = a[p], c[q]
                        pairs += list(zip(*(x[p < q].tolist() for x in (p, q)))) if alike else list(zip(p.tolist(), q.tolist()))
                take(pairs)
        return [(ids[k], other, d) for k, (d, other) in enumerate(found) if other is not None]

    def alone(g: pd.DataFrame) -> pd.DataFrame:
        at = np.arange(len(g))
        out = search(g["id"].tolist(), [np.asarray(v, float) for v in g["series"]], np.full(len(g), np.inf), at, at)
        return pd.DataFrame(out, columns=["id", "nearest", "distance"])

    def meet(g: pd.DataFrame) -> pd.DataFrame:
        left, right = (np.flatnonzero(g["b"] == int(g[k].iloc[0])) for k in ("i", "j"))
        out = search(g["id"].tolist(), [np.asarray(v, float) for v in g["series"]], g["most"].to_numpy(float).copy(), left, right) if len(left) and len(right) else []
        return pd.DataFrame(out, columns=["id", "nearest", "distance"])

    schema = f"id {kind}, nearest {kind}, distance double"
    own = store(rows.repartition(min(blocks, 8192), "b").groupBy("b").applyInPandas(alone, schema))
    ends = rows.join(own.select("id", F.col("distance").alias("most")), "id", "left").withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).where("b <> o")
    ends = ends.select("id", "series", F.coalesce("most", F.lit(float("inf"))).alias("most"), "b", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"))
    tasks = min(blocks * blocks, 8192)  # a named number: little data, much work, so small shuffles must not be merged
    met = own.unionByName(ends.repartition(tasks, "i", "j").groupBy("i", "j").applyInPandas(meet, schema))
    return met.groupBy("id").agg(F.min(F.struct("distance", "nearest")).alias("m")).select("id", "m.nearest", "m.distance")


def cheapest(x: np.ndarray, y: np.ndarray, window: int) -> np.ndarray:
    """(A, B): the warped distance of each of x (A, n) and each of y (B, m), about."""
    p, q = np.divmod(np.arange(len(x) * len(y)), len(y))
    return dtw_batch(list(x[p]), list(y[q]), window).reshape(len(x), len(y))


def spread_windows(windows: DataFrame, k: int, points: int, store: Callable[[DataFrame], DataFrame], window: int = 5) -> list[tuple]:
    """(id, series) of k windows of (id, series array<double>) that lie far apart by warped distance, over all windows.

    Windows are resampled to equal length. The first is drawn by the digest of its id, each further one is the
    farthest from those before, of equals (to 9 digits) the least id; windows that repeat a chosen one are taken only
    when no others are left. A round aligns every window with the last choice alone and stores how near it now is.
    """
    kind = dict(windows.dtypes)["id"]
    x = store(windows.where(F.size("series") > 0).select("id", resampled(F.col("series"), points).alias("series"), F.lit(float("inf")).alias("near")))
    first = x.orderBy(F.md5(F.col("id").cast("string").cast("binary")), "id").select("id", "series").first()
    chosen = [(first["id"], list(first["series"]))] if first else []
    while first and len(chosen) < k:
        last = np.array(chosen[-1][1], float)

        def nearer(batches: Iterator[pd.DataFrame], last=last) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b):
                    d = np.round(dtw_batch([np.asarray(v, float) for v in b["series"]], [last] * len(b), window), 9)
                    yield b.assign(near=np.minimum(b["near"], d))

        x = store(x.mapInPandas(nearer, f"id {kind}, series array<double>, near double"))
        far = x.where(~F.col("id").isin([i for i, _ in chosen])).agg(F.min_by(F.struct("id", "series"), F.struct(-F.col("near"), F.col("id"))).alias("p")).first()["p"]
        if far is None:
            break
        chosen.append((far["id"], list(far["series"])))
    return chosen


def resampled(series: Column, points: int) -> Column:
    """The series at evenly spaced places from its first to its last point, linearly between them."""
    n = F.size(series) - 1

    def at(i):
        place = i * n / F.lit(float(max(points - 1, 1)))
        low = F.floor(place).cast("int")
        share = place - low
        return F.get(series, low) * (1 - share) + F.get(series, F.least(low + 1, n)) * share

    return F.transform(F.sequence(F.lit(0), F.lit(points - 1)), at)


def k_medoids(d: np.ndarray, k: int, seed: int = 7, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """(medoids, assignment) of a full distance matrix: farthest-first seeds, none twice, then alternate until nothing moves."""
    n = len(d)
    if k >= n:
        return np.arange(n), np.arange(n)
    medoids = [int(np.random.default_rng(seed).integers(n))]
    while len(medoids) < k:
        near = d[:, medoids].min(1)
        near[medoids] = -1.0  # whatever is chosen is not chosen again, nor where all others repeat it
        medoids.append(int(near.argmax()))
    medoids = np.array(medoids)
    for _ in range(rounds):
        own = d[:, medoids].argmin(1)
        new = medoids.copy()
        for c in range(k):
            mine = np.flatnonzero(own == c)
            if len(mine):
                new[c] = mine[d[np.ix_(mine, mine)].sum(1).argmin()]
            else:
                far = d[:, medoids].min(1)
                far[medoids] = far[new] = -1.0
                new[c] = far.argmax()
        if (new == medoids).all():
            break
        medoids = new
    return medoids, d[:, medoids].argmin(1)


def coverage_radius(d: np.ndarray, most: int = 120, seed: int = 7) -> float:
    """The upper quartile of nearest-neighbour distances among at most `most` items drawn by seed, at least 1e-3; 1 for a single item."""
    if len(d) < 2:
        return 1.0
    if len(d) > most:
        drawn = np.random.default_rng(seed).choice(len(d), most, replace=False)
        d = d[np.ix_(drawn, drawn)]
    near = np.where(np.eye(len(d), dtype=bool), np.inf, d).min(1)
    return max(float(np.quantile(near, 0.75)), 1e-3)


def shape_set(d: np.ndarray, threshold: float = 0.9, most: int = 8, seed: int = 7) -> dict:
    """Medoids, more of them until the share of items within the radius reaches the threshold; a medoid that no item chooses has the radius as its sigma."""
    radius, n = coverage_radius(d, seed=seed), len(d)
    for k in range(1, min(most, n) + 1):
        medoids, own = k_medoids(d, k, seed + k)
        near = d[np.arange(n), medoids[own]]
        covered = float((near <= radius).mean())
        if covered >= threshold:
            break
    spread = lambda x: max(float(np.median(x)), float(x.std()), 1e-3) if len(x) else max(radius, 1e-3)
    sigma = [spread(near[own == c]) for c in range(len(medoids))]
    return {"medoids": medoids, "assignment": own, "coverage": covered, "radius": radius, "sigma": sigma}


def farthest_points(d: np.ndarray, k: int) -> list[int]:
    """k items of a distance matrix, each the farthest from those before; the first is nearest to the middle of all.

    Items that repeat a chosen one are taken only when no others are left.
    """
    if not len(d):
        return []
    chosen = [int(d.sum(1).argmin())]
    while len(chosen) < min(k, len(d)):
        near = d[:, chosen].min(1)
        near[chosen] = -1.0
        chosen.append(int(near.argmax()))
    return chosen


def spread_out(points: DataFrame, k: int) -> list[tuple]:
    """(id, x) of k points of (id, x array<double>) that lie far apart, over all points however many.

    The first is the one nearest to all others by the sum of squared distances, which two sums over the table
    give; each further one is the farthest from those before. Of equals the least id counts; points that
    repeat a chosen one are taken only when no others are left. A round is one pass, the driver holds k points.
    """
    sums = points.select(F.posexplode("x").alias("pos", "v")).groupBy("pos").agg(F.sum("v").alias("s")).orderBy("pos").collect()
    n = points.count()
    if not n:
        return []
    middle = F.array(*[F.lit(r.s / n) for r in sums])
    first = points.agg(F.min_by(F.struct("id", "x"), F.struct(F.round(sqdist(F.col("x"), middle), 12), F.col("id"))).alias("p")).first()["p"]
    chosen = [(first["id"], list(first["x"]))]
    while len(chosen) < min(k, n):
        known = F.array(*[F.array(*map(F.lit, x)) for _, x in chosen])
        near = F.array_min(F.transform(known, lambda c: F.round(sqdist(F.col("x"), c) / F.size("x"), 12)))
        rest = points.where(~F.col("id").isin([i for i, _ in chosen]))
        far = rest.agg(F.min_by(F.struct("id", "x"), F.struct(-near, F.col("id"))).alias("p")).first()["p"]
        chosen.append((far["id"], list(far["x"])))
    return chosen


def window_prototypes(windows: list[np.ndarray], k: int, points: int, window: int = 5) -> np.ndarray:
    """k x points x channels: windows resampled to equal length, spread out by warped distance. For a bounded candidate set."""
    x = [resample(w, points) for w in windows if len(w)]
    d = np.stack([dtw_batch([a] * len(x), x, window) for a in x])
    picked = farthest_points(d, k)
    return np.stack([x[picked[i % len(picked)]] for i in range(k)])


def slot_prototypes(slots: np.ndarray, k: int, points: int) -> np.ndarray:
    """k x points x channels: single slots spread out by mean squared distance, each repeated along the prototype."""
    d = ((slots[:, None, :] - slots[None, :, :]) ** 2).mean(2)
    picked = farthest_points(d, k)
    return np.stack([np.repeat(slots[picked[i % len(picked)]][None, :], points, 0) for i in range(k)])


def assign(points: DataFrame, centroids: DataFrame) -> DataFrame:
    """(id, state, d2): the nearest centroid, of equals the first. centroids (state, c) is a model of K rows; it goes as one array."""
    model = centroids.agg(F.sort_array(F.collect_list(F.struct("state", "c"))).alias("m"))
    near = F.array_min(F.transform("m", lambda s: F.struct(sqdist(F.col("x"), s["c"]).alias("d2"), s["state"].alias("state"))))
    return points.join(F.broadcast(model), how="cross").select("id", "x", near.alias("n")).select("id", "x", F.col("n.state").alias("state"), F.col("n.d2").alias("d2"))


def seed_centroids(points: DataFrame, k: int, seed: int = 7) -> DataFrame:
    """(state, c): k points, each drawn with odds in proportion to its squared distance from those before it.

    A point's draw is an exponential wait by a hash of its id, divided by its distance: the least wait
    wins, so that a seed is one aggregation and a rerun draws the same. Fewer distinct points: all of them.
    """
    spark, chosen = points.sparkSession, []
    for i in range(k):
        u = (F.pmod(F.xxhash64(F.lit(seed), F.lit(i), "id"), F.lit(2**52)).cast("double") + 0.5) / float(2**52)
        if chosen:
            model = F.array(*[F.array(*map(F.lit, c)) for c in chosen])
            d2 = F.array_min(F.transform(model, lambda c: sqdist(F.col("x"), c)))
        else:
            d2 = F.lit(1.0)
        r = points.withColumn("_d2", d2).where("_d2 > 0").agg(F.min_by("x", F.struct(-F.ln(u) / F.col("_d2"), F.col("id"))).alias("x")).first()
        if r["x"] is None:
            break
        chosen.append([float(v) for v in r["x"]])
    return spark.createDataFrame([(i, c) for i, c in enumerate(chosen)], "state long, c array<double>")


def ordered_centroids(c: DataFrame) -> DataFrame:
    """The centroids (K rows) renumbered by their coordinates, the first coordinate first."""
    every = c.agg(F.array_sort(F.collect_list("c")).alias("m"))
    return every.select(F.posexplode("m").alias("state", "c")).select(F.col("state").cast("long").alias("state"), "c")


def k_means(points: DataFrame, seeds: DataFrame, rounds: int, store: Callable | None = None, least_shift: float = 1e-6) -> DataFrame:
    """Lloyd's rounds over (id, x array<double>) from seeds (state, c), K rows: each is one aggregation.

    An empty cluster gets the point farthest from its centroid, several of them different points. Rounds
    end early when no coordinate moves by least_shift or more.
    """
    c = seeds
    for _ in range(rounds):
        near = assign(points, c)
        parts = near.select("state", F.posexplode("x")).groupBy("state", "pos").agg(F.avg("col").alias("v"))
        new = parts.groupBy("state").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "v"))), lambda s: s["v"]).alias("n"))
        rows = c.join(new, "state", "left").select("state", "c", "n").collect()  # K rows, the model
        empty = sorted(r["state"] for r in rows if r["n"] is None)
        far = near.groupBy("x").agg(F.max("d2").alias("d2"), F.min("id").alias("id")).orderBy(F.desc("d2"), "id").limit(len(empty)).collect() if empty else []
        other = dict(zip(empty, (r["x"] for r in far)))
        made = [(r["state"], list(r["n"] or other.get(r["state"], r["c"]))) for r in rows]
        shift = max((abs(p - q) for r, (_, n) in zip(rows, made) for p, q in zip(r["c"], n)), default=0.0)
        c = points.sparkSession.createDataFrame(made, c.schema)
        c = store(c) if store else c
        if shift < least_shift:
            break
    return c


def membership_scale(assigned: DataFrame, floor: float = 0.1) -> DataFrame:
    """The root of the median positive squared distance, at least floor."""
    return assigned.where("d2 > 1e-12").agg(F.greatest(F.sqrt(F.percentile("d2", F.lit(0.5))), F.lit(floor)).alias("scale"))


def resample(x: np.ndarray, points: int) -> np.ndarray:
    """Linear, ends aligned."""
    if len(x) == 1:
        return np.repeat(x, points, 0)
    at = np.linspace(0, len(x) - 1, points)
    lo = np.minimum(at.astype(int), len(x) - 2)
    f = (at - lo)[:, None]
    return x[lo] * (1 - f) + x[lo + 1] * f


def by_rows(slots: DataFrame, rows: int = 50_000) -> DataFrame:
    """The slots grouped by ranges of a hash of the workload: a group is about so many rows, or one workload where that has more."""
    groups = max(slots.sparkSession.sparkContext.defaultParallelism, slots.count() // rows + 1)
    return slots.groupBy(F.pmod(F.xxhash64("workload"), F.lit(groups)).alias("_group"))


def _starts(pdf: pd.DataFrame) -> np.ndarray:
    """For each row of a frame sorted by workload, the first row of its workload."""
    w = pdf["workload"].to_numpy()
    new = np.flatnonzero(np.append(True, w[1:] != w[:-1])) if len(w) else np.zeros(0, int)
    return np.repeat(new, np.diff(np.append(new, len(w))))


def window_memberships(slots: DataFrame, channels: list[str], prototypes: np.ndarray, length: int, tau: float = 0.25, sigma: float = 1.0) -> DataFrame:
    """(workload, t, mu): the last length slots, those valid resampled to the prototypes' points, softmax(-mse / (2 sigma^2) / tau).

    prototypes is K x points x channels, a bounded model. A window without valid slots counts as zeros.
    Windows with the same number of valid slots are resampled together.
    """
    k, points = prototypes.shape[:2]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["workload", "t"], kind="stable")
        x, ok, first = pdf[channels].to_numpy(float), pdf["input_valid"].to_numpy(bool), _starts(pdf)
        valid, before = np.flatnonzero(ok), np.append(0, np.cumsum(ok))
        lo, hi = before[np.maximum(first, np.arange(len(x)) - length + 1)], before[1:]
        y = np.zeros((len(x), points, len(channels)))
        for n in np.unique(hi - lo):
            mine = np.flatnonzero(hi - lo == n)
            if n:
                at = np.linspace(0, n - 1, points)
                low = np.minimum(at.astype(int), max(n - 2, 0))
                high, f = np.minimum(low + 1, n - 1), (at - low)[None, :, None]
                v = x[valid[lo[mine][:, None] + np.arange(n)]]
                y[mine] = v[:, low] * (1 - f) + v[:, high] * f
        z = np.stack([-((y - prototypes[c]) ** 2).mean((1, 2)) for c in range(k)], 1) / (2 * sigma * sigma) / tau
        e = np.exp(z - z.max(1, keepdims=True))
        return pd.DataFrame({"workload": pdf["workload"], "t": pdf["t"], "mu": list(e / e.sum(1, keepdims=True))})

    return by_rows(slots).applyInPandas(run, f"workload {dict(slots.dtypes)['workload']}, t long, mu array<double>")


def warped_memberships(slots: DataFrame, channels: list[str], prototypes: list[np.ndarray], sigma: list[float], window: int | None = 5, at_once: int = 8192) -> DataFrame:
    """(workload, t, mu) of valid slots: a Gaussian of the warped distance between each prototype and as many of the
    workload's last valid slots as it has points, divided by the sum; without mass uniform. Windows of many workloads
    are warped at once."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf[pdf["input_valid"].astype(bool)].sort_values(["workload", "t"], kind="stable")
        x, mu, first = pdf[channels].to_numpy(float), np.zeros((len(pdf), len(prototypes))), _starts(pdf)
        for c, p in enumerate(prototypes):
            lo = np.maximum(first, np.arange(len(x)) - len(p) + 1)
            order = np.argsort(lo - np.arange(len(x)), kind="stable")  # windows of one length together
            for at in range(0, len(x), at_once):
                some = order[at : at + at_once]
                d = dtw_batch([x[lo[i] : i + 1] for i in some], [p] * len(some), window)
                mu[some, c] = np.exp(-(d**2) / (2 * sigma[c] ** 2))
        mass = mu.sum(1, keepdims=True)
        mu = np.where(mass > 1e-12, mu / np.maximum(mass, 1e-12), 1 / len(prototypes))
        return pd.DataFrame({"workload": pdf["workload"], "t": pdf["t"], "mu": list(mu)})

    return by_rows(slots).applyInPandas(run, f"workload {dict(slots.dtypes)['workload']}, t long, mu array<double>")

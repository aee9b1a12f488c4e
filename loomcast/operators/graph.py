"""Co-location graphs: incidence, overlaps, hypergraph weights, modulation, links, coverage."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import EPS, affine, bipolar, dot, einstein, sigmoid, softmax
from .components import components
from .joins import BROADCAST_BYTES, measured, unique_join
from .ranges import numbered


def incidence(pairs: DataFrame) -> DataFrame:
    """Distinct (workload, node)."""
    return pairs.select("workload", "node").dropna().distinct()


def normalized_incidence(dep: DataFrame) -> DataFrame:
    return dep.withColumn("weight", 1.0 / F.count(F.lit(1)).over(Window.partitionBy("workload")))


def _pairs(dep: DataFrame) -> DataFrame:
    """Ordered pairs of workloads on a node; both sides are keyed by node, so it is one equi-join."""
    other = dep.select(F.col("workload").alias("dst"), "node")
    return dep.select(F.col("workload").alias("src"), *[c for c in dep.columns if c != "workload"]).join(other, "node").where("src <> dst")


def adjacency(dep: DataFrame) -> DataFrame:
    return _pairs(dep.select("workload", "node")).select("src", "dst").distinct().withColumn("weight", F.lit(1.0))


def overlaps(dep: DataFrame) -> DataFrame:
    """Shared nodes divided by the greatest such count."""
    n = _pairs(dep.select("workload", "node")).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("shared"))
    return n.join(F.broadcast(n.agg(F.max("shared").alias("top"))), how="cross").select("src", "dst", "shared", (F.col("shared") / F.col("top")).alias("weight"))


def hypergraph(dep: DataFrame) -> DataFrame:
    """Clique expansion: each node of d workloads adds 1 / (d - 1) to its pairs; divided by the greatest sum."""
    deg = dep.withColumn("d", F.count(F.lit(1)).over(Window.partitionBy("node")))
    w = _pairs(deg).groupBy("src", "dst").agg(F.sum(1.0 / (F.col("d") - 1)).alias("w"))
    return w.join(F.broadcast(w.agg(F.max("w").alias("top"))), how="cross").select("src", "dst", (F.col("w") / F.col("top")).alias("weight"))


def degrees(adj: DataFrame, workloads: DataFrame) -> DataFrame:
    return workloads.select("workload").distinct().join(adj.groupBy(F.col("src").alias("workload")).agg(F.count(F.lit(1)).alias("degree")), "workload", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))


def coverage(adj: DataFrame, workloads: DataFrame) -> DataFrame:
    d = degrees(adj, workloads)
    return d.agg(F.count(F.lit(1)).alias("workloads"), (F.sum("degree") / 2).cast("long").alias("edges"), F.avg((F.col("degree") == 0).cast("double")).alias("isolated"), F.avg("degree").alias("mean_degree"), F.expr("percentile(degree, 0.5)").alias("p50"), F.expr("percentile(degree, 0.95)").alias("p95"))


def stars(dep: DataFrame) -> DataFrame:
    """(src, dst): each workload of a node with the least of them. The components are those of the adjacency, a row an incidence instead of one a pair."""
    least = dep.groupBy("node").agg(F.min("workload").alias("dst"))
    return dep.join(least, "node").where("workload <> dst").select(F.col("workload").alias("src"), "dst").distinct()


def component_sizes(adj: DataFrame, workloads: DataFrame, store: Callable) -> DataFrame:
    """(workload, component): a workload without neighbours is its own component."""
    found = components(adj, store, "src", "dst")
    return workloads.select("workload").distinct().join(found.withColumnRenamed("node", "workload"), "workload", "left").select("workload", F.coalesce("label", "workload").alias("component"))


def two_hop(adj: DataFrame) -> DataFrame:
    """Pairs joined by two steps but not by one."""
    second = adj.select(F.col("src").alias("mid"), F.col("dst").alias("far"))
    reach = adj.select("src", F.col("dst").alias("mid")).join(second, "mid").where("src <> far").select("src", F.col("far").alias("dst")).distinct()
    return reach.join(adj.select("src", "dst"), ["src", "dst"], "left_anti")


def reachable(adj: DataFrame, hops: int) -> DataFrame:
    """(src, dst): distinct pairs within so many steps."""
    edges = adj.select("src", "dst").distinct()
    step = edges.select(F.col("src").alias("dst"), F.col("dst").alias("far"))
    found = edges
    for _ in range(hops - 1):
        found = found.unionAll(found.join(step, "dst").where("src <> far").select("src", F.col("far").alias("dst"))).distinct()
    return found


#: Numbers in a range of targets (places in it fit a short), and in a range of sources.
STRIPE, SOURCES = 1 << 15, 1 << 13


def within_two(adj: DataFrame, store: Callable, stripe: int = STRIPE, sources: int = SOURCES) -> DataFrame:
    """(src, direct, reached): how many others lie one step away, and one or two steps away; for a symmetric adjacency.

    Sources and targets are numbered and cut into ranges. A cell, a range of sources and one of targets, gets its
    sources' neighbours and, once for each of these, the list of what lies a step from it in the range of targets.
    A source marks what its neighbours' lists hold; counts of its cells add up. What two steps reach is never a
    row and never shuffles: lists do, once for each range of sources that has their owner as a neighbour.
    """
    names = store(numbered(adj.select("src").dropna().distinct(), ["src"], "number", store))
    e = adj.join(names, "src").withColumnRenamed("number", "s").join(names.select(F.col("src").alias("dst"), F.col("number").alias("t")), "dst").select("s", "t")
    e = e.unionAll(names.select(F.col("number").alias("s"), F.col("number").alias("t")))
    # each list holds its owner, so that what two steps reach holds what one step does
    part = lambda c, wide: F.floor(F.col(c) / wide).cast("int")
    own = store(e.groupBy("s", part("t", stripe).alias("f")).agg(F.collect_set(F.pmod("t", F.lit(stripe)).cast("short")).alias("near")))
    one = own.select(part("s", sources).alias("i"), "f", F.explode("near").alias("near"))
    asked = one.select("i", (F.col("f") * F.lit(stripe).cast("long") + F.col("near")).alias("k")).distinct()
    lists = asked.join(own.select(F.col("s").alias("k"), F.col("f").alias("j"), "near"), "k").select("i", "j", "k", F.lit(-1).alias("f"), "near")
    cells = lists.select("i", "j").distinct()
    mine = own.withColumn("i", part("s", sources)).join(cells, "i").select("i", "j", F.col("s").alias("k"), "f", "near")

    def reach(g: pd.DataFrame) -> pd.DataFrame:
        theirs = g[g["f"] < 0].sort_values("k")
        owners, far = theirs["k"].to_numpy(), theirs["near"].tolist()
        out = []
        for s, x in g[g["f"] >= 0].groupby("k"):
            seen = np.zeros(stripe, bool)
            for f, near in zip(x["f"].tolist(), x["near"]):
                t = np.asarray(near, np.int64) + f * stripe
                at = np.searchsorted(owners, t)
                for k in at[owners[np.minimum(at, len(owners) - 1)] == t].tolist():
                    seen[far[k]] = True
            out.append((s, np.count_nonzero(seen)))
        return pd.DataFrame(out, columns=["s", "n"])

    tasks = max(1, min(8192, -(-names.count() // sources)))  # a named number: little data, much work, so small shuffles must not be merged
    met = mine.unionAll(lists).repartition(tasks, "i", "j").groupBy("i", "j").applyInPandas(reach, "s long, n long")
    direct = own.groupBy("s").agg((F.sum(F.size("near")) - 1).alias("direct"))
    both = direct.join(met.groupBy("s").agg((F.sum("n") - 1).alias("reached")), "s")
    return both.join(names.withColumnRenamed("number", "s"), "s").select("src", "direct", "reached")


#: Workloads in a block (a place in it fits 16 bits), incidences in a pack of nodes, pairs made at a time, and marks set at a time.
BLOCK, PACK, PAIRS, MARKS = 1 << 15, 1 << 20, 1 << 22, 1 << 16


def _packed(keys: np.ndarray) -> bytes:
    """Ascending numbers as differences, byte by byte, compressed."""
    planes = np.ascontiguousarray(np.diff(keys, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return len(keys).to_bytes(8, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _unpacked(blob: bytes) -> np.ndarray:
    n = int.from_bytes(blob[:8], "little")
    planes = np.frombuffer(pa.decompress(blob[8:], decompressed_size=8 * n, codec="zstd", asbytes=True), np.uint8)
    return np.cumsum(np.ascontiguousarray(planes.reshape(8, n).T).view("<u8").ravel(), dtype=np.uint64)


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0] .. start[0] + size[0] - 1, start[1] .. and so on, in one array."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())


@dataclass
class _Rows:
    """A block's lists by owner: the place of each member in known, the members that any of them has."""

    owner: np.ndarray
    place: np.ndarray
    known: np.ndarray

    @classmethod
    def of(cls, keys: np.ndarray) -> _Rows:
        member, owner = keys >> np.uint64(16), (keys & np.uint64(0xFFFF)).astype(np.uint16)
        new = np.append(True, member[1:] != member[:-1])  # keys ascend
        order = np.argsort(owner, kind="stable")
        return cls(owner[order].astype(np.uint32), (np.cumsum(new, dtype=np.int32) - 1)[order], member[new])

    def common(self, keys: np.ndarray, marks: int) -> tuple[np.ndarray, np.ndarray]:
        """How many of another block's owners share a member with each of these, and the other way round.

        keys are the other block's pairs by member. Some whole owners' marks, one for each way to share a
        member, are sorted at a time, and those that repeat count once.
        """
        others, member = (keys & np.uint64(0xFFFF)).astype(np.uint32), keys >> np.uint64(16)
        first = np.flatnonzero(np.append(True, member[1:] != member[:-1]))
        theirs, size = member[first], np.diff(np.append(first, len(keys)))
        at = np.minimum(np.searchsorted(theirs, self.known), len(theirs) - 1)
        size, first = np.where(theirs[at] == self.known, size[at], 0)[self.place], first[at][self.place]
        filled = np.cumsum(size)
        ends = np.append(np.flatnonzero(self.owner[1:] != self.owner[:-1]) + 1, len(self.owner))
        upto = filled[ends - 1]
        n, m = int(self.owner[-1]) + 1, int(others.max()) + 1
        mine, yours, k = np.zeros(n, np.int64), np.zeros(m, np.int64), 0
        while k < len(ends):
            lo = int(ends[k - 1]) if k else 0
            k = max(k + 1, int(np.searchsorted(upto, (upto[k - 1] if k else 0) + marks, side="right")))
            sizes = size[lo : ends[k - 1]]
            both = np.repeat(self.owner[lo : ends[k - 1]] << np.uint32(16), sizes) | others[_ranges(first[lo : ends[k - 1]], sizes)]
            both.sort()
            both = both[np.append(True, both[1:] != both[:-1])] if len(both) else both
            mine += np.bincount(both >> np.uint32(16), minlength=n)
            yours += np.bincount(both & np.uint32(0xFFFF), minlength=m)
        return mine, yours


def within_two_on(dep: DataFrame, write: Callable, store: Callable, block: int = BLOCK, pack: int = PACK, marks: int = MARKS) -> DataFrame:
    """within_two for workloads that share nodes, from rows (workload, node), which may repeat.

    Workloads are dealt over blocks. A block's lists of neighbours, its own members included, are one row, packed.
    Two workloads are within two steps of each other if their lists share a member, so every two blocks meet
    once and count for both. They meet as a product of the stored blocks with themselves, which is read
    again and never shuffles; what shuffles is the incidences, then the packed pairs of one step. write ends
    a table's shuffles, store keeps its partitions.
    """
    rows = dep.select("workload", "node").dropna()
    n, w = rows.agg(F.count(F.lit(1)), F.approx_count_distinct("workload")).first()
    blocks, packs = max(1, -(-w // block), min(8, -(-w // 1024))), max(1, -(-n // pack))  # a few even where one would do, for there are no more tasks than pairs of them

    def place(key, g: pd.DataFrame) -> pd.DataFrame:
        """A block's workloads by name, and its incidences by pack of nodes."""
        names, local = np.unique(g["workload"].to_numpy(), return_inverse=True)
        if len(names) > 1 << 16:
            raise ValueError("a block holds more workloads than 16 bits tell apart")
        p, node, q = int(key[0]), g["node"].to_numpy(), g["q"].to_numpy()
        order = np.argsort(q, kind="stable")
        cuts = np.flatnonzero(np.append(True, np.diff(q[order]) != 0))
        out = [(-1, p, names.tolist(), None, None)]
        for x, y in zip(cuts, np.append(cuts[1:], len(order))):
            o = order[x:y]
            out.append((int(q[o[0]]), p, None, node[o].tolist(), local[o].astype(np.int32).tolist()))
        return pd.DataFrame(out, columns=["q", "p", "names", "nodes", "local"])

    kinds = dict(rows.dtypes)
    hashed = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    dealt = rows.select("*", hashed("workload", blocks).alias("p"), hashed("node", packs).alias("q")).repartition(blocks, "p")
    placed = write(dealt.groupBy("p").applyInPandas(place, f"q int, p int, names array<{kinds['workload']}>, nodes array<{kinds['node']}>, local array<int>"))

    def pairs(key, g: pd.DataFrame) -> pd.DataFrame:
        """The pairs on a pack's nodes, by the block of the first."""
        local = [np.asarray(x, np.uint64) for x in g["local"]]
        code = np.concatenate([x + (np.uint64(p) << np.uint64(16)) for p, x in zip(g["p"].tolist(), local)])
        node = pd.factorize(np.concatenate([np.asarray(x) for x in g["nodes"]]))[0]
        order = np.lexsort((code, node))
        code, node = code[order], node[order]
        new = np.append(True, (code[1:] != code[:-1]) | (node[1:] != node[:-1]))
        code, node = code[new], node[new]
        heads = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
        size = np.diff(np.append(heads, len(node)))
        start, size = np.repeat(heads, size), np.repeat(size, size)
        filled, out, lo = np.cumsum(size), [], 0
        while lo < len(code):
            hi = max(lo + 1, int(np.searchsorted(filled, (filled[lo - 1] if lo else 0) + PAIRS, side="right")))
            own, near = np.repeat(code[lo:hi], size[lo:hi]), code[_ranges(start[lo:hi], size[lo:hi])]
            to, key_ = own >> np.uint64(16), (near << np.uint64(16)) | (own & np.uint64(0xFFFF))
            o = np.lexsort((key_, to))
            to, key_ = to[o], key_[o]
            cuts = np.flatnonzero(np.append(True, to[1:] != to[:-1]))
            out += [(int(to[x]), _packed(np.unique(key_[x:y]))) for x, y in zip(cuts, np.append(cuts[1:], len(to)))]
            lo = hi
        return pd.DataFrame(out, columns=["p", "blob"])

    def joined(key, g: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"p": [int(key[0])], "blob": [_packed(np.unique(np.concatenate([_unpacked(b) for b in g["blob"]])))]})

    near = placed.where("q >= 0").select("q", "p", "nodes", "local").repartition(packs, "q").groupBy("q").applyInPandas(pairs, "p int, blob binary")
    lists = store(near.repartition(blocks, "p").groupBy("p").applyInPandas(joined, "p int, blob binary"))

    def cells(batches):
        """(p, direct, counts) of every two blocks, for either; direct is there where a block meets itself."""
        held = (None, None)
        for b in batches:
            for i, x, j, y in zip(b["i"].tolist(), b["x"], b["j"].tolist(), b["y"]):
                if held[0] != i:
                    held = (i, _Rows.of(_unpacked(x)))
                mine, yours = held[1].common(_unpacked(y), marks)
                out = [(i, np.bincount(held[1].owner) if i == j else None, mine)] + ([] if i == j else [(j, None, yours)])
                yield pd.DataFrame(out, columns=["p", "direct", "counts"])

    left = lists.select(F.col("p").alias("i"), F.col("blob").alias("x"))
    right = lists.select(F.col("p").alias("j"), F.col("blob").alias("y"))
    met = left.join(right.hint("shuffle_replicate_nl"), F.col("i") <= F.col("j")).mapInPandas(cells, "p int, direct array<int>, counts array<int>")

    def summed(key, g: pd.DataFrame) -> pd.DataFrame:
        names = next(x for x in g["names"] if x is not None)
        total = np.zeros(len(names), np.int64)
        for x in g["counts"]:
            if x is not None:
                total[: len(x)] += np.asarray(x)
        direct = np.asarray(next(x for x in g["direct"] if x is not None))
        return pd.DataFrame({"src": names, "direct": direct - 1, "reached": total - 1})

    void = lambda c, kind: F.lit(None).cast(kind).alias(c)
    named = placed.where("q < 0").select("p", void("direct", "array<int>"), void("counts", "array<int>"), "names")
    both = met.select("*", void("names", f"array<{kinds['workload']}>")).unionByName(named).repartition(blocks, "p")
    return both.groupBy("p").applyInPandas(summed, f"src {kinds['workload']}, direct long, reached long").where("direct > 0")


def identifiability(dep: DataFrame) -> DataFrame:
    """(node, size, shared): workloads on each node, and whether three or more make it a true hyperedge."""
    return dep.select("workload", "node").distinct().groupBy("node").agg(F.count(F.lit(1)).alias("size")).withColumn("hyperedge", F.col("size") >= 3)


def live_adjacency(dep: DataFrame, links: DataFrame, values: list[str], store: Callable) -> DataFrame:
    """(src, dst, weight): workload pairs by the number of live node edges between their nodes.

    A node edge lives if all its values are finite and not all are 0; every node has an edge to itself.
    """
    finite = [F.col(v).isNotNull() & ~F.isnan(F.col(v).cast("double")) & (F.abs(v) < float("inf")) for v in values]
    alive = finite[0]
    for f in finite[1:]:
        alive = alive & f
    edges = links.where(alive & (sum((F.abs(v) for v in values[1:]), F.abs(values[0])) > 0)).where("src <> dst").select("src", "dst")
    nodes = dep.select("node").dropna().distinct()
    edges = edges.distinct().unionAll(nodes.select(F.col("node").alias("src"), F.col("node").alias("dst")))
    kinds, kind_nodes = _kinds(dep, store)
    return _between_kinds(kinds, kind_nodes, edges, [F.count(F.lit(1)).cast("double").alias("weight")], ["src", "dst"], store)


def _kinds(dep: DataFrame, store: Callable) -> tuple[DataFrame, DataFrame]:
    """(workload, kind) and (kind, node): workloads with the same rows of nodes are of one kind, named by the least of them.

    Rows of nodes are told apart by their number and two sums of 64-bit hashes, whose order does not matter.
    """
    rows = dep.select("workload", "node").dropna()
    hashed = lambda *salt: F.sum(F.xxhash64("node", *salt).cast("decimal(20,0)"))
    marks = rows.groupBy("workload").agg(F.count(F.lit(1)).alias("n"), hashed().alias("x"), hashed(F.lit(1)).alias("y"))
    least = marks.groupBy("n", "x", "y").agg(F.min("workload").alias("kind"))
    kinds = store(marks.join(least, ["n", "x", "y"]).select("workload", "kind"))
    of = kinds.where("workload = kind").select("kind")
    return kinds, rows.withColumnRenamed("workload", "kind").join(of, "kind", "left_semi")


#: Workloads of one kind that stand in a row on the way to pairs, so that a kind with very many is not one task's.
TOGETHER = 1024
#: Tasks that pairs of kinds are dealt over: a named number, as few short rows become very many.
PAIR_TASKS = 128


def _between_kinds(kinds: DataFrame, kind_nodes: DataFrame, edges: DataFrame, values: list[Column], ends: list[str], store: Callable) -> DataFrame:
    """(ends, values): values aggregated over edges from the nodes of one kind to those of another, for all ordered pairs of their workloads.

    Only pairs of kinds are aggregated. Pairs of workloads are made from them one after the other where they
    lie: packs of workloads of either kind meet, and a pair is first a row when it is unpacked.
    """
    a = kind_nodes.select(F.col("kind").alias("k_src"), F.col("node").alias("src"))
    b = kind_nodes.select(F.col("kind").alias("k_dst"), F.col("node").alias("dst"))
    found = edges.join(a, "src").join(b, "dst").groupBy("k_src", "k_dst").agg(*values)
    names = [c for c in found.columns if c not in ("k_src", "k_dst")]
    sizes = kinds.groupBy("kind").agg(F.ceil(F.count(F.lit(1)) / TOGETHER).alias("packs"))
    packs = kinds.join(sizes, "kind").groupBy("kind", F.pmod(F.xxhash64("workload"), "packs").alias("pack")).agg(F.collect_list("workload").alias("ws"))
    packs = store(packs.select("kind", "ws"))
    small = F.broadcast if measured(packs) <= BROADCAST_BYTES else lambda df: df
    left = found.repartition(PAIR_TASKS).join(small(packs.select(F.col("kind").alias("k_src"), F.col("ws").alias("w_src"))), "k_src")
    both = left.join(small(packs.select(F.col("kind").alias("k_dst"), F.col("ws").alias("w_dst"))), "k_dst").select("w_src", "w_dst", *names)
    one = both.select(F.explode("w_src").alias(ends[0]), "w_dst", *names)
    return one.select(ends[0], F.explode("w_dst").alias(ends[1]), *names).where(F.col(ends[0]) != F.col(ends[1]))


def largest_component(found: DataFrame) -> DataFrame:
    """(workloads, components, largest, largest_ratio) of (workload, component)."""
    sizes = found.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.sum("n").alias("workloads"), F.count(F.lit(1)).alias("components"), F.max("n").alias("largest"), (F.max("n") / F.sum("n")).alias("largest_ratio"))


def masked(adj: DataFrame, active: DataFrame) -> DataFrame:
    """Edges with both ends active."""
    on = active.select("workload").distinct()
    return adj.join(on.withColumnRenamed("workload", "src"), "src", "left_semi").join(on.withColumnRenamed("workload", "dst"), "dst", "left_semi")


def neighbour_modulation(mu: DataFrame, adj: DataFrame, theta_mu: float, theta_overlap: float, strength: float) -> DataFrame:
    """(workload, t, state, mu): each state moved by the mean of tanh(half the neighbours' evidence), then normalised.

    mu is long: (workload, t, state, mu). Neighbours act through what they were before modulation.
    """
    near = mu.select(F.col("workload").alias("dst"), "t", "state", F.col("mu").alias("near"))
    seen = adj.join(near, "dst").withColumn("m", bipolar(F.col("near") * theta_mu + F.col("weight") * theta_overlap))
    m = seen.groupBy(F.col("src").alias("workload"), "t", "state").agg(F.avg("m").alias("m"))
    out = mu.join(m, ["workload", "t", "state"], "left").withColumn("v", einstein(F.col("mu"), F.coalesce("m", F.lit(0.0)), strength))
    mass = F.sum("v").over(Window.partitionBy("workload", "t"))
    k = F.count(F.lit(1)).over(Window.partitionBy("workload", "t"))
    return out.select("workload", "t", "state", F.when(mass > 1e-12, F.col("v") / mass).otherwise(1.0 / k).alias("mu"))


#: Signs of a link's features: more bandwidth and availability is better, more delay and loss worse.
SIGNS = {"bandwidth": 1.0, "delay": -1.0, "loss": -1.0, "availability": 1.0}


def link_gates(links: DataFrame) -> DataFrame:
    """(src, dst, gate, share): sigmoid of the signed z-scores' sum; shares of a destination's gates sum to 1."""
    stats = links.agg(*[f(c).alias(f"_{n}_{c}") for c in SIGNS for f, n in ((F.avg, "m"), (F.stddev_pop, "s"))])
    z = sum(((F.col(c) - F.col(f"_m_{c}")) / (F.col(f"_s_{c}") + 1e-8) * s for c, s in SIGNS.items()), F.lit(0.0))
    g = links.join(F.broadcast(stats), how="cross").select("src", "dst", sigmoid(z).alias("gate"))
    return g.withColumn("share", F.col("gate") / F.sum("gate").over(Window.partitionBy("dst")))


def project_links(dep: DataFrame, links: DataFrame, values: list[str], store: Callable) -> DataFrame:
    """Node links as workload pairs: the mean over the node pairs that connect them."""
    return _between_kinds(*_kinds(dep, store), links, [F.avg(v).alias(v) for v in values], ["w_src", "w_dst"], store)


def propagate(values: DataFrame, shares: DataFrame, w_self: float, w_message: float, rounds: int = 1) -> DataFrame:
    """(node, value) after rounds of tanh(self * value + message * what the sources' shares bring)."""
    for _ in range(rounds):
        come = shares.join(values.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("share") * F.col("value")).alias("in"))
        values = values.join(come, "node", "left").select("node", F.tanh(F.col("value") * w_self + F.coalesce("in", F.lit(0.0)) * w_message).alias("value"))
    return values


def propagate_matrix(values: DataFrame, shares: DataFrame, w_self: list[list[float]], w_message: list[list[float]], rounds: int = 1) -> DataFrame:
    """(node, x array) after rounds of tanh(x W_self + sum of shares * x W_message): propagate for vectors. The matrices are a model of K x K."""
    model = lambda w: F.array(*[F.array(*map(F.lit, map(float, column))) for column in zip(*w)])
    times = lambda x, w: F.transform(model(w), lambda column: dot(x, column))
    for _ in range(rounds):
        sent = values.select(F.col("node").alias("src"), F.posexplode(times(F.col("x"), w_message)).alias("at", "m"))
        come = shares.join(sent, "src").groupBy(F.col("dst").alias("node"), "at").agg(F.sum(F.col("share") * F.col("m")).alias("m"))
        come = come.groupBy("node").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "m"))), lambda s: s["m"]).alias("m"))
        mixed = F.when(F.col("m").isNull(), times(F.col("x"), w_self)).otherwise(F.zip_with(times(F.col("x"), w_self), "m", lambda a, b: a + b))
        values = values.join(come, "node", "left").select("node", F.transform(mixed, F.tanh).alias("x"))
    return values


def residual(mu: Column, context: Column, weights: list[list[float]], bias: list[float]) -> Column:
    """softmax(log mu + tanh([mu, context] W + b)); W and b of zeros change nothing."""
    x = F.concat(mu, context)
    columns = F.array(*[F.struct(F.array(*map(F.lit, map(float, w))).alias("w"), F.lit(float(b)).alias("b")) for w, b in zip(zip(*weights), bias)])
    moved = F.transform(columns, lambda c: F.tanh(dot(x, c["w"]) + c["b"]))
    return softmax(F.zip_with(F.transform(mu, lambda v: F.ln(F.greatest(v, F.lit(EPS)))), moved, lambda a, b: a + b))


@dataclass(frozen=True)
class GatedBlock:
    """Parameters of a learned block over k states, r resources, f link features and g hidden numbers; matrices are lists of rows.

    theta is (k + 1) x k, into (k + r) x g with bias, own and message a g x g matrix a round (own with a bias),
    link f numbers with a bias, head g x k with bias.
    """

    theta: list
    into: list
    into_bias: list
    own: list
    own_bias: list
    message: list
    link: list
    link_bias: float
    head: list
    head_bias: list
    strength: float = 0.6


def gated_edges(edges: DataFrame, key: list[str], block: GatedBlock, features: str | None) -> DataFrame:
    """(key, node, near, gate, share): what of each node's messages comes from each neighbour.

    edges has key, node, near, weight and, unless features is None, an array of link features; a null array or
    no features at all is a gate of 1. An edge weighs weight times the sigmoid of its features' score; shares
    of a node's edges sum to 1, or are 0 where all weigh nothing. Edges of weight 0 are none.
    """
    on = edges.where("weight > 0")
    score = F.lit(float(block.link_bias))
    if features is not None:
        for i, w in enumerate(block.link):
            score = score + F.get(features, F.lit(i)) * F.lit(float(w))
    gate = F.lit(1.0) if features is None else F.when(F.col(features).isNull(), 1.0).otherwise(sigmoid(score))
    rows = on.select(*key, "node", "near", "weight", gate.alias("gate"))
    total = rows.groupBy(*key, "node").agg(F.sum(F.col("weight") * F.col("gate")).alias("_total"))
    share = F.col("weight") * F.col("gate") / F.greatest("_total", F.lit(EPS))
    return rows.join(total, [*key, "node"]).select(*key, "node", "near", "gate", share.alias("share"))


def gated_messages(nodes: DataFrame, edges: DataFrame, key: list[str], block: GatedBlock, store: Callable[[DataFrame], DataFrame], features: str | None = None) -> DataFrame:
    """(key, node, mu, neighbours, gate_mean, shift, context): states after neighbours' evidence and rounds of messages.

    nodes has key, node, mu (array of k memberships) and x (array of r resources); key names what separates
    graphs, an origin for one. Evidence is tanh of what theta makes of the neighbours' mean membership and the
    degree's share of the other nodes; it moves each membership by the bounded Einstein sum. Hidden numbers
    start from memberships and resources and take in their neighbours' in each round. Nodes without
    neighbours keep their memberships. shift is the sum of absolute changes, context the hidden numbers' length.

    Each round is a join of the edges with the nodes' hidden numbers and a sum by node, added up in the tasks
    before it shuffles. No graph is one row, and a hub's edges join by hot keys.
    """
    k, g, r = len(block.theta[0]), len(block.into[0]), len(block.into) - len(block.theta[0])
    shares = store(gated_edges(edges, key, block, features))
    table = nodes.select(*key, "node", *[F.get("mu", F.lit(i)).alias(f"m{i}") for i in range(k)], *[F.get("x", F.lit(i)).alias(f"x{i}") for i in range(r)])

    def come(values: DataFrame, names: list[str], *more: Column) -> DataFrame:
        """Sums by node of what neighbours' shares bring, under the same names with an n before."""
        small = store(values.select(*key, F.col("node").alias("near"), *names))
        rows = unique_join(shares, small, [*key, "near"], "inner", store)
        return rows.groupBy(*key, "node").agg(*(F.sum(F.col("share") * F.col(c)).alias(f"n{c}") for c in names), *more)

    state = [f"m{i}" for i in range(k)]
    near = come(table, state, F.count(F.lit(1)).alias("neighbours"), F.avg("gate").alias("gate_mean"), F.sum("share").alias("_share"))
    sizes = table.groupBy(*key).agg(F.count(F.lit(1)).alias("_nodes")) if key else table.agg(F.count(F.lit(1)).alias("_nodes"))
    table = table.join(near, [*key, "node"], "left")
    table = table.join(F.broadcast(sizes), key) if key else table.join(F.broadcast(sizes), how="cross")
    has = F.when(F.coalesce("_share", F.lit(0.0)) > 0.5, 1.0).otherwise(0.0)
    degree = F.coalesce("neighbours", F.lit(0)) / F.greatest(F.col("_nodes") - 1, F.lit(1))
    evidence = affine([*(F.coalesce(f"nm{i}", F.lit(0.0)) for i in range(k)), degree], block.theta)
    moved = []
    for i in range(k):
        c, e = 2 * F.col(f"m{i}") - 1, F.lit(block.strength) * F.tanh(evidence[i]) * has
        moved.append(F.greatest(0.5 * (1 + (c + e) / F.greatest(1 + c * e, F.lit(EPS))), F.lit(0.0)))
    table = table.select(*key, "node", *state, *[f"x{i}" for i in range(r)], "neighbours", "gate_mean", has.alias("_has"), *[c.alias(f"v{i}") for i, c in enumerate(moved)])
    mass = sum((F.col(f"v{i}") for i in range(1, k)), F.col("v0"))
    table = table.withColumns({f"a{i}": F.when(mass > EPS, F.col(f"v{i}") / mass).otherwise(1.0 / k) for i in range(k)})
    hidden = affine([*(F.col(f"a{i}") for i in range(k)), *(F.col(f"x{i}") for i in range(r))], block.into, block.into_bias)
    table = store(table.withColumns({f"h{i}": F.tanh(c) for i, c in enumerate(hidden)}))
    for own, bias, message in zip(block.own, block.own_bias, block.message):
        sent = come(table, [f"h{i}" for i in range(g)])
        both = table.join(sent, [*key, "node"], "left")
        mine, theirs = affine([F.col(f"h{i}") for i in range(g)], own, bias), affine([F.coalesce(f"nh{i}", F.lit(0.0)) for i in range(g)], message)
        table = store(both.withColumns({f"_h{i}": F.tanh(mine[i] + theirs[i]) for i in range(g)}).drop(*[f"{p}h{i}" for i in range(g) for p in ("", "n")]).withColumnsRenamed({f"_h{i}": f"h{i}" for i in range(g)}))
    left = affine([F.col(f"h{i}") for i in range(g)], block.head, block.head_bias)
    mu = softmax(F.array(*(F.ln(F.greatest(f"a{i}", F.lit(EPS))) + left[i] * F.col("_has") for i in range(k))))
    square = sum((F.col(f"h{i}") * F.col(f"h{i}") for i in range(1, g)), F.col("h0") * F.col("h0"))
    out = table.withColumn("mu", mu)
    shift = sum((F.abs(F.get("mu", F.lit(i)) - F.col(f"m{i}")) for i in range(1, k)), F.abs(F.get("mu", F.lit(0)) - F.col("m0")))
    return out.select(*key, "node", "mu", F.coalesce("neighbours", F.lit(0)).cast("long").alias("neighbours"), "gate_mean", shift.alias("shift"), F.sqrt(square).alias("context"))

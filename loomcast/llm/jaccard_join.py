"""N-gram Jaccard join by chosen paths.

A document is its set of word shingles. In each run a set is sent down the paths of the tokens it
samples by a shared hash: sets with a token in common meet in that token's bucket. Buckets of tokens
that a sample of documents shows to be frequent are split again by further sampled tokens. In a bucket
sets are compared by brute force on sketches, which gives candidate links; runs repeat until a pair at
the threshold is missed with less than the allowed probability. Groups that candidate links connect are
then compared exactly: links, their number per document, and classes come from the sets themselves.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomcast.operators.components import components

from ._common import NULL_ID, hot_hashes, join_checked, release, stored, unpacked, whole
from ._superkmers import keys, mixed

#: Words in a shingle; similarity as a fraction; expected tokens sampled by a set in a run, and per split; splits at most.
WORDS, SIMILAR = 5, (4, 5)
SAMPLED, SPLIT, DEPTH = 3.0, 2.5, 4
#: Sets of which WHOLE or more is frequent gain nothing by splits and stay together; those from PART on do both,
#: as a set similar to one with 0.8 has (0.8 + 0.8 - 1) * 0.8 = 0.48 at least.
WHOLE, PART = 0.8, 0.45
#: Probability of missing a pair at the threshold.
MISS = 1e-6
#: Bytes of a sketch; agreement that links, and that lets a leader answer for a set.
BINS, LINK, NEAR = 64, 0.4, 0.75
#: Sets of a path in one task; a path of more is dealt over several.
PATH = 2000
#: Sets compared exactly in one task; larger groups are cut into blocks of so many.
BLOCK = 1000
_G = np.uint64(0x9E3779B97F4A7C15)


def runs_needed(miss: float = MISS) -> int:
    """A run misses a pair at similarity s with probability exp(-SAMPLED * s) at most."""
    return math.ceil(-math.log(miss) / (SAMPLED * SIMILAR[0] / SIMILAR[1]))


def shingles(text: str | None, known: dict | None = None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of five-word runs, A-Z lowered; a shorter text is one shingle, a text without words none."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if known is None:
        known = {}
    h = np.fromiter((known.get(w) or known.setdefault(w, xxhash.xxh3_64_intdigest(w)) for w in words), np.uint64, len(words))
    n = min(WORDS, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        out = mixed(out * _G + h[i : len(h) - n + 1 + i])
    return np.unique(out)


#: A set's name: 128 bits and a last byte that is never 0, as numpy drops final zeros of byte strings.
NAME = "S17"


def digest(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes()) + b"\1"


_EDGES = (np.arange(1, BINS, dtype=np.uint64) * np.uint64(2**64 // BINS))


def sketch(s: np.ndarray) -> bytes:
    """One byte of the least token in each of BINS ranges; 0 where there is none."""
    at = np.concatenate([[0], np.searchsorted(s, _EDGES), [len(s)]])
    out = np.zeros(BINS, np.uint8)
    full = at[1:] > at[:-1]
    out[full] = mixed(s[at[:-1][full]] * _G).astype(np.uint8) % np.uint8(255) + np.uint8(1)
    return out.tobytes()


def paths(s: np.ndarray, hot: np.ndarray, runs: int) -> np.ndarray:
    """The buckets of a set."""
    out: list[np.ndarray] = []
    is_hot = np.isin(s, hot) if len(hot) else np.zeros(len(s), bool)
    share = is_hot.mean()

    def down(path: np.uint64, expected: float, depth: int, used: tuple) -> None:
        h = mixed(s ^ path)
        least = np.uint64(min(2**64 - 1, int(expected / len(s) * 2**64)))
        pick = h < least
        if depth == 1:
            pick[h.argmin()] = True
        for i in np.flatnonzero(pick):
            if i in used:
                continue
            to = mixed(path * _G + s[i : i + 1])[0]
            split = is_hot[i] and depth < DEPTH and share < WHOLE
            if split:
                down(to, SPLIT, depth + 1, (*used, i))
            if not split or depth == 1 and share >= PART:
                out.append(to)

    with np.errstate(over="ignore"):
        for r in range(runs):
            down(mixed(np.array([r + 1], np.uint64) * _G)[0], SAMPLED, 1, ())
    return np.unique(np.array(out, np.uint64))


def frequent(docs: DataFrame, rows: int) -> np.ndarray:
    """Shingles that many documents hold: a plan for splitting, not a filter."""

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lo in range(0, len(b), 50):
                yield pd.DataFrame({"h": np.concatenate([shingles(t) for t in b["text"].iloc[lo : lo + 50]]).astype(np.int64)})

    return hot_hashes(docs, rows, look, 23)


def _entries(hot: np.ndarray, runs: int):
    """Rows (_id, _t, text) to a row per document and one per bucket of a set that is new in its task's batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            known: dict = {}
            seen: set = set()
            for lo in range(0, len(b), 1000):
                docs, ents = [], []
                for i, m, t in zip(*(b[c].iloc[lo : lo + 1000] for c in ("_id", "_t", "text"))):
                    s = shingles(t, known)
                    d = digest(s)
                    docs.append((i, m, d, len(s)))
                    if len(s) and d not in seen:
                        seen.add(d)
                        ents.append((d, sketch(s), paths(s, hot, runs).astype(np.int64)))
                out = pd.DataFrame(docs, columns=["_id", "_t", "d1", "n"])
                yield out.assign(path=None, sketch=None)
                n = [len(e[2]) for e in ents]
                if n:
                    yield pd.DataFrame({"_id": None, "_t": None, "d1": [e[0] for e, k in zip(ents, n) for _ in range(k)], "n": None, "path": np.concatenate([e[2] for e in ents]), "sketch": [e[1] for e, k in zip(ents, n) for _ in range(k)]})
                if len(known) > 1 << 17:
                    known.clear()
            docs = ents = out = None
            known.clear()
            release()

    return run


ENTRIES = "_id long, _t long, d1 binary, n int, path long, sketch binary"


def _agree(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    both = (a[None, :] == b) & (b != 0)
    some = (a[None, :] != 0) | (b != 0)
    return both.sum(1) / np.maximum(some.sum(1), 1)


#: Of a path, or of a part of one: sets for which no leader answers, their sketches, and for each the first it is connected to.
Kept = tuple[np.ndarray, np.ndarray, np.ndarray]


def _forest(ids: np.ndarray, sk: np.ndarray, before: Kept | None = None) -> tuple[list[tuple[bytes, bytes]], Kept]:
    """Candidate links of sets of one path, only those that connect what was not yet connected: fewer than its sets.

    Leaders meet all sets that are left: those kept from before first, then the least id. A set very near a
    leader is left to it: what is similar to that set is near enough to the leader to be connected through it.
    What is kept stands for all sets so far when the path goes on.
    """
    ids, first = np.unique(ids, return_index=True)
    sk, n, group = sk[first], 0, np.arange(len(ids))
    if before is not None:
        fresh, n = ~np.isin(ids, before[0]), len(before[0])
        ids, sk = np.concatenate([before[0], ids[fresh]]), np.concatenate([before[1], sk[fresh]])
        group = np.concatenate([before[2], np.arange(n, len(ids))])
    left, kept, out = np.arange(n, len(ids)), list(range(n)), []

    def meet(a: int, rest: np.ndarray) -> np.ndarray:
        like = _agree(sk[a], sk[rest])
        met = np.unique(group[rest[like >= LINK]])
        met = met[met != group[a]]
        if len(met):
            least = min(group[a], met[0])
            out.extend((ids[least], ids[x]) for x in (*met.tolist(), group[a]) if x != least)
            group[np.isin(group, met) | (group == group[a])] = least
        return rest[like < NEAR]

    for a in range(n):
        left = meet(a, left) if len(left) else left
    while len(left):
        a, left = left[0], left[1:]
        kept.append(int(a))
        left = meet(a, left) if len(left) else left
    _, first, of = np.unique(group[kept], return_index=True, return_inverse=True)
    return out, (ids[kept], sk[kept], first[of])


LINKS = "a binary, b binary, path long, sketch binary"


def _links(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches (path, part, parts, d1, sketch) sorted by path and part to candidate links (a, b).

    A batch is worked off as it comes; of a path that goes on only what is kept is carried over. What is
    kept of a path's part is told as rows (a, path, sketch), for the parts of a path to meet.
    """
    last, kept, more = None, None, False

    def told(path: int) -> pd.DataFrame:
        return pd.DataFrame({"a": kept[0].astype(object), "b": None, "path": path, "sketch": [x.tobytes() for x in kept[1]]})

    for b in rows:
        if not len(b):
            continue
        p, q, cut = (b[c].to_numpy() for c in ("path", "part", "parts"))
        d, sk = np.array(b["d1"].tolist(), NAME), np.frombuffer(b"".join(b["sketch"]), np.uint8).reshape(-1, BINS)
        heads = np.flatnonzero(np.append(True, (p[1:] != p[:-1]) | (q[1:] != q[:-1])))
        out: list = []
        for x, y in zip(heads, np.append(heads[1:], len(p))):
            same = last == (p[x], q[x])
            if not same and more:
                yield told(last[0])
            more = cut[x] > 1
            if same or more or y == len(p) or y - x > 1 and (d[x:y] != d[x]).any():
                got, kept = _forest(d[x:y], sk[x:y], kept if same else None)
                out += got
            last = (p[x], q[x])
        links = pd.DataFrame(sorted(set(out)), columns=["a", "b"])
        yield links.assign(path=None, sketch=None)
    if more:
        yield told(last[0])
    b = d = sk = out = links = kept = None
    release()


def _candidates(entries: DataFrame, at_most: int | None = None) -> DataFrame:
    """(a, b): candidate links of all paths. A path of more sets than at_most is dealt over tasks by a hash of the set;
    its parts' sets for which no leader answers meet afterwards, in one task as a stream."""
    at_most = PATH if at_most is None else at_most
    on = entries.where("path is not null").select("path", "d1", "sketch")
    heavy = stored(on.groupBy("path").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > at_most).select("path", F.ceil(F.col("c") / at_most).cast("int").alias("parts")), "heavy")
    parts = join_checked(on, heavy, ["path"]).withColumn("parts", F.coalesce("parts", F.lit(1)))
    parts = parts.withColumn("part", F.pmod(F.xxhash64("d1"), F.col("parts")).cast("int"))
    told = stored(parts.repartition("path", "part").sortWithinPartitions("path", "part").mapInPandas(_links, LINKS), "links")
    links = told.where("path is null").select("a", "b")
    if heavy.limit(1).count():
        rest = told.where("path is not null").select("path", F.lit(0).alias("part"), F.lit(1).alias("parts"), F.col("a").alias("d1"), "sketch")
        links = links.unionAll(rest.repartition("path").sortWithinPartitions("path").mapInPandas(_links, LINKS).select("a", "b"))
    return links.distinct()


def _similar(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Which pairs have Jaccard similarity of at least SIMILAR, exactly."""
    both = left if left is right else left + right
    size = np.array([len(s) for s in both], np.int64)
    tok, owner = np.concatenate(both), np.repeat(np.arange(len(both)), size)
    order = np.argsort(tok, kind="stable")
    tok, owner = tok[order], owner[order]
    heads = np.flatnonzero(np.append(True, tok[1:] != tok[:-1]))
    n = np.diff(np.append(heads, len(tok)))
    # tokens that the same sets hold count together
    code = mixed(np.arange(1, len(both) + 1, dtype=np.uint64) * _G)
    held = np.add.reduceat(code[owner], heads)
    held[n == 1] = 0
    kinds, first, weight = np.unique(held, return_index=True, return_counts=True)
    keep = kinds != 0
    first, weight = first[keep], weight[keep]
    inter = np.zeros((len(left), len(right)), np.float32)
    off = 0 if left is right else len(left)
    for lo in range(0, len(first), 2048):
        f = first[lo : lo + 2048]
        m = np.zeros((len(both), len(f)), np.float32)
        k = n[f]
        cols = np.repeat(np.arange(len(f)), k)
        at = np.repeat(heads[f] - (np.cumsum(k) - k), k) + np.arange(k.sum())
        m[owner[at], cols] = 1
        inter += (m[: len(left)] * weight[lo : lo + 2048].astype(np.float32)) @ m[off : off + len(right)].T
    a, b = size[: len(left)], size[off : off + len(right)]
    p, q = SIMILAR
    return (p + q) * inter.astype(np.int64) >= p * (a[:, None] + b[None, :])


def _classes(adj: np.ndarray) -> np.ndarray:
    """The least member of each member's component."""
    label = np.arange(len(adj))
    while True:
        new = np.minimum(label, np.where(adj, label[None, :], len(adj)).min(1))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _verify(key, rows: pd.DataFrame) -> pd.DataFrame:
    """Groups of one task, or a pair of blocks of a large one: (d1, leader, links) and whether leader is final."""
    out = []
    for (g, i, j), part in rows.groupby(["g", "i", "j"], sort=False):
        part = part.drop_duplicates("d1")  # a row repeated under one id comes with its repeats
        ids, copies, side = part["d1"].to_numpy(), part["copies"].to_numpy(), part["side"].to_numpy()
        known: dict = {}
        sets = [shingles(t, known) for t in part["text"]]
        if i == j:
            adj = _similar(sets, sets)
            np.fill_diagonal(adj, True)
            links = adj @ copies - 1
            label = _classes(adj)
            out += zip(ids.tolist(), ids[label].tolist(), links.tolist(), [bool(i < 0)] * len(ids))
        else:
            l, r = np.flatnonzero(side == i), np.flatnonzero(side == j)
            adj = _similar([sets[x] for x in l], [sets[x] for x in r])
            n = len(l)
            full = np.zeros((len(ids), len(ids)), bool)
            full[:n, n:] = adj
            full |= full.T
            np.fill_diagonal(full, True)
            label, order = _classes(full), np.concatenate([l, r])
            links = np.concatenate([adj @ copies[r], adj.T @ copies[l]])
            out += zip(ids[order].tolist(), ids[order][label].tolist(), links.tolist(), [False] * len(ids))
        part = sets = known = adj = full = None
    release()
    return pd.DataFrame(out, columns=["d1", "leader", "links", "final"])


def jaccard_classes(docs: DataFrame, miss: float = MISS) -> DataFrame:
    """(doc_id, class_id, n_links): one row per document.

    Links join documents whose five-word shingle sets have a Jaccard similarity of 0.8 or more; n_links
    counts the other documents so linked, exact copies included, and class_id is the least doc_id that
    links connect it to. Documents without words link to none, not even to each other. A null doc_id is a
    document with the least id of all and shows as null. Rows that repeat a doc_id are documents of their
    own. An empty table: no rows.
    """
    out = _classified(docs.select("doc_id", "text"), miss)
    return out.select(F.when(F.col("_id") != NULL_ID, F.col("_id")).alias("doc_id"), F.when(F.col("class_id") != NULL_ID, F.col("class_id")).alias("class_id"), "n_links")


def _classified(docs: DataFrame, miss: float) -> DataFrame:
    """A row (_id, _t, class_id, n_links, rank) per document; rank is 1 for the one of its class that stays."""
    keep = lambda name: lambda df: stored(df, name)
    rows = docs.count()
    hot = frequent(docs, rows)
    entries = stored(docs.select(*keys(), "text").mapInPandas(_entries(hot, runs_needed(miss)), ENTRIES), "entries")
    members = entries.where("path is null").select("_id", "_t", "d1", "n")
    reps = stored(members.where("n > 0").groupBy("d1").agg(F.min(F.struct("_id", "_t")).alias("rep"), F.count(F.lit(1)).alias("copies")), "sets")
    links = stored(_candidates(entries), "links")
    groups = components(links, keep("groups"))
    sizes = groups.groupBy("label").agg(F.count(F.lit(1)).alias("size"))
    tasks = max(8, rows // 2000)
    small = F.col("size") <= BLOCK
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    # a large group's label is on most rows: distinct labels are the small side
    cand = join_checked(groups.withColumnRenamed("node", "d1"), keep("sizes")(sizes), ["label"], "inner").join(reps, "d1").withColumn("blocks", blocks)
    own = F.pmod(F.hash("d1"), F.col("blocks"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(own, o).alias("i"), F.greatest(own, o).alias("j")))
    cand = cand.select("d1", "copies", F.col("label").alias("g"), F.col("rep._id").alias("_id"), F.col("rep._t").alias("_t"), F.when(small, -1).otherwise(own).alias("side"), F.when(small, F.array(F.struct(F.lit(-1).alias("i"), F.lit(-1).alias("j")))).otherwise(pairs).alias("pairs"))
    cand = stored(cand, "candidates")
    texts = docs.select(*keys(), "text")
    met = join_checked(texts, cand, ["_id", "_t"], "inner").select("*", F.explode("pairs").alias("p")).select("d1", "copies", "g", "side", "text", "p.i", "p.j")
    task = F.when(F.col("i") < 0, F.pmod(F.xxhash64("g"), F.lit(tasks))).otherwise(F.xxhash64("g", "i", "j"))
    got = stored(met.groupBy(task.alias("task")).applyInPandas(_verify, "d1 binary, leader binary, links long, final boolean"), "verified")
    done = got.where("final").select("d1", F.col("leader").alias("label"), "links")
    if got.where("not final").limit(1).count():
        part = got.where("not final")
        label = components(part.select(F.col("d1").alias("a"), F.col("leader").alias("b")), keep("classes")).withColumnRenamed("node", "d1")
        wide = part.groupBy("d1").agg(F.sum("links").alias("links")).join(label, "d1", "left").select("d1", F.coalesce("label", "d1").alias("label"), "links")
        done = done.unionAll(wide)
    # only sets with a candidate link have a label; the others keep themselves, so no null key is joined
    done = keep("labels")(done.join(reps.select("d1", "rep"), "d1"))
    least = keep("least")(done.groupBy("label").agg(F.min("rep").alias("first")))
    first = join_checked(done.select("d1", "label", "links"), least, ["label"], "left").select("d1", "first", "links")
    classes = reps.join(first, "d1", "left")
    classes = stored(classes.select("d1", F.coalesce("first", "rep").alias("first"), F.coalesce("links", F.col("copies") - 1).alias("n_links")), "class-of")
    out = join_checked(members, classes, ["d1"], "left")
    return out.select("_id", "_t", F.coalesce("first._id", "_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce((F.col("first._id") == F.col("_id")) & (F.col("first._t") == F.col("_t")), F.lit(True)).alias("stays"))


def keep_one(docs: DataFrame, miss: float = MISS) -> DataFrame:
    """The documents, of each class only the one with the least doc_id; rows that repeat that document, id and text, stay with it."""
    gone = stored(_classified(docs.select("doc_id", "text"), miss).where("not stays").select("_id", "_t").distinct(), "gone")
    return join_checked(whole(docs, *keys()), gone, ["_id", "_t"], "left_anti").select(*unpacked(docs.columns))


def op6(spark, sf_dir: str) -> DataFrame:
    return jaccard_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))

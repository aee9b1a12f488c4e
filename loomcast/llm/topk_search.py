"""Exact top-k inner-product search over an impact-ordered index, score at a time.

A vector component is an integer impact. The index packs vectors into blocks; within a block the
postings of a dimension are cut into segments by quantised impact (the magnitude's power of two), the
largest first. A search reads postings segment by segment, by impact times query weight, into one
accumulator a pair, bounds what postings not yet read can add, and stops for a pair only when that bound
proves it cannot reach the query's k-th score. Pairs that remain possible are scored again exactly in 64-bit integers. Vectors with
a component too large for such bounds stay out of the segments: all their pairs are scored exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import stored

#: Vectors in a block of the index, queries in a batch, and queries sent to the executors at a time.
BLOCK, BATCH, WAVE = 4096, 256, 8192
#: A vector with an impact at or beyond this is searched outside the segments. Impacts and scores are longs.
LIMIT, LONG = 2**27, 2.0**63
INDEX = "vec_ids binary, dims int, offsets binary, positions binary, impacts binary"


def impacts(vectors: DataFrame, scale: float = 256.0) -> DataFrame:
    """(vec_id, impacts): floor(scale * x) per component; vectors null or with null or non-finite parts are left out.

    A finite component whose impact is no long is an error when it is read, as in SQL, and never a missing row.
    """
    ok = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    whole = lambda x: F.floor(F.when(F.abs(x.cast("double") * scale) < LONG, x.cast("double") * scale).otherwise(F.raise_error(F.lit("an impact is beyond 64 bits")).cast("double"))).cast("long")
    return vectors.where(ok & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", whole).alias("impacts"))


def _matrix(rows: list) -> np.ndarray:
    dims = max([len(r) for r in rows], default=0)
    out = np.zeros((len(rows), dims), np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def _bands(m: np.ndarray) -> np.ndarray:
    """0 for an impact of 0, else the bit length of its magnitude: the segment that holds it."""
    return np.ceil(np.log2(np.abs(m) + 1.0)).astype(np.int8)


def _pack(ids: np.ndarray, m: np.ndarray) -> dict:
    bands = _bands(m)
    at, dim = np.nonzero(bands)
    order = np.lexsort((at, dim, -bands[at, dim]))
    at, dim = at[order], dim[order]
    top = int(bands.max(initial=0))
    # offsets[band from the top, dimension]: where that segment begins
    key = (top - bands[at, dim].astype(np.int64)) * max(m.shape[1], 1) + dim
    offsets = np.searchsorted(key, np.arange(top * max(m.shape[1], 1) + 1))
    width = np.int32 if top < 32 else np.int64
    return {"vec_ids": ids.tobytes(), "dims": m.shape[1], "offsets": offsets.astype(np.int32).tobytes(), "positions": at.astype(np.uint16).tobytes(), "impacts": m[at, dim].astype(width).tobytes()}


def build_index(vectors: DataFrame) -> DataFrame:
    """One row per block of at most BLOCK vectors, built where the rows lie, without a shuffle."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, rows = [], []
        for b in batches:
            ids += b["vec_id"].tolist()
            rows += b["impacts"].tolist()
            while len(ids) >= BLOCK:
                yield pd.DataFrame([_pack(np.array(ids[:BLOCK], np.int64), _matrix(rows[:BLOCK]))])
                ids, rows = ids[BLOCK:], rows[BLOCK:]
        if ids:
            yield pd.DataFrame([_pack(np.array(ids, np.int64), _matrix(rows))])

    return vectors.select("vec_id", "impacts").mapInPandas(pack, INDEX)


def _postings(row) -> tuple[np.ndarray, np.ndarray, list[tuple]]:
    """The block's vector ids, its impacts by vector, and its segments (band, dimension, positions, impacts)."""
    ids, at = np.frombuffer(row.vec_ids, np.int64), np.frombuffer(row.positions, np.uint16)
    # 16-bit positions, and impacts of 32 bits or, in a block with larger ones, of 64
    offsets, v = np.frombuffer(row.offsets, np.int32), np.frombuffer(row.impacts, np.int32 if len(row.impacts) == 2 * len(row.positions) else np.int64)
    dims = max(row.dims, 1)
    top = (len(offsets) - 1) // dims
    m = np.zeros((len(ids), dims), np.int64)
    m[at, np.repeat(np.arange(len(offsets) - 1) % dims, np.diff(offsets))] = v
    segments = [(top - i // dims, i % dims, at[offsets[i] : offsets[i + 1]], v[offsets[i] : offsets[i + 1]]) for i in np.flatnonzero(np.diff(offsets))]
    return ids, m, segments


def _wide(m: np.ndarray) -> np.ndarray:
    return ((m >= LIMIT) | (m <= -LIMIT)).any(1)


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products row by row; one that no long holds is an error, as in SQL."""
    out = np.einsum("ij,ij->i", a, b)
    for i in np.flatnonzero(np.einsum("ij,ij->i", np.abs(a.astype(np.float64)), np.abs(b.astype(np.float64))) >= LONG / 2):
        s = sum(x * y for x, y in zip(a[i].tolist(), b[i].tolist()))
        if not -(2**63) <= s < 2**63:
            raise OverflowError("a score is beyond 64 bits")
        out[i] = s
    return out


class _Top:
    """The k best (score, vector) so far of each query, ties to the smaller id."""

    def __init__(self, queries: np.ndarray, k: int):
        self.k, self.score, self.ids = k, np.full((len(queries), k), -np.iinfo(np.int64).max), np.full((len(queries), k), np.iinfo(np.int64).max)

    def floor(self, s: np.ndarray) -> np.ndarray:
        return self.score[s, -1]

    def add(self, q: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        touched = np.unique(q)
        q, ids, score = np.concatenate([np.repeat(touched, self.k), q]), np.concatenate([self.ids[touched].ravel(), ids]), np.concatenate([self.score[touched].ravel(), score])
        order = np.lexsort((ids, -score, q))
        q, ids, score = q[order], ids[order], score[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        keep = rank < self.k
        self.score[q[keep], rank[keep]], self.ids[q[keep], rank[keep]] = score[keep], ids[keep]


def _search_block(ids: np.ndarray, exact: np.ndarray, segments: list[tuple], qid: np.ndarray, qs: np.ndarray, top: _Top) -> int:
    """Adds the block's best to top; how many pairs were scored exactly."""
    dims = max(exact.shape[1], qs.shape[1])
    wide = lambda m: np.pad(m, ((0, 0), (0, dims - m.shape[1]))) if m.shape[1] < dims else m
    exact, qs = wide(exact), wide(qs)
    big_q, big, scored = _wide(qs), _wide(exact), 0
    for some, rows in ((np.flatnonzero(big_q), np.arange(len(ids))), (np.flatnonzero(~big_q), np.flatnonzero(big))):
        step = max(1, (1 << 18) // max(len(rows), 1))
        for lo in range(0, len(some) if len(rows) else 0, step):
            x, y = np.repeat(some[lo : lo + step], len(rows)), np.tile(rows, len(some[lo : lo + step]))
            other = qid[x] != ids[y]
            scored += int(other.sum())
            if other.any():
                top.add(x[other], ids[y[other]], _dots(qs[x[other]], exact[y[other]]))
    if big.any():
        small = np.cumsum(~big) - 1
        segments = [(b, d, small[at[~big[at]]], v[~big[at]]) for b, d, at, v in segments]
    narrow = np.flatnonzero(~big_q)
    for lo in range(0, len(narrow) if (~big).any() else 0, BATCH):
        scored += _search_segments(ids[~big], exact[~big], segments, qid, qs, narrow[lo : lo + BATCH], top)
    return scored


def _search_segments(ids: np.ndarray, exact: np.ndarray, segments: list[tuple], qid: np.ndarray, qs: np.ndarray, s: np.ndarray, top: _Top) -> int:
    """Queries at the places s and a block's vectors, all impacts below LIMIT: score at a time.

    Segments are read by what they can still add to some query, impact times weight, the largest first.
    A pair's accumulator grows by the postings read; what the dimensions not yet read for it may add is
    below the next segment's power of two times the weight. When that has halved, pairs that provably
    cannot reach their query's k-th score are out, and queries with few pairs left are done.
    """
    n, dims = exact.shape
    q, own, size = qs[s].T.astype(np.float64), qid[s], np.abs(qs[s].T).astype(np.float64)
    limits = np.zeros(dims)  # every impact that is unread in a dimension is at most this
    for band, d, at, _ in segments:
        if len(at):
            limits[d] = max(limits[d], 2.0**band - 1)
    order = sorted((x for x in segments if len(x[2])), key=lambda x: (-size[x[1]].max(initial=0) * 2.0 ** x[0], x[1]))
    # a float sum of so many terms is off by at most this share of the sum of their magnitudes
    share = (dims + 8) * 2.0**-50
    error = share * (size.T @ limits)
    score, unread = np.zeros((n, len(s))), np.ones((n, dims))
    possible, live = ids[:, None] != own[None, :], np.arange(len(s))
    last, scored = float((limits @ size).sum()), 0

    def finish(columns: np.ndarray) -> int:
        b, a = np.nonzero(possible[:, columns])
        for i in range(0, len(a), 1 << 18):
            x, y = s[columns[a[i : i + (1 << 18)]]], b[i : i + (1 << 18)]
            top.add(x, ids[y], _dots(qs[x], exact[y]))
        return len(a)

    for i, (band, d, at, v) in enumerate(order):
        if len(live) == len(s):
            score[at] += v[:, None] * q[d][None, :]
        else:
            score[np.ix_(at, live)] += v[:, None] * q[d, live][None, :]
        unread[at, d] = 0
        limits[d] = 2.0 ** (band - 1) - 1
        left = float((limits @ size[:, live]).sum())
        if left > last / 2 and i < len(order) - 1:
            continue
        last = left
        rest = unread @ (limits[:, None] * size[:, live])
        have = score[:, live]
        floor = top.floor(s[live]).astype(np.float64)
        if n > top.k:  # the k-th best of what each pair has for certain is reached by k vectors
            sure = np.where(possible[:, live], have - rest, -np.inf)
            floor = np.maximum(floor, np.partition(sure, n - top.k, axis=0)[n - top.k])
        slack = 0.5 + error[live] + 2.0**-51 * np.abs(np.where(np.isfinite(floor), floor, 0.0))
        possible[:, live] &= have + rest >= floor - slack
        few = possible[:, live].sum(0) <= 4 * top.k
        if few.any():
            scored += finish(live[few])
            live = live[~few]
        if not len(live):
            break
    return scored + (finish(live) if len(live) else 0)


def search(index: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest inner products with other vectors, ties to smaller ids.

    Queries go out in waves of at most WAVE rows, a size fixed beforehand; each index block meets each
    wave once and sends k rows a query and task. A shorter vector counts as zero in the dimensions it
    lacks. Fewer than k candidates: all of them. A query repeated under one id is searched once, other
    vectors under that id share its ranking; candidates repeated under one id are one candidate each. No queries or no index: no rows.
    """
    spark = index.sparkSession
    queries = stored(queries.select("vec_id", "impacts").dropDuplicates(["vec_id", "impacts"]).repartitionByRange("vec_id"), "queries")

    def wave_of(rows: list) -> DataFrame:
        """A wave's best of each task, stored; its queries leave the executors when it is done."""
        wave = spark.sparkContext.broadcast((np.array([r[0] for r in rows], np.int64), _matrix([r[1] for r in rows])))

        def task(blocks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            qid, qs = wave.value
            top = _Top(qs, k)
            for batch in blocks:
                for row in batch.itertuples():
                    _search_block(*_postings(row), qid, qs, top)
            q, r = np.nonzero(top.ids != np.iinfo(np.int64).max)
            yield pd.DataFrame({"query_id": qid[q], "vec_id": top.ids[q, r], "score": top.score[q, r]})

        out = stored(index.mapInPandas(task, "query_id long, vec_id long, score long"), "found")
        wave.destroy()
        return out

    found, rows = None, []
    for r in queries.toLocalIterator():
        rows.append(r)
        if len(rows) == WAVE:
            found, rows = wave_of(rows) if found is None else found.unionAll(wave_of(rows)), []
    if rows or found is None:
        found = wave_of(rows) if found is None else found.unionAll(wave_of(rows))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1(spark, sf_dir: str) -> DataFrame:
    vectors = impacts(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
    return search(stored(build_index(vectors), "impact-index"), vectors.where(F.col("vec_id") % 50 == 0))


SQL = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, e.vec_id, list_sum(list_transform(generate_series(1, least(len(q.v), len(e.v))), lambda i: q.v[i] * e.v[i]))::BIGINT AS score
      FROM e AS q JOIN e ON q.vec_id <> e.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 5"""

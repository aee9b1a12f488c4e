"""Vector code compression: product codes of integer vectors, learned by Lloyd rounds with Hamerly's bounds.

A vector is cut into equal parts and each part is replaced by the index of its codebook's nearest entry.
Every part of every vector keeps two numbers from round to round: an upper bound on its distance to its
own entry and a lower bound on its distance to any other. Entries' moves widen both; only where the upper
bound is not strictly below are all entries of the codebook scanned, in integers, ties to the lower index.
Bounds travel with the vectors in a stored table a round; sums by entry are made in the tasks and added in
Spark; the driver holds the codebooks alone, PARTS x ENTRIES entries however many vectors there are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import join_checked, stored

PARTS, ENTRIES, SCALE, ROUNDS = 4, 256, 1024, 4
#: Components at or beyond this raise an error: their differences would be no longs.
LIMIT = 2.0**61
#: A lower bound where a codebook has one entry.
FAR = 2**60
STATE = "vec_id long, label string, v binary, code binary, upper binary, lower binary"


def integers(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, v): floor(scale * x) per component; vectors null or with null or non-finite parts are left out."""
    ok = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))

    def whole(x):
        y = F.floor(x.cast("double") * scale)
        return F.when(F.abs(x.cast("double") * scale) < LIMIT, y).otherwise(F.raise_error(F.lit("a component is too large for integer distances")).cast("long"))

    return vectors.where(ok).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.transform("embedding", whole).alias("v"))


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of n parts to k entries: by floats where all sums are below 2^53, else by longs, else by unbounded integers."""
    top = max(int(abs(x).max(initial=0)), int(abs(c).max(initial=0)))
    most = max(x.shape[1], 1) * (2 * top) ** 2
    if most < 2**53:
        a, b = x.astype(float), c.astype(float)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None]).astype(np.int64)
    if most >= 2**63:
        x, c = x.astype(object), c.astype(object)
    return np.stack([((x - e) ** 2).sum(1) for e in c], 1)


def own_squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of n parts to n entries, pair by pair."""
    top = max(int(abs(x).max(initial=0)), int(abs(c).max(initial=0)))
    if max(x.shape[1], 1) * (2 * top) ** 2 >= 2**63:
        x, c = x.astype(object), c.astype(object)
    return ((x - c) ** 2).sum(1)


def above(d2: np.ndarray) -> np.ndarray:
    """An integer not below the distance; roots of what no long holds count as FAR."""
    return np.minimum(np.sqrt(d2.astype(float)), float(FAR)).astype(np.int64) + 1


def below(d2: np.ndarray) -> np.ndarray:
    return np.maximum(np.minimum(np.sqrt(d2.astype(float)), float(FAR)).astype(np.int64) - 1, 0)


class Moves:
    """What a round needs of two codebooks of one part: how far entries moved, and half the way to each one's nearest other."""

    def __init__(self, old: np.ndarray, new: np.ndarray):
        self.move = np.where((old == new).all(1), 0, above(own_squared(old, new)))
        order = np.argsort(-self.move, kind="stable")
        first, second = int(order[0]), int(order[1]) if len(order) > 1 else int(order[0])
        self.others = np.full(len(new), self.move[first])
        self.others[first] = self.move[second] if len(order) > 1 else 0
        d2 = squared(new, new).astype(float)
        np.fill_diagonal(d2, np.inf)
        self.half = np.minimum(np.sqrt(d2.min(1)) / 2, float(FAR)).astype(np.int64) - 1


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A full scan: index of the nearest entry, least index of equals, and both bounds."""
    d2 = squared(x, c)
    at = d2.argmin(1)
    rows = np.arange(len(x))
    least = d2[rows, at]
    if len(c) == 1:
        return at, above(least), np.full(len(x), FAR)
    d2[rows, at] = d2.max() + 1
    return at, above(least), below(d2.min(1))


def assign(x: np.ndarray, c: np.ndarray, before: tuple | None, moves: Moves | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Assignments and bounds of n parts, and how many were scanned in full."""
    if before is None:
        return *nearest(x, c), len(x)
    at, upper, lower = (a.copy() for a in before)
    upper += moves.move[at]
    lower = np.maximum(lower - moves.others[at], 0)
    safe = np.maximum(lower, moves.half[at])
    doubt = np.flatnonzero(upper >= safe)
    if len(doubt):
        upper[doubt] = above(own_squared(x[doubt], c[at[doubt]]))
        doubt = doubt[upper[doubt] >= safe[doubt]]
    if len(doubt):
        at[doubt], upper[doubt], lower[doubt] = nearest(x[doubt], c)
    return at, upper, lower, len(doubt)


def stacked(b: pd.DataFrame, parts: int, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(b["v"]), "<i8").reshape(len(b), parts, width)


def carried(b: pd.DataFrame, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    at = np.frombuffer(b"".join(b["code"]), np.uint8).reshape(len(b), parts).astype(np.int64)
    return at, *(np.frombuffer(b"".join(b[k]), "<i8").reshape(len(b), parts) for k in ("upper", "lower"))


def pack(rows: np.ndarray, kind: str) -> list[bytes]:
    return [r.tobytes() for r in np.ascontiguousarray(rows.astype(kind))]


def packed(vectors: DataFrame, width: int) -> DataFrame:
    """The vectors as bytes, without bounds yet."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"vec_id": b["vec_id"].astype("Int64"), "label": b["label"], "v": [np.asarray(v, "<i8").tobytes() for v in b["v"]], "code": None, "upper": None, "lower": None})

    return vectors.where(F.size("v") == width).mapInPandas(rows, STATE)


def assigned(state: DataFrame, books: np.ndarray, old: np.ndarray | None, scanned=None) -> DataFrame:
    """Every part of every vector with its nearest entry and its bounds. scanned: an accumulator of full scans."""
    parts, _, width = books.shape
    sent = state.sparkSession.sparkContext.broadcast((books, old))

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        new, was = sent.value
        moves = [Moves(was[p], new[p]) for p in range(parts)] if was is not None else [None] * parts
        for b in batches:
            x, before = stacked(b, parts, width), carried(b, parts) if was is not None else None
            got = [assign(x[:, p], new[p], tuple(a[:, p] for a in before) if before else None, moves[p]) for p in range(parts)]
            if scanned is not None:
                scanned.add(sum(g[3] for g in got))
            yield pd.DataFrame({"vec_id": b["vec_id"].astype("Int64"), "label": b["label"], "v": b["v"], "code": pack(np.stack([g[0] for g in got], 1), "u1"), "upper": pack(np.stack([g[1] for g in got], 1), "<i8"), "lower": pack(np.stack([g[2] for g in got], 1), "<i8")})

    return state.mapInPandas(rows, STATE)


def moved(state: DataFrame, books: np.ndarray) -> np.ndarray:
    """Each entry replaced by the floor of its parts' mean; an entry without parts stays. Tasks send one sum an entry."""
    parts, entries, width = books.shape

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, s = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), object)
        for b in batches:
            x, at = stacked(b, parts, width), carried(b, parts)[0]
            small = int(abs(x).max(initial=0)) * len(b) < 2**62
            for p in range(parts):
                n[p] += np.bincount(at[:, p], minlength=entries)
                add = np.zeros((entries, width), np.int64 if small else object)
                np.add.at(add, at[:, p], x[:, p] if small else x[:, p].astype(object))
                s[p] += add
        p, e = np.nonzero(n)
        yield pd.DataFrame({"part": p, "entry": e, "n": n[p, e], "s": [[str(v) for v in r] for r in s[p, e]]})

    told = state.mapInPandas(sums, "part int, entry int, n long, s array<string>").select("part", "entry", "n", F.posexplode("s").alias("pos", "s"))
    got = told.groupBy("part", "entry", "pos").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    out = books.copy()
    for r in got:
        out[r.part, r.entry, r.pos] = int(r.s) // r.n
    return out


def learn(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scanned=None) -> tuple[DataFrame, np.ndarray]:
    """The state after the last assignment, and the final codebooks (part, entry, position).

    vectors are integers() in a stored table. Codebooks start as the parts of the vectors with the smallest
    vec_id (null last, of equal ids the vector that is less). All vectors must be as long as the first of
    these; where that length is no multiple of parts there are no codebooks and no state rows.
    """
    first = [r.v for r in vectors.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()]
    length = len(first[0]) if first else 0
    width = length // parts
    first = [v for v in first if len(v) == length and width * parts == length]
    books = np.array(first, np.int64).reshape(len(first), parts, width).transpose(1, 0, 2).copy()
    if not first:
        return packed(vectors, -2), books
    state, old = stored(packed(vectors, length), "vectors"), None
    for _ in range(rounds):
        state = stored(assigned(state, books, old, scanned), "assigned")
        old, books = books, moved(state, books)
    return assigned(state, books, old, scanned), books


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def vector_codes(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """(vec_id, label, code, error, label_error, codebooks_sha256) of every kept row.

    Kept are rows whose vector is not null and holds neither null nor non-finite components; an empty table
    gives an empty table. code is parts x two hex digits, error the sum of squared distances, label_error
    its sum over rows with an equal label (all null labels are one). A vector of another length than that of
    the smallest vec_id, or of a length that parts does not divide, has null code and error. Repeated rows
    are rows like others and count as often as they occur. A component of 2^61 and more or an error that no long
    holds is an error when it is read, never a wrong number. Other columns are not looked at.
    """
    kept = stored(integers(vectors), "integers")
    state, books = learn(kept, parts, entries, rounds)
    width = books.shape[2]
    sent = kept.sparkSession.sparkContext.broadcast(books)

    def ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x, at = stacked(b, parts, width), carried(b, parts)[0]
            error = sum((own_squared(x[:, p], sent.value[p][at[:, p]]) for p in range(parts)), np.zeros(len(b), np.int64))
            yield pd.DataFrame({"vec_id": b["vec_id"].astype("Int64"), "label": b["label"], "code": ["".join(f"{i:02x}" for i in r) for r in at], "error": [int(e) for e in error]})

    coded = state.mapInPandas(ends, "vec_id long, label string, code string, error long")
    odd = kept.where(F.size("v") != (width * parts if books.shape[1] else -2)).select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    coded = stored(coded.unionByName(odd).withColumn("_l", F.coalesce("label", F.lit(""))).withColumn("_n", F.col("label").isNull()), "coded")
    sums = stored(coded.groupBy("_l", "_n").agg(F.sum("error").alias("label_error")), "labels")
    return join_checked(coded, sums, ["_l", "_n"]).select("vec_id", "label", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def op11(spark, sf_dir: str) -> DataFrame:
    return vector_codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")).drop("label")


def _sql() -> str:
    d2 = "list_dot_product(x, x) - 2 * list_dot_product(x, c) + list_dot_product(c, c)"
    out = [
        f"""k AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"q AS MATERIALIZED (SELECT r, p, v[p * len(v) // {PARTS} + 1 : (p + 1) * len(v) // {PARTS}] AS x FROM k, range({PARTS}) t(p))",
        f"c0 AS MATERIALIZED (SELECT p, r - 1 AS e, x AS c FROM q WHERE r <= {ENTRIES})",
    ]
    for i in range(ROUNDS + 1):
        out.append(f"a{i} AS MATERIALIZED (SELECT r, p, arg_min(e, struct_pack(d, e)) AS e, min(d) AS d FROM (SELECT r, p, e, {d2} AS d FROM q JOIN c{i} USING (p)) GROUP BY r, p)")
        if i < ROUNDS:
            out.append(f"m{i} AS (SELECT p, e, list(y ORDER BY j) AS c FROM (SELECT p, e, j, floor(sum(x[j]) / count(*)) AS y FROM q JOIN a{i} USING (r, p), range(1, (SELECT max(len(x)) FROM q) + 1) t(j) GROUP BY p, e, j) GROUP BY p, e)")
            out.append(f"c{i + 1} AS MATERIALIZED (SELECT p, e, coalesce(m.c, o.c) AS c FROM c{i} o LEFT JOIN m{i} m USING (p, e))")
    return f"""WITH {", ".join(out)},
  f AS (SELECT r, string_agg(printf('%02x', e::BIGINT), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY r),
  s AS (SELECT sha256(string_agg(CAST(y AS BIGINT)::VARCHAR, ',' ORDER BY p, e, j)) AS h FROM (SELECT p, e, generate_subscripts(c, 1) AS j, unnest(c) AS y FROM c{ROUNDS}))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM k JOIN f USING (r), s"""


SQL = _sql()

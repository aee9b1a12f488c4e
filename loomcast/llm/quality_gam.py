"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature is binned; shallow trees on one feature at a time are boosted in a cycle, and their sums
are that feature's lookup table. The pairs that explain most of what is left get tables over two
features in the same way. A score is the logistic of an intercept plus table look-ups, added by batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FEATURES = ["log_bytes", "log_words", "word_len", "long_words", "upper", "digit", "punct", "symbol", "non_ascii", "bang", "pipe", "stop", "comma", "lines", "dup_lines", "distinct", "capital_words", "odd_endings"]

_CLASS = np.zeros(256, np.uint8)
for _kind, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"\"'()-:;?", b"#$%&*+/<=>@[\\]^_`{}~", bytes(range(128, 256)), b"!", b"|", b".", b",", b"\n", b" \t\r\x0b\x0c"), 1):
    _CLASS[list(_chars)] = _kind


def features(text: str | None) -> list[float]:
    """What the whole text shows; null counts as empty."""
    raw = (text or "").encode("utf-8", "replace")
    n, words = len(raw), raw.split()
    w, kinds = len(words), np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=12)
    inked = max(n - kinds[10] - kinds[11], 1)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    share = lambda x, of: x / of if of else 0.0
    return [
        np.log1p(n), np.log1p(w), share(inked, w), share(sum(len(x) > 18 for x in words), w),
        *(kinds[i] / inked for i in range(1, 10)),
        np.log1p(kinds[10]), 1 - share(len(set(lines)), len(lines)) if lines else 0.0, share(len(set(words)), w),
        share(sum(x.isupper() for x in words), w), share(sum(not x[-1:].isalnum() and x[-1] < 128 and not x[-2:-1].isalnum() for x in words), w),
    ]


@dataclass
class Gam:
    intercept: float = 0.0
    edges: list = field(default_factory=list)
    tables: list = field(default_factory=list)
    pairs: list = field(default_factory=list)  # (feature, feature, coarse table)
    coarse: int = 4

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], 1)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.intercept)
        if self.edges:
            b = self.bins(x)
            for j, t in enumerate(self.tables):
                out += t[b[:, j]]
            for i, j, t in self.pairs:
                out += t[b[:, i] // self.coarse, b[:, j] // self.coarse]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def _leaf(g: float, h: float, ridge: float) -> float:
    return g / (h + ridge)


def _split(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, int]:
    """The best gain and place to cut a run of bins in two."""
    if len(g) < 2:
        return 0.0, 0
    a, b = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gain = a**2 / (b + ridge) + (g.sum() - a) ** 2 / (h.sum() - b + ridge) - g.sum() ** 2 / (h.sum() + ridge)
    at = int(gain.argmax())
    return float(gain[at]), at + 1


def _tree(g: np.ndarray, h: np.ndarray, ridge: float, depth: int = 2) -> np.ndarray:
    gain, at = _split(g, h, ridge) if depth else (0.0, 0)
    if gain <= 1e-9:
        return np.full(len(g), _leaf(g.sum(), h.sum(), ridge))
    return np.concatenate([_tree(g[:at], h[:at], ridge, depth - 1), _tree(g[at:], h[at:], ridge, depth - 1)])


def _pair_tree(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """A cut in one feature, then one of the other feature on each side; the better of both orders."""
    best = (-1.0, np.zeros_like(g))
    for turn in (False, True):
        G, H = (g.T, h.T) if turn else (g, h)
        _, at = _split(G.sum(1), H.sum(1), ridge)
        out, total = np.zeros_like(G), 0.0
        for s in (slice(0, at), slice(at, len(G))):
            gain, cut = _split(G[s].sum(0), H[s].sum(0), ridge)
            for t in (slice(0, cut), slice(cut, G.shape[1])):
                x, y = G[s, t].sum(), H[s, t].sum()
                out[s, t] = _leaf(x, y, ridge)
                total += x**2 / (y + ridge)
        if total > best[0]:
            best = (total, out.T if turn else out)
    return best


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 80, rate: float = 0.15, max_bins: int = 32, max_pairs: int = 6, ridge: float = 2.0) -> Gam:
    """Boosts one shallow tree per feature in each round, then one per chosen pair. Without both classes: the smoothed prior."""
    prior = (y.sum() + 1) / (len(y) + 2)
    model = Gam(float(np.log(prior / (1 - prior))))
    if len(np.unique(y)) < 2:
        return model
    model.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, max_bins + 1)[1:-1])) for j in range(x.shape[1])]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    b, f = model.bins(x), np.full(len(y), model.intercept)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(f, -30, 30)))
        return y - p, np.maximum(p * (1 - p), 1e-6)

    for _ in range(rounds):
        for j, t in enumerate(model.tables):
            g, h = slopes()
            step = rate * _tree(np.bincount(b[:, j], g, len(t)), np.bincount(b[:, j], h, len(t)), ridge)
            t += step
            f += step[b[:, j]]
    c = b // model.coarse
    side = max_bins // model.coarse + 1

    def grids(i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        g, h = slopes()
        at = c[:, i] * side + c[:, j]
        return tuple(np.bincount(at, v, side * side).reshape(side, side) for v in (g, h))

    gains = sorted(((_pair_tree(*grids(i, j), ridge)[0], i, j) for i in range(x.shape[1]) for j in range(i)), reverse=True)
    model.pairs = [(i, j, np.zeros((side, side))) for _, i, j in gains[:max_pairs]]
    for _ in range(rounds // 2):
        for i, j, t in model.pairs:
            step = rate * _pair_tree(*grids(i, j), ridge)[1]
            t += step
            f += step[c[:, i], c[:, j]]
    return model


def _feature_rows(texts) -> np.ndarray:
    return np.array([features(t) for t in texts], float).reshape(-1, len(FEATURES))


def train(docs: DataFrame, labels: DataFrame, held_out: F.Column | None = None, max_rows: int = 12_000, **options) -> Gam:
    """Learn from at most max_rows labelled rows (quality 0 or 1), the first by a hash of their id.

    The sample bounds what the driver holds: max_rows rows of numbers. Rows for which held_out is true
    are never read. Null ids, labels other than 0 and 1 are void; of an id labelled twice the smallest
    label counts; of documents repeated under one id the one whose text has the least hash is the example.
    """
    chosen = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
    chosen = chosen.where(~held_out) if held_out is not None else chosen
    chosen = chosen.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", "text", F.xxhash64("text").alias("th"))

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "y": b["quality"].astype("int32"), "th": b["th"], "x": list(_feature_rows(b["text"]))})

    one = rows.mapInPandas(look, "doc_id long, y int, th long, x array<double>").groupBy("doc_id").agg(F.min("y").alias("y"), F.min(F.struct("th", "x"))["x"].alias("x"))
    got = one.toPandas().sort_values("doc_id")
    x = np.array(got["x"].tolist(), float).reshape(-1, len(FEATURES))
    return fit(x, got["y"].to_numpy(float), **options)


def classify(docs: DataFrame, model: Gam) -> DataFrame:
    """The documents with score and predicted, from the text alone and whole; null text counts as empty.

    Every row gets a score, repeated rows the same. Columns named score or predicted are replaced.
    """
    docs = docs.drop("score", "predicted")
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in texts:
            yield pd.Series(sent.value.score(_feature_rows(t)))

    out = docs.withColumn("score", score("text"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def fold(k: int) -> F.Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % k


def op7(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    model = train(docs, labels, held_out=fold(3) == 1)
    return classify(docs, model).select("doc_id", F.coalesce(fold(3) == 1, F.lit(False)).alias("held_out"), "score", "predicted")

"""Toxicity by compression distance: which of two zstandard dictionaries makes a document's windows shorter.

One dictionary is trained on ordinary text, two on toxic text, the second on what the first leaves. A window is
a word, said three times so that zstandard codes it rather than stores it. Its gain is its length under the
ordinary dictionary less its least length under a toxic one. How large a gain ordinary text shows by chance is measured for windows of each length:
these are the thresholds. A document is judged by the largest gain above its threshold and by how many
windows are above, through a logistic curve fitted to labelled documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: At this level zstandard looks for matches of three bytes. A longer word is several windows of at most PIECE bytes.
LEVEL, TIMES, PIECE = 19, 3, 64
#: Bytes of the dictionaries, toxic ones, windows of a length class that ordinary text may have above its threshold, rounds of training.
ORDINARY, TOXIC, TURNS, CHANCE, ROUNDS = 65_536, 8192, 2, 0.0003, 3
#: Windows are classed by length in steps of STEP bytes. Gains that a task remembers.
STEP, CLASSES, MEMO = 3, 71, 1 << 18
NONE = -9


def windows(text: str | None) -> set[bytes]:
    """The distinct windows of a whole text: its words, lower-cased; null counts as empty."""
    out = set((text or "").lower().encode("utf-8", "replace").split())
    for w in [w for w in out if len(w) > PIECE]:
        out.remove(w)
        out.update(w[i : i + PIECE] for i in range(0, len(w), PIECE))
    return out


def said(w: bytes) -> bytes:
    return (b" " + w) * TIMES + b" "


class Coder:
    """Lengths of windows under one dictionary."""

    def __init__(self, data: bytes):
        d = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_FULLDICT)
        d.precompute_compress(level=LEVEL)
        self.coder = zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)

    def lengths(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter((len(self.coder.compress(said(w))) for w in words), np.int64, len(words))


@dataclass
class Toxicity:
    prior: float = 0.5
    ordinary: bytes = b""
    toxic: list[bytes] = field(default_factory=list)
    thresholds: np.ndarray = field(default_factory=lambda: np.zeros(CLASSES))
    weights: np.ndarray | None = None

    def gauge(self) -> Gauge:
        return Gauge(self)

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), self.prior)
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + x @ self.weights[1:], -30, 30)))


def classes(words: list[bytes]) -> np.ndarray:
    return np.minimum(np.fromiter(map(len, words), np.int64, len(words)) * TIMES // STEP, CLASSES - 1)


class Gauge:
    """Features of documents; remembers windows' gains, at most MEMO of them."""

    def __init__(self, model: Toxicity):
        self.thresholds, self.memo = model.thresholds, {}
        self.ordinary, self.toxic = (Coder(model.ordinary), [Coder(t) for t in model.toxic]) if model.toxic else (None, [])

    def gains(self, words: list[bytes]) -> np.ndarray:
        return self.ordinary.lengths(words) - np.min([t.lengths(words) for t in self.toxic], axis=0)

    def features(self, text: str | None) -> list[float]:
        """The largest gain over its threshold, how many are over it by 1, by 2 and by more, and how many windows there are."""
        found, memo = windows(text), self.memo
        new = [w for w in found if w not in memo] if self.toxic else []
        fresh = {}
        for i in range(0, len(new), MEMO):
            part = new[i : i + MEMO]
            gain = self.gains(part) - self.thresholds[classes(part)]
            fresh.update((w, int(g)) for w, g in zip(part, gain.tolist()) if g > 0) if len(new) > MEMO else fresh.update(zip(part, gain.astype(int).tolist()))
        over = sorted((g for w in found if (g := fresh.get(w, memo.get(w, NONE))) > 0), reverse=True)
        if len(memo) + len(new) > MEMO:
            memo.clear()
        if len(new) <= MEMO:
            memo.update(fresh)
        return [float(min(over[0], 6)) if over else 0.0, np.log1p(len(over)), np.log1p(sum(g > 1 for g in over)), np.log1p(sum(g > 2 for g in over)), np.log1p(len(found)) / 10]

    def rows(self, texts) -> np.ndarray:
        return np.array([self.features(t) for t in texts], float).reshape(-1, 5)


def dictionary(words: list[bytes], weight: np.ndarray, size: int, samples: int, seed: int) -> bytes:
    """A dictionary trained on windows drawn by weight; empty where there is too little to train on."""
    if not len(words):
        return b""
    drawn = np.random.default_rng(seed).choice(len(words), samples, p=weight / weight.sum())
    try:
        return zstandard.train_dictionary(size, [said(words[i]) for i in drawn]).as_bytes()
    except zstandard.ZstdError:
        return b""


def calibrated(words: list[bytes], n: np.ndarray, gain: np.ndarray, chance: float) -> np.ndarray:
    """For each class of length the least gain, 1 at least, that no more than the share chance of ordinary windows exceeds; classes not seen let nothing pass."""
    out, at = np.full(CLASSES, 99), classes(words)
    for k in np.unique(at):
        m = np.flatnonzero(at == k)
        m = m[np.argsort(-gain[m], kind="stable")]
        passed = np.searchsorted(np.cumsum(n[m]), chance * n[m].sum(), side="right")
        if n[m].sum() >= 30:
            out[k] = max(1, gain[m[min(passed, len(m) - 1)]])
    return out


def compare(toxic: pd.DataFrame, plain: pd.DataFrame, documents: int, chance: float = CHANCE) -> Toxicity:
    """The dictionaries and the thresholds from tables (w, n) of windows with the number of documents that hold them.

    Toxic text is mostly ordinary. So a toxic dictionary is first trained on those windows of toxic documents
    that recur in several and that the ordinary dictionary codes worse than is usual for their length, and then
    twice on the windows that it codes better than any but a few ordinary ones. The next one begins with those
    of the first windows that none before has caught.
    """
    kt, nt = toxic["w"].tolist(), toxic["n"].to_numpy(float)
    ko, no = plain["w"].tolist(), plain["n"].to_numpy(float)
    model = Toxicity(ordinary=dictionary(ko, no, ORDINARY, 60_000, 1))
    if not model.ordinary or not kt:
        return model
    coder = Coder(model.ordinary)
    lt, lo = coder.lengths(kt), coder.lengths(ko)
    at, of = classes(ko), classes(kt)
    usual = np.bincount(at, lo * no, CLASSES) / np.maximum(np.bincount(at, no, CLASSES), 1e-9)
    pool = (lt > usual[of]) & (np.bincount(at, no, CLASSES)[of] > 0) & (nt >= max(2, 0.01 * documents))
    best_t, best_o = np.full(len(kt), 1 << 20), np.full(len(ko), 1 << 20)
    for turn in range(TURNS):
        chosen, data = pool, b""
        for again in range(ROUNDS):
            new = dictionary([kt[i] for i in np.flatnonzero(chosen)], nt[chosen] ** 2, TOXIC, 20_000, 2 + turn * ROUNDS + again)
            if not new:
                break
            data, coder = new, Coder(new)
            own_t, own_o = coder.lengths(kt), coder.lengths(ko)
            chosen = (lt - own_t > calibrated(ko, no, lo - own_o, chance)[of]) & (nt >= 2)
        if not data:
            break
        model.toxic.append(data)
        best_t, best_o = np.minimum(best_t, own_t), np.minimum(best_o, own_o)
        model.thresholds = calibrated(ko, no, lo - best_o, chance)
        pool = pool & (lt - best_t <= model.thresholds[of])
    return model


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, steps: int = 60) -> np.ndarray:
    """Weights, the constant first, by damped Newton steps."""
    a = np.column_stack([np.ones(len(x)), x])
    w, keep = np.zeros(a.shape[1]), ridge * np.eye(a.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        w = w + np.clip(np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + keep, a.T @ (y - p) - keep @ w), -2, 2)
    return w


def train(docs: DataFrame, labels: DataFrame, held_out: F.Column | None = None, max_rows: int = 8000, max_windows: int = 150_000) -> Toxicity:
    """Learn from at most max_rows labelled rows (toxic 0 or 1), the first by a hash of their id.

    Of their windows the max_windows that most toxic and most ordinary documents hold train the dictionaries:
    both numbers bound what the driver holds. Rows for which held_out is true are never read. Null ids and
    labels other than 0 and 1 are void; of an id labelled twice the smallest label counts; of documents
    repeated under one id the one whose text has the least hash is the example. Without both labels, or with
    too little text to train on, every score is the smoothed share of toxic examples.
    """
    chosen = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
    chosen = chosen.where(~held_out) if held_out is not None else chosen
    chosen = chosen.groupBy("doc_id").agg(F.min("toxic").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "y", "text", F.xxhash64("text").alias("th"))
    rows = rows.groupBy("doc_id").agg(F.min("y").cast("int").alias("y"), F.min(F.struct("th", "text"))["text"].alias("text"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for y, t in zip(b["y"], b["text"]):
                found = sorted(windows(t))
                yield pd.DataFrame({"y": np.full(len(found), y, "int32"), "w": found})

    counts = rows.mapInPandas(cut, "y int, w binary").groupBy("y", "w").agg(F.count(F.lit(1)).alias("n"))
    toxic, plain = (counts.where(F.col("y") == y).orderBy(F.desc("n"), "w").limit(max_windows).select("w", "n").toPandas() for y in (1, 0))
    ys = dict(rows.groupBy("y").count().collect())
    for t in (toxic, plain):
        t["w"] = t["w"].map(bytes)
    model = compare(toxic, plain, ys.get(1, 0))
    model.prior = (ys.get(1, 0) + 1) / (sum(ys.values()) + 2)
    if model.toxic and len(ys) == 2:
        sent = docs.sparkSession.sparkContext.broadcast(model)

        def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            gauge = sent.value.gauge()
            for b in batches:
                yield pd.DataFrame({"doc_id": b["doc_id"], "y": b["y"], "x": list(gauge.rows(b["text"]))})

        got = rows.mapInPandas(look, "doc_id long, y int, x array<double>").toPandas().sort_values("doc_id")
        model.weights = logistic(np.array(got["x"].tolist(), float).reshape(-1, 5), got["y"].to_numpy(float))
    return model


def classify(docs: DataFrame, model: Toxicity, least: float = 0.3) -> DataFrame:
    """The documents with score and predicted, from the text alone and whole; null text counts as empty.

    Every row gets a score, repeated rows the same, empty texts that of no window above a threshold. Columns
    named score or predicted are replaced, all others stay.
    """
    docs = docs.drop("score", "predicted")
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        gauge = sent.value.gauge()
        for t in texts:
            yield pd.Series(sent.value.score(gauge.rows(t)))

    return docs.withColumn("score", score("text")).withColumn("predicted", (F.col("score") >= least).cast("int"))


def fold(k: int) -> F.Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % k


def op12(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = train(docs, labels, held_out=fold(4) == 2)
    return classify(docs, model).select("doc_id", F.coalesce(fold(4) == 2, F.lit(False)).alias("held_out"), "score", "predicted")

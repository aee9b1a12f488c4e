"""The whole model over slots, and the stages of a run: prepare, train, evaluate, aggregate."""

from __future__ import annotations

import os
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import arrays
from ..operators import graph, ingest, learn, markov, metrics, sampling, shapes
from ..sources import usage as src
from ..sources.archives import write_numbers
from ..sources.tables import json_safe, write_json
from . import control
from .control import Experiment

#: Slots that seeds are chosen from, and slots that centroids are fitted on: bounds of the fit.
SEED_SLOTS, FIT_SLOTS = 500, 100_000


@dataclass
class WorkloadModel:
    """fit on filled slots (workload, t, <channel>_input, input_valid), then transform and predict_next.

    A slot without valid input has no membership and no state. All that is fitted has the size of the model.
    """

    channels: tuple[str, ...]
    k: int = 8
    order: int = 3
    decay: float = 0.02
    strength: float = 0.5
    blend: float = 0.5
    temperature: float = 0.25
    iterations: int = 10
    stats: dict | None = None
    centroids: list | None = None
    scale: float = 1.0
    matrix: list | None = None

    def vector(self) -> Column:
        return F.array(*[(F.col(f"{c}_input") - self.stats[f"{c}_mean"]) / max(self.stats[f"{c}_std"], 1e-4) for c in self.channels])

    def fit(self, slots: DataFrame) -> WorkloadModel:
        on = slots.where("input_valid")
        self.stats = {k: v or 0.0 for k, v in ingest.zscore_stats(on.select(*[F.col(f"{c}_input").alias(c) for c in self.channels]), list(self.channels)).first().asDict().items()}
        points = on.select(F.struct("workload", "t").alias("id"), self.vector().alias("x"))
        near = sampling.digest_sample(points, "id", SEED_SLOTS).select("x").collect()
        if not near:
            raise ValueError("no valid slot to fit on")
        x = np.unique(np.array([r[0] for r in near]), axis=0)
        d = ((x[:, None, :] - x[None, :, :]) ** 2).sum(2)
        self.k = min(self.k, len(x))
        seeds = on.sparkSession.createDataFrame([(i, x[j].tolist()) for i, j in enumerate(shapes.farthest_points(d, self.k))], "state int, c array<double>")
        sample = sampling.digest_sample(points, "id", FIT_SLOTS)
        keep = lambda df: on.sparkSession.createDataFrame(df.collect(), df.schema)  # noqa: E731  K rows
        found = shapes.k_means(sample, seeds, self.iterations, keep)
        self.centroids = sorted(r["c"] for r in found.collect())
        self.scale = shapes.membership_scale(shapes.assign(sample, self._centroid_rows(on.sparkSession))).first()[0] or 0.1
        pairs = {(r[0], r[1]): r[2] for r in markov.soft_transitions(self._long(self.transform(on))).collect()}
        w = np.array([[pairs.get((i, j), 0.0) + 1.0 for j in range(self.k)] for i in range(self.k)])
        self.matrix = (w / w.sum(1, keepdims=True)).tolist()
        return self

    def _centroid_rows(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(enumerate(self.centroids)), "state int, c array<double>")

    @staticmethod
    def _long(mu: DataFrame) -> DataFrame:
        return mu.select("workload", "t", F.posexplode("mu").alias("state", "mu"))

    def transform(self, slots: DataFrame) -> DataFrame:
        """(workload, t, mu, state); null where the input is not valid."""
        c = F.array(*[F.array(*map(F.lit, x)) for x in self.centroids])
        mu = F.when(F.col("input_valid"), arrays.slot_membership(self.vector(), c, self.scale, self.temperature))
        return slots.select("workload", "t", mu.alias("mu")).withColumn("state", F.when(F.col("mu").isNotNull(), arrays.argmax(F.col("mu"))))

    def predict_next(self, slots: DataFrame, deployment: DataFrame, as_of: int) -> DataFrame:
        """(workload, mu, <channels>): the slot as_of from earlier slots alone, for workloads with any."""
        seen = self.transform(slots.where(F.col("t") < as_of)).where("state is not null")
        spark, states = slots.sparkSession, range(self.k)
        last = seen.groupBy("workload").agg(F.max_by("mu", "t").alias("mu"), F.lit(0).alias("t"))
        moved = graph.neighbour_modulation(self._long(last), graph.overlaps(graph.incidence(deployment)), 1.0, 0.5, self.strength)
        matrix = spark.createDataFrame([(i, j, float(self.matrix[i][j])) for i in states for j in states], "from_state int, to_state int, p double")
        domain = spark.createDataFrame([(i,) for i in states], "state int")
        back = markov.backoff(seen, ["t"], domain, as_of, self.order, "hierarchical", self.decay)
        out = markov.blended(markov.dynamic(moved.select("workload", "state", "mu"), matrix), back, self.blend)
        rows = out.groupBy("workload").agg(F.sort_array(F.collect_list(F.struct("state", "p"))).alias("a")).select("workload", F.transform("a", lambda s: s["p"]).alias("mu"))
        return rows.select("*", *[self.decoded(F.col("mu"), i).alias(c) for i, c in enumerate(self.channels)])

    def decoded(self, mu: Column, channel: int) -> Column:
        """A channel's value of a membership, in the channel's own unit."""
        c = self.channels[channel]
        z = arrays.dot(mu, F.array(*[F.lit(float(x[channel])) for x in self.centroids]))
        return z * max(self.stats[f"{c}_std"], 1e-4) + self.stats[f"{c}_mean"]

    def record(self) -> dict:
        return json_safe(dict(self.__dict__))

    @classmethod
    def restored(cls, record: dict) -> WorkloadModel:
        return cls(**record | {"channels": tuple(record["channels"])})


def task_names(e: Experiment) -> list[str]:
    return [f"L{x}" for x in e.histories]


def prepare(spark: SparkSession, e: Experiment, base: str, run_dir: str) -> None:
    """slots (with split), deployment and counts under run_dir."""
    spec = e.spec(base)
    rows = src.read_source(spark, spec)
    obs = src.observations(rows, spec, e.start, e.end, e.step)
    chosen = ingest.top_workloads(ingest.workload_stats(obs), e.workloads).select("workload")
    obs = src.select_workloads(obs, chosen)
    names = [r.name for r in spec.rules]
    lo, hi = e.start // e.step, -(-e.end // e.step)
    slots = ingest.causal_fill(ingest.dense_grid(ingest.bucket_means(obs, names), lo, hi), names, e.fill)
    slots = slots.withColumn("split", ingest.split_of(F.col("t") - lo, hi - lo, e.splits[0], e.splits[1]))
    slots.write.mode("overwrite").option("compression", "zstd").partitionBy("split").parquet(f"{run_dir}/slots")
    node = ingest.majority_node(obs) if spec.node else chosen.withColumn("node", F.lit("all"))
    node.write.mode("overwrite").option("compression", "zstd").parquet(f"{run_dir}/deployment")
    write_json({"slots": spark.read.parquet(f"{run_dir}/slots").count(), "environment": control.environment()}, f"{run_dir}/prepared.json")


def split_bounds(e: Experiment) -> dict[str, tuple[int, int]]:
    lo, hi = e.start // e.step, -(-e.end // e.step)
    a, b = lo + int((hi - lo) * e.splits[0]), lo + int((hi - lo) * e.splits[0]) + int((hi - lo) * e.splits[1])
    return {"train": (lo, a), "validation": (a, b), "test": (b, hi)}


def origin_rows(mu: DataFrame, e: Experiment, history: int, split: str) -> DataFrame:
    """(origin, workload, t, h, mu, target, back): per origin of a split and horizon every workload with a state at the origin.

    back pools, over an origin's workloads, what came h slots after the current state within the last
    `history` slots, decayed by age plus h. Everything joins on equality: pairs of slots are sent to the
    origins that may see them.
    """
    start, end = split_bounds(e)[split]
    spark = mu.sparkSession
    lo = split_bounds(e)["train"][0]
    origins = spark.range(max(start, lo + history - 1), end - max(e.horizons), e.stride).select(F.col("id").alias("origin"))
    h = F.explode(F.array(*[F.lit(int(x)) for x in e.horizons])).alias("h")
    on = mu.where("state is not null")
    now = on.join(origins.withColumn("t", F.col("origin")), "t").select("origin", "workload", "t", "mu", "state", h)
    later = mu.select("workload", F.col("t").alias("at"), F.col("mu").alias("target"), F.col("state").alias("next"))
    rows = now.withColumn("at", F.col("t") + F.col("h")).join(later.select("workload", "at", "target"), ["workload", "at"], "left")
    pairs = on.select("workload", F.col("t").alias("j"), F.col("state").alias("cur"), h).withColumn("at", F.col("j") + F.col("h")).join(later.where("next is not null"), ["workload", "at"])
    reach = pairs.where(F.col("at") <= F.col("j") + history - 1).withColumn("origin", F.explode(F.sequence(F.col("at"), F.col("j") + history - 1))).join(origins, "origin")
    counts = reach.groupBy("origin", "cur", "h", "next").agg(F.sum(F.exp(-e.decay * (F.col("origin") - F.col("at") + F.col("h")))).alias("c"))
    by = counts.groupBy("origin", F.col("cur").alias("state"), "h").agg(F.map_from_entries(F.collect_list(F.struct("next", "c"))).alias("m"))
    k = F.size("mu")
    smoothed = F.transform(F.sequence(F.lit(0), k - 1), lambda s: F.coalesce(F.try_element_at(F.col("m"), s), F.lit(0.0)) + 1.0)
    back = F.when(F.col("m").isNotNull(), arrays.simplex(smoothed))
    return rows.join(by, ["origin", "state", "h"], "left").select("origin", "workload", F.col("t").cast("long"), F.col("h").cast("long"), "mu", "target", back.alias("back"))


def _blocks(e: Experiment, k: int) -> learn.Blocks:
    b = learn.Blocks(k, rounds=e.rounds, strength=e.strength, period=float(e.period), blend=e.blend, horizon=max(*e.horizons, 2) if e.strategy == "direct" else 1)
    return learn.variant(b, e.variant)


def _edges(deployment: DataFrame, e: Experiment) -> DataFrame:
    dep = graph.incidence(deployment)
    return graph.adjacency(dep) if e.variant == "hypergraph" else graph.hypergraph(dep)


def _packed(spark: SparkSession, e: Experiment, run_dir: str, model: WorkloadModel, history: int, split: str) -> DataFrame:
    path = f"{run_dir}/packed/L={history}/split={split}"
    mu = model.transform(spark.read.parquet(f"{run_dir}/slots"))
    rows = learn.pack(origin_rows(mu, e, history, split), _edges(spark.read.parquet(f"{run_dir}/deployment"), e))
    rows.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def train(spark: SparkSession, e: Experiment, run_dir: str, who: dict) -> bool:
    """One training per history length, resumed from its newest checkpoint. A recursive model learns one step ahead."""
    if e.strategy == "recursive":
        e = replace(e, horizons=(1,))
    channels = tuple(r["name"] for r in e.source["rules"])
    fitted = f"{run_dir}/model.json"
    if not os.path.exists(fitted):
        model = WorkloadModel(channels, e.k, e.order, e.decay, e.strength, e.blend)
        write_json(model.fit(spark.read.parquet(f"{run_dir}/slots").where("split = 'train'")).record(), fitted)
    model = WorkloadModel.restored(control.read_json(fitted))
    prior = np.array(model.matrix)

    def one(name: str) -> dict:
        history, folder = int(name[1:]), f"{run_dir}/checkpoints/{name}"
        packed = {s: _packed(spark, e, run_dir, model, history, s) for s in ("train", "validation")}
        old = control.newest_checkpoint(folder, who)
        state = learn.train(packed["train"], _blocks(e, model.k), prior, packed["validation"], e.epochs, rate=e.rate, seed=e.seed, state=learn.Training.load(old) if old else None, on_epoch=lambda s: control.save_checkpoint(folder, s.epoch, s.dump(), who))
        write_json(learn.encoded(state.best, _blocks(e, model.k)), f"{run_dir}/trained-{name}.json")
        return {"epochs": state.epoch, "best_loss": state.best_loss}

    return control.Tasks(run_dir, task_names(e)).run(one, control.Progress(run_dir))


def evaluate(spark: SparkSession, e: Experiment, run_dir: str) -> DataFrame:
    """Forecasts of the test split under forecasts/L=..., and metrics by history and horizon beside those of no change at all."""
    model = WorkloadModel.restored(control.read_json(f"{run_dir}/model.json"))
    prior, out = np.array(model.matrix), None
    for history in e.histories:
        p, b = learn.decoded(control.read_json(f"{run_dir}/trained-L{history}.json"))
        packed = _packed(spark, e, run_dir, model, history, "test")
        kind = dict(packed.select(F.explode("cohort").alias("r")).select("r.*").dtypes)["workload"]
        path = f"{run_dir}/forecasts/L={history}"
        if e.strategy == "recursive":
            past = learn.pack_histories(model.transform(spark.read.parquet(f"{run_dir}/slots")), _edges(spark.read.parquet(f"{run_dir}/deployment"), e), packed.select("origin"), history)
            hard = e.variant == "vo_markov"
            learn.roll_out_to(path, past, p, b, prior, max(e.horizons), 1 if hard else e.order, e.decay, history, hard, kind)
        else:
            learn.forecast(packed, p, b, prior, kind).write.mode("overwrite").parquet(path)
        truth = packed.select("origin", F.explode("cohort").alias("r")).select("origin", "r.workload", F.col("r.h").cast("int").alias("h"), "r.target", "r.mu").where("target is not null")
        long = truth.select("origin", "workload", "h", F.posexplode("target").alias("state", "truth"), "mu").withColumn("same", F.get("mu", F.col("state"))).drop("mu")
        both = long.join(spark.read.parquet(path).withColumnRenamed("p", "pred"), ["origin", "workload", "h", "state"])
        one = both.groupBy("origin", "workload", "h").agg((-F.sum(F.col("truth") * F.ln(F.greatest("pred", F.lit(metrics.EPS))))).alias("ce"), F.sum(F.pow(F.col("pred") - F.col("truth"), 2)).alias("brier"), F.sum(F.pow(F.col("same") - F.col("truth"), 2)).alias("brier_same"), (F.max_by("state", F.struct("pred", -F.col("state"))) == F.max_by("state", F.struct("truth", -F.col("state")))).cast("double").alias("hit"))
        by_h = one.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.avg("ce").alias("soft_ce"), F.avg("brier").alias("brier"), F.avg("brier_same").alias("brier_persistence"), F.avg("hit").alias("accuracy")).withColumn("L", F.lit(history))
        out = by_h if out is None else out.unionByName(by_h)
        metrics.evaluate_by(both, ["origin", "workload"], "h").write.mode("overwrite").parquet(f"{run_dir}/families_by_h/L={history}")
        scores = one.select("origin", "workload", "h", "ce", "brier", "hit", F.lit(1).cast("long").alias("valid"))
        metrics.bundle(scores, "origin", ["h", "workload"], "valid", ["ce", "brier", "hit"], "h", seed=e.seed).write.mode("overwrite").parquet(f"{run_dir}/bundle/L={history}")
    out.write.mode("overwrite").parquet(f"{run_dir}/metrics_by_h")
    return spark.read.parquet(f"{run_dir}/metrics_by_h")


def consolidate(spark: SparkSession, run_dir: str) -> DataFrame:
    """All histories' scores in one table, and what a plot by horizon needs of them, with intervals, as CSV."""
    every = spark.read.parquet(f"{run_dir}/families_by_h")
    every.write.mode("overwrite").parquet(f"{run_dir}/metrics_all_tasks")
    ends = spark.read.parquet(f"{run_dir}/bundle").where("axis = 'h'").select("L", F.col("key").cast("int").alias("h"), F.col("hit_low").alias("accuracy_low"), F.col("hit_high").alias("accuracy_high"), F.col("brier_degradation").alias("brier_degradation"))
    plot = every.join(ends, ["L", "h"], "left").select("L", "h", "n_samples", "accuracy", "accuracy_low", "accuracy_high", "mae", "js", "mcc", "brier", "brier_degradation")
    write_numbers(plot, f"{run_dir}/plot_data", ["L", "h"])
    return plot


def aggregate(spark: SparkSession, run_dir: str) -> DataFrame:
    """Metrics over all horizons by history, and each horizon's loss against the first."""
    consolidate(spark, run_dir)
    m = spark.read.parquet(f"{run_dir}/metrics_by_h")
    w = Window.partitionBy("L").orderBy("h")
    m.withColumn("degradation", F.col("brier") - F.first("brier").over(w)).write.mode("overwrite").parquet(f"{run_dir}/horizon_degradation")
    mean = [(F.sum(F.col(c) * F.col("n")) / F.sum("n")).alias(c) for c in ("soft_ce", "brier", "brier_persistence", "accuracy")]
    m.groupBy("L").agg(F.sum("n").alias("n"), *mean).write.mode("overwrite").option("header", True).csv(f"{run_dir}/metrics_all_h")
    return m

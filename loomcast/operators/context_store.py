"""Back-off counts as a stored table that grows: append, expire, look back, export and import by version.

A version is a folder of counts by (order, context, state, time) and one of every workload's last states. It
counts once a row of the log names it, which is written last, so a stopped append leaves nothing behind that
a reader sees. Counts of versions add up; expiry and import write a version that stands for all before it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .sequences import contexts

LOG = "version long, base long"


@dataclass
class ContextStore:
    """Counts of what follows every context of at most max_order states, pooled over workloads.

    path is a folder that driver and executors share. Events come in batches (workload, t, state and the
    columns of order); a batch's events lie after those of earlier batches of their workloads. An event
    without so many states before it has no context of that order. Null states are states like others.
    """

    spark: SparkSession
    path: str
    max_order: int
    order: tuple[str, ...]

    def log(self) -> list[tuple[int, int]]:
        """Committed versions with the version from which their counts add up, a row a version."""
        try:
            return sorted((r.version, r.base) for r in self.spark.read.schema(LOG).parquet(f"{self.path}/log").collect())
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return []
            raise

    def _commit(self, version: int, base: int, counts: DataFrame, tails: DataFrame) -> int:
        counts.write.mode("overwrite").parquet(f"{self.path}/counts/version={version}")
        tails.write.mode("overwrite").parquet(f"{self.path}/tails/version={version}")
        self.spark.range(1).select(F.lit(version).cast("long").alias("version"), F.lit(base).cast("long").alias("base")).coalesce(1).write.mode("append").parquet(f"{self.path}/log")
        return version

    def _tails(self, version: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/tails/version={version}")

    def append(self, events: DataFrame) -> int:
        """The new version. What a batch's first events follow is read from the last states that the version before has stored."""
        at = self.log()
        version, base = (at[-1][0] + 1, at[-1][1]) if at else (0, 0)
        rows = events.select("workload", "t", "state", F.struct(*self.order).alias("_o"), F.lit(0).alias("_back"))
        if at and self.max_order:
            old = self._tails(at[-1][0])
            known = old.join(events.select("workload").distinct(), "workload", "left_semi").select("workload", F.posexplode("states").alias("_back", "state"))
            rows = rows.unionByName(known.select("workload", "state", (-F.col("_back") - 1).alias("_back")), allowMissingColumns=True)
        place = ["_back", "_o"]  # what is known comes before the batch, the last of it last
        every = []
        for k in range(self.max_order + 1):
            seen = contexts(rows, place, k).where("_back = 0")
            every.append(seen.groupBy(F.lit(k).alias("order"), "ctx", "state", "t").agg(F.count(F.lit(1)).alias("n")))
        counts = every[0]
        for c in every[1:]:
            counts = counts.unionByName(c)
        last = rows.withColumn("_r", F.row_number().over(Window.partitionBy("workload").orderBy(*[F.desc(c) for c in place])) - 1).where(F.col("_r") < max(self.max_order, 1))
        tails = last.groupBy("workload").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "state"))), lambda s: s["state"]).alias("states"))
        if at and self.max_order:
            tails = tails.unionByName(old.join(events.select("workload").distinct(), "workload", "left_anti"))
        return self._commit(version, base, counts, tails)

    def stored(self, version: int | None = None) -> DataFrame:
        """(order, ctx, state, t, n) as of a version, the last one if none is named."""
        at = dict(self.log())
        version = max(at) if version is None else version
        paths = [f"{self.path}/counts/version={v}" for v in sorted(at) if at[version] <= v <= version]
        return self.spark.read.parquet(*paths).groupBy("order", "ctx", "state", "t").agg(F.sum("n").alias("n"))

    def counts(self, now: int, decay: float, max_age: int | None = None, version: int | None = None) -> DataFrame:
        """(order, ctx, state, c): each event before now, and at most max_age old, counts exp(-decay * age)."""
        age = F.lit(now) - F.col("t")
        fresh = (age > 0) if max_age is None else (age > 0) & (age <= max_age)
        return self.stored(version).where(fresh).groupBy("order", "ctx", "state").agg(F.sum(F.col("n") * F.exp(-decay * age)).alias("c"))

    def expire(self, cutoff: int) -> int:
        """A version without events before cutoff, merged into one folder; last states stay. Earlier versions can still be read."""
        at = self.log()
        return self._commit(at[-1][0] + 1, at[-1][0] + 1, self.stored().where(F.col("t") >= cutoff), self._tails(at[-1][0]))

    def export(self, path: str, version: int | None = None) -> None:
        """A version's counts and last states, merged, as a store of one version in another folder."""
        version = self.log()[-1][0] if version is None else version
        ContextStore(self.spark, path, self.max_order, self.order)._commit(0, 0, self.stored(version), self._tails(version))

    def load(self, path: str) -> int:
        """A version that holds what another store's last version holds, and nothing of this one's."""
        other, at = ContextStore(self.spark, path, self.max_order, self.order), self.log()
        new = at[-1][0] + 1 if at else 0
        return self._commit(new, new, other.stored(), other._tails(other.log()[-1][0]))

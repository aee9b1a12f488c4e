"""The same buckets and counts on streams: tumbling and hopping windows, sessions, keyed decayed state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle


def tumbling_means(rows: DataFrame, channels: list[str], size: str = "60 seconds", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Means per workload and window of ts; rows later than the watermark are dropped. slide makes windows hop."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return rows.withWatermark("ts", late).groupBy("workload", w.alias("w")).agg(F.count(F.lit(1)).alias("n"), *(F.avg(c).alias(c) for c in channels)).select("workload", F.col("w.start").alias("start"), "n", *channels)


def sessions(rows: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Runs of a workload's rows with no gap of that length.

    Spark's windows also merge where one begins as another ends, so theirs are a microsecond, the least step of a timestamp, shorter.
    """
    w = F.session_window("ts", f"{gap} -1 microseconds")
    return rows.withWatermark("ts", late).groupBy("workload", w.alias("s")).agg(F.count(F.lit(1)).alias("n")).select("workload", F.col("s.start").alias("start"), (F.col("s.end") + F.expr("INTERVAL 1 MICROSECOND")).alias("end"), "n")


def decayed_state(rows: DataFrame, states: int, decay: float, max_age: int) -> DataFrame:
    """(ctx, t, counts): per context the decayed counts of states as of each batch's last time.

    Input is (ctx, t long, in seconds, state int). A context keeps its recent events only: what is older than
    max_age leaves the state. Events that arrive out of order are sorted in while they are at most max_age
    behind the stream's last time; older ones are dropped. A context whose last event is older than that
    leaves the state whole, by the stream's own time and not by a clock; should it come again, it begins anew.
    """

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        t, s = (list(x) for x in state.get) if state.exists else ([], [])
        for b in batches:
            t, s = t + b["t"].tolist(), s + b["state"].tolist()
        order = np.argsort(t, kind="stable")
        t, s = np.array(t)[order], np.array(s)[order]
        keep = t >= t[-1] - max_age
        t, s = t[keep], s[keep]
        state.update((t.tolist(), s.tolist()))
        state.setTimeoutTimestamp(max((int(t[-1]) + max_age) * 1000, state.getCurrentWatermarkMs()) + 1)
        counts = np.bincount(s, np.exp(-decay * (t[-1] - t)), states)
        yield pd.DataFrame({"ctx": [key[0]], "t": [int(t[-1])], "counts": [counts.tolist()]})

    timed = rows.withColumn("_at", F.timestamp_seconds("t")).withWatermark("_at", f"{max_age + 1} seconds")  # what is no later than the watermark is dropped
    return timed.groupBy("ctx").applyInPandasWithState(step, "ctx string, t long, counts array<double>", "t array<long>, s array<int>", "update", GroupStateTimeout.EventTimeTimeout)


#: Keyed state with timers needs this store; set it before such a stream starts.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


#: Seconds added to times before Spark sees them: its watermark begins at 0, and what lies at or before it is late. Nanoseconds from 1970 still hold the sum.
AHEAD = 4 * 10**9


class RollingDecay(StatefulProcessor):
    """A key's decayed sum as of each of its times, kept from batch to batch.

    State is one value, so that a batch reads and writes a key's once: its times that an event can still reach with their
    numbers of events, the sum as of the last time, a version, and when the timer is due. Going forward
    a sum is aged, what came since is added and what got too old is taken off, by a cursor over the
    times. An event behind the last time makes the sums from there on anew, and they are told again under
    a higher version. A timer forgets what no event can reach any more.
    """

    def __init__(self, decay: float, max_age: int, late: int, unit: int):
        self.decay, self.max_age, self.late, self.unit = decay, max_age, late, unit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "times array<long>, counts array<long>, t long, total double, version long, timer long")

    def window(self, known: dict[int, int], now: int) -> float:
        return float(sum(n * np.exp(-self.decay * (now - t)) for t, n in known.items() if now - self.max_age <= t < now))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        come: dict[int, int] = {}
        for b in rows:
            for t, n in b["t"].value_counts().items():
                come[int(t)] = come.get(int(t), 0) + int(n)
        if not come:
            return
        at = self.state.get()
        known = dict(zip(map(int, at[0]), map(int, at[1]))) if at is not None else {}
        top, total, version, timer = (int(at[2]), float(at[3]), int(at[4]) + 1, int(at[5])) if at is not None else (None, 0.0, 0, None)
        start = min(come)
        for t, n in come.items():
            known[t] = known.get(t, 0) + n
        again = top is not None and start < top
        told = sorted(t for t in known if t >= start) if again else sorted(come)
        if again or top is None:
            top, total = told[0], self.window(known, told[0])
        times, out = sorted(known), []
        seen = int(np.searchsorted(times, top))
        gone = int(np.searchsorted(times, top - self.max_age))
        for now in told:
            total *= float(np.exp(-self.decay * (now - top)))
            while seen < len(times) and times[seen] < now:
                total += known[times[seen]] * float(np.exp(-self.decay * (now - times[seen])))
                seen += 1
            while gone < seen and times[gone] < now - self.max_age:
                total -= known[times[gone]] * float(np.exp(-self.decay * (now - times[gone])))
                gone += 1
            top = now
            out.append(max(total, 0.0) if gone < seen else 0.0)
        kept = [t for t in times if t >= times[-1] - self.max_age - self.late]
        due = ((times[-1] + self.max_age + self.late + 1) * self.unit + AHEAD) * 1000
        self.state.update((kept, [known[t] for t in kept], top, out[-1], version, due))
        if due != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(due)
        yield pd.DataFrame({"key": key[0], "t": told, "weight": out, "version": version})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


def rolling_decay(rows: DataFrame, decay: float, max_age: int, late: int, unit: int = 1) -> DataFrame:
    """(key, t, weight, version): the decayed number of a key's events before each of its times, within max_age.

    rows has key (string) and t (long, in steps of unit seconds). A time is told when its first event comes
    and again, under a higher version, whenever a later batch brings an event that changes it: of each
    (key, t) the highest version holds. Events more than late steps behind the stream's last time are
    dropped. Null keys and times are dropped; repeated events count again.
    """
    timed = rows.dropna(subset=["key", "t"]).withColumn("_at", F.timestamp_seconds(F.col("t") * unit + AHEAD)).withWatermark("_at", f"{late * unit} seconds")
    return timed.groupBy("key").transformWithStateInPandas(RollingDecay(decay, max_age, late, unit), "key string, t long, weight double, version long", "Append", "EventTime")

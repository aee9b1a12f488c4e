"""Equi-joins with a side of unique keys, whatever the size of that side and however uneven the other's keys."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A side of at most so many bytes (measured, never estimated) may be broadcast; a key with more rows than HOT_ROWS is dealt apart.
BROADCAST_BYTES, HOT_ROWS, SALTS = 24 << 20, 1_000_000, 64


def measured(df: DataFrame) -> int:
    """Bytes of a stored table's rows, 8 for a number and the length of what varies."""

    def one(name: str, kind: str) -> F.Column:
        if kind in ("binary", "string"):
            return F.coalesce(F.octet_length(name), F.lit(0))
        wide = 8 * (1 + kind.count(","))
        return F.coalesce(F.size(name), F.lit(0)) * wide + 16 if kind.startswith("array") else F.lit(wide)

    sizes = [one(f"`{c}`" if "`" not in c else c, t) for c, t in df.dtypes]
    return df.agg(F.sum(sum(sizes[1:], sizes[0]) + 16)).first()[0] or 0


def unique_join(big: DataFrame, small: DataFrame, on: list[str], how: str, store: Callable[[DataFrame], DataFrame], bound: int | None = None, hot_rows: int | None = None) -> DataFrame:
    """big joined with small, a stored table that has a key at most once; how is inner, left, left_semi or left_anti.

    small is broadcast when its measured size is within the bound. Otherwise both sides shuffle, but for
    the keys that big holds more than hot_rows times, by exact count: they are few (rows / hot_rows at
    most), and their rows of big stay where they are if small's rows for them are within the bound, else
    they are salted by a hash of the row, which a task that runs again deals alike. Null keys of big match nothing and never meet in one task.
    """
    bound, hot_rows = BROADCAST_BYTES if bound is None else bound, HOT_ROWS if hot_rows is None else hot_rows
    if measured(small) <= bound:
        return big.join(F.broadcast(small), on, how)
    void = F.lit(False)
    for c in on:
        void = void | F.col(c).isNull()
    nothing, big = big.where(void), big.where(~void)
    hot = store(big.groupBy(*on).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot_rows).drop("n"))
    rest = [nothing.join(F.broadcast(small.limit(0)), on, how)] if how in ("left", "left_anti") else []
    if not hot.limit(1).count():
        return _together([big.join(small.hint("shuffle_merge"), on, how), *rest])
    few = store(small.join(F.broadcast(hot), on, "left_semi"))
    cold = big.join(F.broadcast(hot), on, "left_anti").join(small.hint("shuffle_merge"), on, how)
    warm = big.join(F.broadcast(hot), on, "left_semi")
    if measured(few) <= max(bound, 0):
        return _together([cold, warm.join(F.broadcast(few), on, how), *rest])
    salted = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = warm.withColumn("_salt", F.pmod(F.xxhash64(*warm.columns), F.lit(SALTS)).cast("int"))
    return _together([cold, dealt.join(salted.hint("shuffle_merge"), [*on, "_salt"], how).drop("_salt"), *rest])


def _together(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out

"""Seeded choices and thinning over bounded parameter sets (ids of a cohort, origins), on the driver."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def seeded_choice(ids: list, n: int, seed: int) -> list:
    """n of the sorted ids without replacement, sorted; all if there are no more."""
    ids = sorted(ids)
    return ids if n >= len(ids) else sorted(ids[i] for i in np.random.default_rng(seed).choice(len(ids), n, replace=False))


def digest_sample(df: DataFrame, key: str, n: int) -> DataFrame:
    """n rows by the digest of their key: the same rows wherever and however the table lies."""
    return df.orderBy(F.md5(F.col(key).cast("string").cast("binary")), key).limit(n)


def stable_seed(seed: int, text: str) -> int:
    """A positive 31-bit seed for a named purpose."""
    return int.from_bytes(hashlib.sha256(f"{seed}:{text}".encode()).digest()[:4], "little") & 0x7FFFFFFF


def thin(items: list, n: int) -> list:
    """At most n items, evenly spaced, the ends kept."""
    return items if n >= len(items) else [items[i] for i in np.unique(np.linspace(0, len(items) - 1, n).round().astype(int))]


def epoch_choice(items: list, n: int, seed: int, epoch: int) -> list:
    """At most n of the items for an epoch, in an order of that epoch: drawn by a seed that names the epoch."""
    rng = np.random.default_rng(stable_seed(seed, f"epoch:{epoch}"))
    chosen = items if n >= len(items) else [items[i] for i in sorted(rng.choice(len(items), n, replace=False))]
    return [chosen[i] for i in rng.permutation(len(chosen))]


def first_seen(df: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """The n keys that come first by order."""
    return df.groupBy(key).agg(F.min(order).alias("_first")).orderBy("_first", key).limit(n).select(key)

"""What the training-data operators share: the shared folder, tables, size-checked joins."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomcast.operators import joins

#: A null doc_id is carried as this key; it sorts before every other one.
NULL_ID = -(2**63)
#: A side of at most so many bytes (measured, never estimated) may be broadcast; a key with more rows is dealt apart.
BROADCAST_BYTES, HOT_ROWS = joins.BROADCAST_BYTES, joins.HOT_ROWS
#: The bytes [\x20\x09-\x0D].
SPACE = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; an own one only where the session names none and all run on one machine."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="loomcast-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


#: Whether a query's shuffle files go as soon as it has ended.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows, written to the shared folder and read back: lineage ends there and no step runs twice.

    Nothing needs the shuffle files behind a written table any more, so they go at once and not with
    some later garbage collection; Spark runs a stage again should another query still refer to them.
    """
    spark = df.sparkSession
    path, was = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", spark.conf.get(CLEAN, "false")
    spark.conf.set(CLEAN, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEAN, was)
    return spark.read.schema(df.schema).parquet(path)


def doc_key() -> list:
    """Key columns of a document's row: its id (null as NULL_ID) and a hash of its text, so that repeated ids with other texts stay apart."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("_id"), F.xxhash64("text").alias("_th")]


def whole(df: DataFrame, *more) -> DataFrame:
    """The row as one column _row, so that no name of the input meets one of ours, and the named columns beside it."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), *more)


def unpacked(columns: list[str]) -> list:
    return [F.col("_row").getField(c).alias(c) for c in columns]


def join_checked(big: DataFrame, small: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """Join a stored table that has a key once: broadcast when its measured size is within the bound, else by shuffles with hot keys apart."""
    return joins.unique_join(big, small, on, how, lambda df: stored(df, "hot"), BROADCAST_BYTES, HOT_ROWS)


def text_bytes(docs: DataFrame) -> int:
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


#: A hash is hot when this share of documents has it, or so many documents where that is fewer; such documents seen in the
#: sample that finds it; hot hashes at most, a bound on what each task holds of them.
HOT_SHARE, HOT_DOCS, SEEN, HOT_MOST = 0.004, 10_000, 32, 1 << 20


def hot_hashes(docs: DataFrame, rows: int, look, seed: int) -> np.ndarray:
    """Sorted hashes that many documents have, by a count over a sample whose rate follows from the bound and not from a fixed size.

    look makes rows (h) of texts, one for each of a document's hashes. It is a plan of where rows travel, and
    decides nothing. Were there more than HOT_MOST, only those above twice, four times.. the bound are taken.
    """
    bound = max(1.0, min(HOT_SHARE * rows, HOT_DOCS))
    rate = min(1.0, SEEN / bound)
    least = max(20, int(bound * rate))
    while True:
        n = docs.select("text").sample(False, rate, seed).mapInPandas(look, "h long").groupBy("h").count()
        got = n.where(F.col("count") >= least).select("h").limit(HOT_MOST + 1).collect()
        if len(got) <= HOT_MOST:
            return np.sort(np.array([r[0] for r in got], np.int64).astype(np.uint64))
        least *= 2


def id_in() -> "F.Column":
    """doc_id with NULL_ID for null: pandas would turn a column with nulls into floating point."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id")


def id_out(df: DataFrame) -> DataFrame:
    return df.withColumn("doc_id", F.when(F.col("doc_id") != NULL_ID, F.col("doc_id")))


def release() -> None:
    """Give memory that a task's arrays left behind back to the system: Python workers live on between tasks."""
    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # a C library without it
        pass

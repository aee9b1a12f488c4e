"""Raw traces: where a table lies, members of tar archives, optional headers, exact export of chosen rows, resumable capture."""

from __future__ import annotations

import os
import shutil
import tarfile
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import write_json


def find_table(folder: str, name: str) -> str:
    """name.csv, name/name.csv or name.tar.gz, the first that is there."""
    tried = [os.path.join(folder, *parts) for parts in ((f"{name}.csv",), (name, f"{name}.csv"), (f"{name}.tar.gz",))]
    for path in tried:
        if os.path.exists(path):
            return path
    raise FileNotFoundError(f"none of {tried}")


def unpacked_member(archive: str, folder: str, suffix: str = ".csv") -> str:
    """The first member with that suffix, streamed to folder under its base name. Compressed archives cannot be read in parts,
    so it is unpacked once; folder must be shared with the executors. A finished file is used again."""
    with tarfile.open(archive, "r:*") as tar:
        for member in tar:
            if member.isfile() and member.name.endswith(suffix):
                to = os.path.join(folder, os.path.basename(member.name))
                if not (os.path.exists(to) and os.path.getsize(to) == member.size):
                    os.makedirs(folder, exist_ok=True)
                    part = f"{to}.{uuid.uuid4().hex}"
                    with tar.extractfile(member) as src, open(part, "wb") as dst:
                        shutil.copyfileobj(src, dst, 1 << 20)
                    os.replace(part, to)
                return to
    raise FileNotFoundError(f"no *{suffix} in {archive}")


def first_line(spark: SparkSession, path: str) -> str:
    """The first line of a file, or of the first file of a folder by name, wherever Spark can read it."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"))
    first = lines.where("b = 0").select("f").agg(F.min("f")).first()[0]
    row = spark.read.text(first).first() if first else None
    return row[0].rstrip("\r") if row else ""


def read_trace(spark: SparkSession, path: str, columns: list[str], marks: tuple[str, ...], delimiter: str = ",") -> DataFrame:
    """A CSV as text columns. Its first line is a header, and names the columns, if all marks are among its cells; else columns name them by place."""
    head = [c.strip() for c in first_line(spark, path).split(delimiter)]
    named = set(marks) <= set(head)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in (head if named else columns)])
    return spark.read.schema(schema).option("sep", delimiter).option("header", named).option("mode", "PERMISSIVE").csv(path)


def key_of(place: int, delimiter: str = ",") -> Column:
    """The cell of a raw line at a place, without parsing the rest."""
    return F.trim(F.split_part("value", F.lit(delimiter), F.lit(place + 1)))


def raw_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, _at): lines as they are, \\r kept, with their place in the input."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select("value", F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("n")).alias("_at"))


def chosen_lines(lines: DataFrame, chosen: DataFrame, place: int = 0, delimiter: str = ",") -> DataFrame:
    """(workload, value, _at) of lines whose key is among chosen.workload: unwanted rows go before any number is parsed.
    Spark broadcasts the ids only below its own threshold."""
    ids = chosen.select(F.col("workload").cast("string").alias("workload")).distinct()
    return lines.select(key_of(place, delimiter).alias("workload"), "value", "_at").join(ids, "workload", "left_semi")


def export_raw(spark: SparkSession, path: str, chosen: DataFrame, out: str, place: int = 0, delimiter: str = ",") -> None:
    """The chosen lines byte for byte and in their order: all under out/all (parts in order of name), and out/by_workload/workload=<id>.

    Ranges of (workload, place) are written, so one workload with most rows is shared by several tasks. Every
    exported line ends with one newline.
    """
    rows = chosen_lines(raw_lines(spark, path), chosen, place, delimiter)
    rows.orderBy("_at").select("value").write.mode("overwrite").option("lineSep", "\n").text(f"{out}/all")
    ranged = rows.repartitionByRange("workload", "_at").sortWithinPartitions("workload", "_at").select("workload", "value")
    ranged.write.mode("overwrite").option("lineSep", "\n").partitionBy("workload").text(f"{out}/by_workload")


def first_cells(spark: SparkSession, path: str, skip: str | None = None) -> DataFrame:
    """(workload): the distinct first cells of a file; skip names the header's first cell."""
    ids = raw_lines(spark, path).select(key_of(0).alias("workload")).where("workload <> ''").distinct()
    return ids.where(F.col("workload") != skip) if skip else ids


def capture(spark: SparkSession, folder: str, chosen: DataFrame, out: str, checkpoint: str, place: int = 0, delimiter: str = ",") -> None:
    """Takes in the files of folder that no earlier run finished, once each: the stream's log holds the place, the sink's log the output.

    A run that was stopped goes on where it stood; read the result with spark.read.parquet(out).
    """
    ids = chosen.select(F.col("workload").cast("string").alias("workload")).distinct()
    lines = spark.readStream.option("lineSep", "\n").text(folder)
    rows = lines.select(key_of(place, delimiter).alias("workload"), "value").join(ids, "workload", "left_semi")
    query = rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def write_npz(path: str, **arrays) -> None:
    """Typed arrays in one file, written whole or not at all. Arrays of objects are refused."""
    found = {k: np.asarray(v) for k, v in arrays.items()}
    bad = [k for k, v in found.items() if v.dtype == object]
    if bad:
        raise TypeError(f"arrays of objects: {bad}")
    part = f"{path}.{uuid.uuid4().hex}"
    with open(part, "wb") as f:
        np.savez_compressed(f, **found)
        f.flush()
        os.fsync(f.fileno())
    os.replace(part, path)


#: Fields of a dense bundle that must be there, with the axes they lie on: workloads, times, resources.
BUNDLE = {"workload_ids": "w", "time_seconds": "t", "resource_names": "r", "observed_values": "wtr", "target_observed_mask": "wt"}


def read_dense(spark: SparkSession, path: str) -> DataFrame:
    """(workload, t, resources..., target_observed) of a dense bundle: for bundles that fit the driver. Fields, shapes and an even step are checked."""
    z = np.load(path, allow_pickle=False)
    missing = [k for k in BUNDLE if k not in z.files]
    if missing:
        raise ValueError(f"missing fields: {missing}")
    size = {"w": len(z["workload_ids"]), "t": len(z["time_seconds"]), "r": len(z["resource_names"])}
    wrong = [k for k, axes in BUNDLE.items() if z[k].shape != tuple(size[a] for a in axes)]
    if wrong:
        raise ValueError(f"wrong shapes: {wrong}")
    if size["t"] > 2 and len(np.unique(np.diff(z["time_seconds"]))) > 1:
        raise ValueError("times are not evenly spaced")
    values = z["observed_values"].reshape(-1, size["r"])
    frame = pd.DataFrame({"workload": np.repeat(z["workload_ids"].astype(str), size["t"]), "t": np.tile(z["time_seconds"].astype("int64"), size["w"])})
    for i, name in enumerate(z["resource_names"].astype(str)):
        frame[name] = values[:, i]
    frame["target_observed"] = z["target_observed_mask"].reshape(-1)
    names = ", ".join(f"`{n}` double" for n in z["resource_names"].astype(str))
    rows = spark.createDataFrame(frame, f"workload string, t long, {names}, target_observed boolean")
    return rows.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in rows.dtypes])


def ten_digits(x: Column) -> Column:
    """A double in at most ten significant digits as %.10g writes it; null and NaN are null, either zero is 0.

    C rounds the number that the bits hold; the JVM rounds its shortest decimal, half up, and differs where that ends in a 5.
    """

    @F.pandas_udf(T.StringType())
    def percent_g(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if v != v else "%.10g" % (v + 0.0)).astype(object)

    return percent_g(x.cast("double"))


def write_numbers(df: DataFrame, path: str, order: list[str]) -> None:
    """CSV sorted by order, with doubles in at most ten significant digits."""
    df.orderBy(*order).select(*[ten_digits(F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]).write.mode("overwrite").option("header", True).csv(path)


def union_all(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows of tables that need not have the same columns, each with the name of its run."""
    out = None
    for name, df in tables.items():
        df = df.withColumn("run", F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def completeness(found: DataFrame, expected: list[str]) -> DataFrame:
    """(run, n_rows, complete) for each expected run, those without rows too."""
    want = found.sparkSession.createDataFrame([(x,) for x in expected], "run string")
    n = found.groupBy("run").agg(F.count(F.lit(1)).alias("n_rows"))
    return want.join(n, "run", "left").select("run", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.col("n_rows").isNotNull().alias("complete"))


def write_predictions(df: DataFrame, path: str) -> None:
    """A forecast of bounded size (one origin's) as strict JSON."""
    write_json([r.asDict(recursive=True) for r in df.toLocalIterator()], path)

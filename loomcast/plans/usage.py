"""The driver's tables in the engine's roles: usage rows, states, deployment, links, memberships."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import ingest
from ..sources.usage import ResourceRule, SourceSpec, observations

DAY = 86_400
CHANNELS = ["cpu", "mem", "disk_i", "disk_o"]
RULES = (ResourceRule("cpu", "value", 0.01, 0, 400), ResourceRule("mem", "k", 0.01, 0, 100), ResourceRule("disk_i", "value", 0.005, 0, 400), ResourceRule("disk_o", "value", 0.005, 0, 400))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it; on one machine a temporary one will do."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="loomcast-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def read(spark: SparkSession, d: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet")


def seconds(ts: str) -> F.Column:
    """Epoch seconds of a timestamp without zone, whatever the session's zone."""
    return F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date")).cast("long") * DAY + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def usage(spark: SparkSession, d: str) -> DataFrame:
    """Valid usage rows (workload, t, node, channels) in daily buckets."""
    rows = read(spark, d, "events").select("event_id", "user_id", "event_type", "value", seconds("ts").alias("sec"), F.regexp_extract("props", r'"k": *([0-9]+)', 1).alias("k"))
    spec = SourceSpec("", "user_id", "sec", RULES, node="event_type", extra=("event_id",))
    return observations(rows, spec, step=DAY)


def means(spark: SparkSession, d: str) -> DataFrame:
    return ingest.bucket_means(usage(spark, d), CHANNELS)


def filled(spark: SparkSession, d: str) -> DataFrame:
    m = means(spark, d)
    lo, hi = m.agg(F.min("t"), F.max("t")).first()
    return ingest.causal_fill(ingest.dense_grid(m, lo or 0, (hi or 0) + 1), CHANNELS)


def states(spark: SparkSession, d: str) -> DataFrame:
    """(workload, t day, sec, event_id, state): the event types of each user in order."""
    return read(spark, d, "events").select(F.col("user_id").alias("workload"), seconds("ts").alias("sec"), "event_id", F.col("event_type").alias("state")).withColumn("t", F.floor(F.col("sec") / DAY).cast("long"))


def incidences(spark: SparkSession, d: str) -> DataFrame:
    """Parts by order: the workload is a part, the node an order; a row a line, so rows may repeat."""
    return read(spark, d, "lineitem").select(F.col("l_partkey").alias("workload"), F.col("l_orderkey").alias("node"))


def deployment(spark: SparkSession, d: str) -> DataFrame:
    """Parts by order, each once."""
    return incidences(spark, d).distinct()


def links(spark: SparkSession, d: str) -> DataFrame:
    """Directed links between nations with four features, by month of shipping."""
    li = read(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity", "l_discount", "l_tax", "l_extendedprice", "l_shipdate")
    sup = read(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("src"))
    cus = read(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("dst"))
    orders = read(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey").join(cus, "o_custkey")
    rows = li.join(sup, "l_suppkey").join(orders, "l_orderkey").where("src <> dst")
    month = ((F.year("l_shipdate") - 1970) * 12 + F.month("l_shipdate") - 1).cast("long")
    return rows.groupBy(month.alias("time_bucket"), "src", "dst").agg(F.avg("l_extendedprice").alias("bandwidth"), F.avg("l_quantity").alias("delay"), F.avg("l_discount").alias("loss"), F.avg("l_tax").alias("availability"))


def memberships(spark: SparkSession, d: str) -> DataFrame:
    """(workload, state, truth, mu): embeddings against their labels' mean vectors, softmax of the negative squared distance."""
    e = read(spark, d, "embeddings").select(F.col("vec_id").alias("workload"), "label", "embedding")
    parts = e.select("workload", "label", F.posexplode("embedding"))
    c = parts.groupBy(F.col("label").alias("state"), "pos").agg(F.avg(F.col("col").cast("double")).alias("c"))
    d2 = parts.join(c, "pos").groupBy("workload", F.col("label").alias("truth"), "state").agg(F.sum(F.pow(F.col("col").cast("double") - F.col("c"), 2)).alias("d2"))
    w = F.exp(-F.col("d2") * 4)
    return d2.select("workload", "state", "truth", (w / F.sum(w).over(Window.partitionBy("workload"))).alias("mu"))

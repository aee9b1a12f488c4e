"""Mixing sources to target weights.

Tokens are counted per source, targets follow from the weights by water-filling, and each document is
taken floor(rate) times plus once more with probability rate - floor(rate), decided by a hash of its id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import join_checked, stored, unpacked, whole

WORD = r"[^\x20\x09-\x0D]+"


def with_size(docs: DataFrame) -> DataFrame:
    return docs.withColumn("size", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeats: int = 3) -> DataFrame:
    """Rows (source, source_size, target) of a table with source and size.

    Sources by code point, null last, weigh `weights` in turn and share all words. A target stops at
    max_repeats times its source's size; the excess is shared again by weight until none is above.
    Ranks are counted within ranges of sources and from range to range: no task ranks all sources. An
    empty table has no sources.
    """
    by = F.col("source").asc_nulls_last()
    table = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).repartitionByRange(by)
    table = stored(table.withColumn("range", F.spark_partition_id()), "ranges")
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    skip = table.groupBy("range").agg(F.count(F.lit(1)).alias("n")).select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("skip"))
    rank = F.row_number().over(Window.partitionBy("range").orderBy(by)) - 1 + F.col("skip")
    w = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int")).cast("long")
    table = stored(table.join(F.broadcast(skip), "range").select("source", "source_size", w.alias("weight"), (F.col("source_size") * max_repeats).alias("cap")), "sources")
    big = "decimal(38,0)"
    rest, share, capped = 0, 1, -1
    total = table.agg(F.sum("source_size")).first()[0] or 0
    rest, above = total, F.lit(False)
    while True:
        n, spent, share = table.agg(F.count_if(above), F.sum(F.when(above, F.col("cap")).otherwise(0)), F.sum(F.when(above, 0).otherwise(F.col("weight")))).first()
        rest, share = total - (spent or 0), share or 1
        if n == capped:
            break
        capped, above = n, above | (F.col("weight").cast(big) * F.lit(rest).cast(big) > F.col("cap").cast(big) * F.lit(share).cast(big))
    target = F.when(above, F.col("cap").cast("double")).otherwise((F.col("weight") * F.lit(rest)).cast("double") / F.lit(float(share)))
    return table.select("source", "source_size", target.alias("target"))


def draw(seed: str) -> F.Column:
    """A number in [0, 1) from the document's id alone: a rerun draws the same."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(16**13)


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeats: int = 3, seed: str = "mix") -> DataFrame:
    """The documents with size, source_size, target and copies, whole and one row each.

    Null text: size 0 and no words taken. Null source: a source of its own, ranked last. A null doc_id
    draws like any id; repeated rows are documents of their own that draw alike. An empty table: no rows.
    Columns of the input named size, source_size, target or copies are replaced.
    """
    docs = docs.drop("size", "source_size", "target", "copies")
    sized = with_size(whole(docs, "doc_id", "source", "text"))
    targets = source_targets(stored(sized.groupBy("source").agg(F.sum("size").alias("size")), "sizes"), weights, max_repeats)
    key = [F.col("source").isNull().alias("_none"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("_source")]
    joined = join_checked(sized.select("*", *key), stored(targets.select(*key, "source_size", "target"), "targets"), ["_none", "_source"], "left")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    copies = (F.floor(rate) + (draw(seed) < rate - F.floor(rate)).cast("long")).cast("int")
    return joined.select(*unpacked(docs.columns), "size", "source_size", "target", copies.alias("copies"))


def emitted(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: every document's row as often as the mix takes it, in the input's columns."""
    out = mix(whole(docs, "doc_id", "source", "text"), **options)
    times = F.when(F.col("copies") > 0, F.sequence(F.lit(1), F.col("copies")))
    return out.select("_row", F.explode(times).alias("copy")).select(*unpacked(docs.columns))


def op10(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, 3 * source_size AS cap, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight FROM s),
o AS (SELECT *, cap::DOUBLE / weight AS ratio, sum(cap) OVER a - cap AS before, sum(weight) OVER () - sum(weight) OVER a + weight AS share, sum(source_size) OVER () AS total
      FROM w WINDOW a AS (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
f AS (SELECT total - before AS rest, share FROM o WHERE cap::HUGEINT * share >= weight::HUGEINT * (total - before) ORDER BY ratio, source NULLS LAST LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN weight::HUGEINT * rest > cap::HUGEINT * share THEN cap::DOUBLE ELSE (weight * rest)::BIGINT::DOUBLE / share::DOUBLE END AS target FROM w, f),
r AS (SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (size * (floor(rate) + CASE WHEN ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM r"""

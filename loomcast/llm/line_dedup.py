"""Line dedup, with DataFrame functions only.

Hashes of long lines are range-partitioned and sorted within a range by hash, document (the greatest
first) and position. One pass over that order streams each hash's first occurrence, its greatest
document, and counts its documents where the document changes. A hash with very many lines is cut by
document over several ranges, planned by a sample whose rate follows the input; the cuts' firsts and
counts are then merged. What returns for a document is a run-length keep bitmap, not its text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import SPACE, doc_key, join_checked, stored, unpacked, whole

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A hash is cut when it has more lines than this, or than this share of all lines where that is more; lines of it in the sample.
CUT_ROWS, CUT_SHARE, SEEN = 5_000, 1e-4, 64


def _lines(text: str) -> F.Column:
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)


def _key(line: F.Column) -> F.Column:
    """Stripped at both ends and A-Z lowered; lower() does that for lines of ASCII alone."""
    stripped = F.btrim(line, F.lit(SPACE))
    return F.when(F.octet_length(stripped) == F.char_length(stripped), F.lower(stripped)).otherwise(F.translate(stripped, UPPER, UPPER.lower()))


def cuts(rows: DataFrame) -> DataFrame:
    """(h1, h2, cuts): hashes to cut and into how many parts; a plan of where rows travel, which decides nothing.

    There are 1 / CUT_SHARE such hashes at most, whatever the input's size.
    """
    least = max(CUT_ROWS, int(rows.count() * CUT_SHARE))
    rate = min(1.0, SEEN / least)
    seen = rows.sample(False, rate, 31) if rate < 1 else rows
    n = seen.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= SEEN / 2)
    return stored(n.select("h1", "h2", F.ceil(F.col("n") / F.lit(rate * least) + 1).cast("int").alias("cuts")), "cuts")


def streamed(rows: DataFrame) -> DataFrame:
    """The rows in ranges of (hash, cut), sorted within, with first (the cut's greatest document) and docs (how many documents it has)."""
    rows = join_checked(rows, cuts(rows), ["h1", "h2"], "left").withColumn("cut", F.coalesce(F.pmod(F.xxhash64("_id"), "cuts"), F.lit(0)).cast("int")).withColumn("is_cut", F.col("cuts").isNotNull()).drop("cuts")
    group = Window.partitionBy("h1", "h2", "cut")
    order = group.orderBy(F.desc("_id"), "pos")
    ranged = rows.repartitionByRange("h1", "h2", "cut")
    new = F.coalesce(F.lag("_id").over(order) != F.col("_id"), F.lit(True))
    return ranged.withColumn("first", F.first("_id").over(order)).withColumn("new", new.cast("int")).withColumn("docs", F.sum("new").over(group)).drop("new")


def keep_bitmaps(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """Rows (_id, _th, dropped_at, dropped_len): runs of dropped lines, for each document that loses any.

    A line's key must have min_chars code points and be found in min_docs distinct doc_ids; its lines
    stay only in the largest doc_id that holds it.
    """
    key = _key(F.col("line"))
    rows = docs.select(*doc_key(), F.posexplode(_lines("text")).alias("pos", "line")).where(F.char_length("line") >= min_chars).withColumn("line", key).where(F.char_length("line") >= min_chars)
    rows = stored(rows.select("_id", "_th", "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("second"), "line").alias("h2")), "lines")
    later = (F.col("docs") >= min_docs) & (F.col("_id") != F.col("first"))
    seen = stored(streamed(rows).where(F.col("is_cut") | later), "streamed")
    # parts of a cut hash hold different documents: their counts add up, the greatest first stays
    parts = seen.where("is_cut").groupBy("h1", "h2", "cut").agg(F.max("first").alias("first"), F.max("docs").alias("docs"))
    whole_hash = stored(parts.groupBy("h1", "h2").agg(F.max("first").alias("first"), F.sum("docs").alias("docs")), "merged")
    cut_hits = join_checked(seen.where("is_cut").drop("first", "docs"), whole_hash, ["h1", "h2"], "inner").where(later)
    hits = seen.where("not is_cut").select("_id", "_th", "pos").unionAll(cut_hits.select("_id", "_th", "pos"))
    at = F.array_sort(F.collect_set("pos"))
    runs = hits.groupBy("_id", "_th").agg(at.alias("at"))
    starts = F.filter("at", lambda p, i: (i == 0) | (F.get("at", i - 1) != p - 1))
    ends = F.filter("at", lambda p, i: (i == F.size("at") - 1) | (F.get("at", i + 1) != p + 1))
    runs = runs.withColumn("dropped_at", starts).withColumn("_end", ends)
    return runs.select("_id", "_th", "dropped_at", F.zip_with("dropped_at", "_end", lambda a, b: b - a + 1).alias("dropped_len"))


def line_dedup(docs: DataFrame, **options) -> DataFrame:
    """The documents with text reduced to the kept lines, and n_lines, n_dropped, dropped_at, dropped_len.

    Null or empty text: one empty line, and the text becomes empty. A null doc_id counts as one document,
    below all others. Rows that repeat a doc_id are one document holding a key; each row loses or keeps
    its own lines. An empty table: no rows. Input columns with the result's names are replaced.
    """
    docs = docs.drop("n_lines", "n_dropped", "dropped_at", "dropped_len")
    return _dropped(docs, **options).select(*unpacked([c for c in docs.columns if c != "text"]), "n_lines", "n_dropped", "text", "dropped_at", "dropped_len")


def reduced(docs: DataFrame, **options) -> DataFrame:
    """The documents in their own columns, whatever these are called, with text reduced to the kept lines."""
    return _dropped(docs, **options).select(*[F.col("text") if c == "text" else F.col("_row").getField(c).alias(c) for c in docs.columns])


def _dropped(docs: DataFrame, **options) -> DataFrame:
    bitmaps = stored(keep_bitmaps(docs, **options), "bitmaps")
    keyed = whole(docs, "text", *doc_key())
    out = join_checked(keyed, bitmaps, ["_id", "_th"], "left").drop("_id", "_th")
    out = out.withColumn("_lines", _lines("text"))
    last = F.size("dropped_at") - 1
    cut = F.transform("dropped_at", lambda p, i: F.slice(F.col("_lines"), F.when(i == 0, 1).otherwise(F.get("dropped_at", i - 1) + F.get("dropped_len", i - 1) + 1), p - F.when(i == 0, 0).otherwise(F.get("dropped_at", i - 1) + F.get("dropped_len", i - 1))))
    done = F.get("dropped_at", last) + F.get("dropped_len", last)
    tail = F.slice(F.col("_lines"), done + 1, F.size("_lines") - done)
    kept = F.when(F.col("dropped_at").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(F.concat(F.flatten(cut), tail), "\n"))
    dropped = F.coalesce(F.aggregate("dropped_len", F.lit(0), lambda a, x: a + x), F.lit(0))
    return out.select("_row", F.size("_lines").cast("long").alias("n_lines"), dropped.cast("long").alias("n_dropped"), kept.alias("text"), "dropped_at", "dropped_len")


def op8(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return line_dedup(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
WITH l AS (SELECT doc_id, i, line, translate(trim(line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)),
c AS (SELECT k, max(doc_id) AS last FROM l WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (c.k IS NOT NULL AND doc_id <> last)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (c.k IS NULL OR doc_id = last), '')) AS kept_sha256
FROM l LEFT JOIN c ON l.k = c.k GROUP BY doc_id"""

"""URL filters over dated lists: a temporal list join.

A list is a log of dated events (key, day, action), action 'block', 'allow' or 'remove'. Events become
validity intervals, and an as-of join gives every capture the entries that were active when it was
fetched: its host and each parent domain are looked up, and the longest active key decides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import join_checked, stored, unpacked, whole

HOST = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?(\[[^\]/?#@]*\]|[^/?#:@\[]*)"
#: An IP address has no parent domains.
ADDRESS = r"^(\[.*|[0-9.]+)$"


def host_of(url) -> F.Column:
    """Lower-case host without user, port or a final dot; null where the URL has none."""
    host = F.rtrim(F.lower(F.regexp_extract(url, HOST, 1)), F.lit("."))
    return F.when(host != "", host)


def suffixes(host: F.Column) -> F.Column:
    """The host and its parent domains, the longest first."""
    parts = F.split(host, r"\.")
    last = F.when(host.rlike(ADDRESS), 1).otherwise(F.size(parts))
    return F.transform(F.sequence(F.lit(1), last), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def intervals(events: DataFrame) -> DataFrame:
    """(key, action, since, until): an entry holds from its day until the key's next event, open at the end.

    Of several events of a key on one day the last by action name counts. Events with a null part are void.
    """
    events = events.select(F.lower("key").alias("key"), "day", "action").dropna().groupBy("key", "day").agg(F.max("action").alias("action"))
    until = F.lead("day").over(Window.partitionBy("key").orderBy("day"))
    return events.withColumn("until", until).where(F.col("action") != "remove").select("key", "action", F.col("day").alias("since"), "until")


def url_filter(captures: DataFrame, events: DataFrame, url: str = "url", day: str = "fetch_day") -> DataFrame:
    """The captures with host, blocked, entry_key (null: none) and entry_since (-1: none).

    Each distinct (host, day) is decided once, so a host with a third of all captures costs one row a day
    before anything is joined. Null or unparsable URLs have a null host and are not blocked, nor are
    captures without a day. A key under which a third of all hosts lie, listed or not, is joined
    without meeting in one task. Repeated captures are each answered. Columns of the result's names are replaced.
    """
    captures = captures.drop("host", "blocked", "entry_key", "entry_since")
    rows = whole(captures, host_of(F.col(url)).alias("host"), F.col(day).alias("day"))
    asked = rows.select("host", F.col("day").alias("_day")).dropna().distinct()
    keys = asked.select("host", "_day", F.explode(suffixes(F.col("host"))).alias("key"))
    # a key's entries as one row, so that keys, however many hosts share them, meet a side of unique keys
    lists = stored(intervals(events).groupBy("key").agg(F.collect_list(F.struct("since", "until", "action")).alias("entries")), "lists")
    entry = F.filter("entries", lambda x: (F.col("_day") >= x["since"]) & (x["until"].isNull() | (F.col("_day") < x["until"])))
    active = join_checked(keys, lists, ["key"], "inner").withColumn("entry", F.get(entry, F.lit(0))).where("entry is not null")
    longest = F.max_by(F.struct("key", "entry.action", "entry.since"), F.char_length("key")).alias("e")
    decided = active.groupBy("host", F.col("_day").alias("day")).agg(longest)
    decided = stored(decided.select("host", "day", F.col("e.key").alias("key"), F.col("e.action").alias("action"), F.col("e.since").alias("since")), "decided")
    out = join_checked(rows, decided, ["host", "day"], "left")
    blocked = F.coalesce(F.col("action") == "block", F.lit(False))
    return out.select(*unpacked(captures.columns), "host", blocked.alias("blocked"), F.col("key").alias("entry_key"), F.coalesce("since", F.lit(-1)).alias("entry_since"))


def sample_list(captures: DataFrame) -> DataFrame:
    """A dated list for tables that come without one: from each host and its parent domain, by a digest of the name."""
    names = captures.select(F.explode(suffixes(host_of(F.col("url")))).alias("key")).where(F.instr("key", ".") > 0).distinct()
    number = lambda at: F.conv(F.substring(F.md5(F.col("key").cast("binary")), at, 7), 16, 10).cast("long")
    names = names.withColumns({"a": number(1), "b": number(8), "c": number(15)}).where(F.col("a") % 3 == 0)
    first = names.select("key", (F.col("b") % 300).alias("day"), F.when(F.col("c") % 4 == 0, "allow").otherwise("block").alias("action"))
    last = names.where(F.col("c") % 2 == 0).select("key", (F.col("b") % 300 + 1 + F.col("c") % 60).alias("day"), F.lit("remove").alias("action"))
    return first.unionAll(last)


def op5(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", (F.col("page_id") * 7 % 365).alias("fetch_day"))
    return url_filter(pages, sample_list(pages)).select("page_id", "host", "fetch_day", "blocked", "entry_key", "entry_since")


SQL = r"""
WITH p AS (SELECT page_id, page_id * 7 % 365 AS fetch_day, nullif(rtrim(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?(\[[^\]/?#@]*\]|[^/?#:@\[]*)', 1)), '.'), '') AS host FROM pages),
h AS (SELECT DISTINCT host, string_split(host, '.') AS parts FROM p WHERE host IS NOT NULL),
k AS (SELECT host, array_to_string(parts[i:], '.') AS key FROM (SELECT host, parts, unnest(generate_series(1, CASE WHEN regexp_matches(host, '^(\[.*|[0-9.]+)$') THEN 1 ELSE len(parts) END)) AS i FROM h)),
n AS (SELECT key, ('0x' || substr(md5(key), 1, 7))::BIGINT AS a, ('0x' || substr(md5(key), 8, 7))::BIGINT AS b, ('0x' || substr(md5(key), 15, 7))::BIGINT AS c FROM (SELECT DISTINCT key FROM k WHERE contains(key, '.'))),
v AS (SELECT key, b % 300 AS since, CASE WHEN c % 2 = 0 THEN b % 300 + 1 + c % 60 END AS until, CASE WHEN c % 4 = 0 THEN 'allow' ELSE 'block' END AS action FROM n WHERE a % 3 = 0),
m AS (SELECT page_id, p.host, fetch_day, v.key, since, action, row_number() OVER (PARTITION BY page_id ORDER BY length(v.key) DESC NULLS LAST) AS r
      FROM p LEFT JOIN (k JOIN v ON k.key = v.key) ON p.host = k.host AND fetch_day >= since AND (until IS NULL OR fetch_day < until))
SELECT page_id, host, fetch_day, coalesce(action = 'block', false) AS blocked, key AS entry_key, coalesce(since, -1) AS entry_since FROM m WHERE r = 1"""

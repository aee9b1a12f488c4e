"""Spelling variant grouping: words one edit apart, from a positional q-gram index with a count filter.

Two words one edit apart share the first or the last half of the shorter one: that half, a positional gram,
is the key under which words travel. Under a key the rest of each word is cut into q-grams with their
positions; a word's posting lists, limited to the positions that its length and the postings' leave and to
words of the key's length, are merged through a heap; who occurs in them as often as one edit leaves grams in common is
verified. Only counts and each word's best neighbour leave a task, never pairs.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import join_checked, stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LETTERS = "A-Za-zÀ-ÿ"
SHORTEST, LEAST, SLIP = 5, 3, 97
#: A key with more words than GROUP is cut into blocks of words, each two of which meet in a task; rows of a bucket.
GROUP, BUCKET = 4096, 16_384
#: Code points of a gram at most: a very long word has many grams, not long ones.
LONGEST = 8


def words(docs: DataFrame, shortest: int = SHORTEST, least: int = LEAST, slip: int = SLIP) -> DataFrame:
    """(word, n): maximal runs of letters of whole texts, A-Z lower-cased, some with a letter less, counted.

    A run loses the code point h % length where slip divides h, the crc32 of '<doc_id>:<run>' (a null doc_id
    is an empty string). Null and empty texts have none. Runs below the shortest length cannot become words.
    """
    run = F.explode(F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(f"[{LETTERS}]{{{shortest},}}"), F.lit(0)))
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("i"), run.alias("run"))
    h = F.crc32(F.concat("i", F.lit(":"), "run").cast("binary"))
    at = (F.col("h") % F.length("run")).cast("int")
    less = F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, F.length("run")))
    found = runs.withColumn("h", h).select(F.when(F.col("h") % slip == 0, less).otherwise(F.col("run")).alias("word")).where(F.length("word") >= shortest)
    return found.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def keyed(table: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """(m, side, half, word, n): each word under the halves that it can share with a word one edit apart, m the shorter length."""

    def halves(m, side):
        h = F.floor(m / 2).cast("int")
        half = F.col("word").substr(F.lit(1), h) if side == 0 else F.col("word").substr(F.length("word") - h + 1, h)
        return F.struct(m.cast("int").alias("m"), F.lit(side).alias("side"), half.alias("half"))

    long = F.length("word")
    every = F.array(*(halves(long - d, s) for d in (0, 1) for s in (0, 1)))
    return table.select("word", "n", F.explode(F.filter(every, lambda k: k["m"] >= shortest)).alias("k")).select("k.*", "word", "n")


def one_edit(x: str, y: str) -> bool:
    """Whether exactly one inserted, deleted or replaced code point makes one the other."""
    if len(x) > len(y):
        x, y = y, x
    if len(y) - len(x) > 1 or x == y:
        return False
    i = 0
    while i < len(x) and x[i] == y[i]:
        i += 1
    return x[i + (len(x) == len(y)) :] == y[i + 1 :]


def near(m: int, side: int, first: list[str], second: list[str] | None) -> Iterator[tuple[str, str]]:
    """Pairs of words one edit apart under a key, each once: within first, or between first and second.

    The key's half is cut off. With r the longer rest, one edit leaves at least r - 2q + 1 grams of length q
    in common: in a word of the same length at their places, in one a letter shorter at their places or one before.
    So only words of length m have postings. A pair that shares both halves belongs to the first.
    """
    h = m // 2
    q = min(LONGEST, max(1, (m - h - 1) // 2))
    rest = (lambda w: w[h:]) if side == 0 else (lambda w: w[: len(w) - h])

    def put(w: str, rows: list[str], index: dict[tuple[str, int], list[int]]) -> None:
        r = rest(w)
        for p in range(len(r) - q + 1):
            index[r[p : p + q], p].append(len(rows))
        rows.append(w)

    def found(w: str, rows: list[str], index: dict[tuple[str, int], list[int]]) -> Iterator[str]:
        r = rest(w)
        least = len(r) - 2 * q + 1
        lists = [at for p in range(len(r) - q + 1) for d in range(m - len(w), 1) if (at := index.get((r[p : p + q], p + d)))]
        merged = list(heapq.merge(*lists))
        for at in dict.fromkeys(i for i, j in zip(merged, merged[least - 1 :]) if i == j):
            x = rows[at]
            if not (side and x[:h] == w[:h]) and one_edit(x, w):
                yield x

    short, long = ([w for w in first if len(w) == m], [w for w in first if len(w) > m])
    rows, index = [], defaultdict(list)
    for w in short:
        if second is None:
            yield from ((x, w) for x in found(w, rows, index))
        put(w, rows, index)
    for w in long if second is None else second:
        yield from ((x, w) for x in found(w, rows, index))
    if second is not None and long:
        rows, index = [], defaultdict(list)
        for w in second:
            if len(w) == m:
                put(w, rows, index)
        for w in long:
            yield from ((w, x) for x in found(w, rows, index))


def linked(table: DataFrame, shortest: int = SHORTEST, group: int = GROUP, bucket: int = BUCKET) -> DataFrame:
    """(word, n_near, best): how many words are one edit apart, and the commonest of them, {-n, word}, for words that have any.

    table (word, n) is stored. A key of more than group words is cut into blocks by a hash of the word; each
    two blocks meet under a key of their own, so that a task's work is bounded however many words share a half.
    """
    rows = keyed(table, shortest)
    sizes = rows.groupBy("m", "side", "half").agg(F.count(F.lit(1)).alias("c"))
    hot = stored(sizes.where(F.col("c") > group).select("m", "side", "half", F.ceil(F.col("c") / group).cast("int").alias("blocks")), "hot")
    total = rows.count()
    dealt = join_checked(rows, hot, ["m", "side", "half"]).withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("b", F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("m", "side", "half", "word", "n", "b", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"))
    dealt = dealt.withColumn("bucket", F.pmod(F.xxhash64("m", "side", "half", "i", "j"), F.lit(max(1, total // bucket))))

    def of(rows: pd.DataFrame) -> pd.DataFrame:
        best: dict[str, list] = {}
        n = dict(zip(rows["word"], rows["n"]))
        for (m, side, _, i, j), g in rows.groupby(["m", "side", "half", "i", "j"], sort=False):
            if len(g) < 2:
                continue
            a, b = (g["word"].tolist(), None) if i == j else (g["word"][g["b"] == i].tolist(), g["word"][g["b"] == j].tolist())
            for x, y in near(int(m), int(side), a, b):
                for w, v in ((x, y), (y, x)):
                    k = best.setdefault(w, [0, 0, ""])
                    k[0] += 1
                    if (-n[v], v) < (k[1], k[2]) or k[0] == 1:
                        k[1:] = -n[v], v
        return pd.DataFrame([(w, *k) for w, k in best.items()], columns=["word", "n_near", "less", "of"])

    found = dealt.groupBy("bucket").applyInPandas(of, "word string, n_near long, less long, of string")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct("less", "of")).alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of a stored table (word, form): the last word that forms lead to. Paths are halved in each round; counts at least double along them, so 6 rounds do."""
    at = forms.select("word", F.col("form").alias("root"))
    while True:
        up = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        new = stored(join_checked(at, up, ["root"]), "roots")
        if not new.where("further is not null").limit(1).count():
            return at
        at = new.select("word", F.coalesce("further", "root").alias("root"))


def spelling_variants(docs: DataFrame, shortest: int = SHORTEST, least: int = LEAST, slip: int = SLIP) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word of at least shortest code points that occurs at least `least` times.

    form is the commonest word one edit apart (of equals the least by code points) if it occurs at least twice
    as often, root the last of the forms from there on. Texts are read whole; null and empty ones and an empty
    table have no words; repeated rows count again; columns other than doc_id and text are not looked at.
    """
    table = stored(words(docs, shortest, least, slip), "words")
    links = stored(linked(table, shortest), "linked")
    near_n = -F.col("best.less")
    all_ = table.join(links, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(near_n >= 2 * F.col("n"), F.col("best.of")).alias("form"), F.when(near_n >= 2 * F.col("n"), near_n).alias("form_n"))
    all_ = stored(all_, "forms")
    ends = stored(roots(stored(all_.where("form is not null").select("word", "form"), "links")), "ends")
    return all_.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))


def op13(spark, sf_dir: str) -> DataFrame:
    return spelling_variants(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


_BIT = "CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
SQL = f"""WITH RECURSIVE
r AS (SELECT i, run, count(*) AS n FROM (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS i, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[{LETTERS}]{{{SHORTEST},}}')) AS run FROM documents) GROUP BY ALL),
y AS (SELECT *, hex(i || ':' || run) AS x FROM r),
h AS (SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(0, len(x), 2), lambda k: [(('0x' || x[k + 1 : k + 2])::BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda c, b: CASE WHEN b >= 0 THEN xor(c, b) ELSE {_BIT} END), 4294967295::BIGINT) AS h FROM y),
w AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (SELECT CASE WHEN h % {SLIP} = 0 THEN run[1 : h % length(run)] || run[h % length(run) + 2 :] ELSE run END AS word, n FROM h) WHERE length(word) >= {SHORTEST} GROUP BY word HAVING sum(n) >= {LEAST}),
v AS MATERIALIZED (SELECT word, n, k, word[1 : k - 1] || word[k + 1 :] AS less FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS k FROM w)),
p AS (SELECT a.word, b.word AS other, b.n FROM v a JOIN v b ON a.k = b.k AND a.less = b.less AND a.word <> b.word
  UNION SELECT a.word, w.word, w.n FROM v a JOIN w ON a.less = w.word UNION SELECT w.word, a.word, a.n FROM v a JOIN w ON a.less = w.word),
g AS (SELECT word, count(*) AS n_near, max(n) AS most, arg_min(other, struct_pack(m := -n, other)) AS best FROM p GROUP BY word),
f AS MATERIALIZED (SELECT word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 2 * w.n THEN best END AS form, CASE WHEN most >= 2 * w.n THEN most END AS form_n FROM w LEFT JOIN g USING (word)),
t AS (SELECT word, word AS root, 0 AS step FROM f UNION ALL SELECT t.word, f.form, step + 1 FROM t JOIN f ON t.root = f.word WHERE f.form IS NOT NULL)
SELECT f.*, e.root FROM f JOIN (SELECT word, arg_max(root, step) AS root FROM t GROUP BY word) e USING (word)"""

"""Each operator against brute force on small tables with nulls, empty and long texts, ties, repeats and clashing names."""

import functools
import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomcast.llm import _common, decontaminate, jaccard_join, katz_lm, kmer_dedup, line_dedup, mix_sources, quality_gam, suffix_dedup, topk_search, url_filter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _id string, size string, copies int, score string, _row string, host string"


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def corpus():
    rng = random.Random(5)
    base, passage = prose(rng, 220), prose(rng, 70)
    texts = {1: base, 2: base, 3: base.replace("w1 ", "zz ", 1), 4: "", 5: None, 6: passage, 7: prose(rng, 40) + " " + passage + " " + prose(rng, 30), 8: "one two", 9: prose(rng, 3000), 10: "a" * 350, 11: "x\ny\n\nz", 12: "ÄÖ straße " * 40, 13: prose(rng, 5) + "\n" + "A shared line of text here\n" + prose(rng, 4), 14: "  a SHARED line of text here \t\nq", 15: "a shared line of text here", 16: passage + "\n" + passage}
    rows = [(i, t, "en", ["s1", "s2", None][i % 3], None, "clash", "big", 7, "s", "r", "h") for i, t in texts.items()]
    return rows + [(None, base, None, None, None, None, None, None, None, None, None), rows[0]]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def pairs():
    return [(-(2**63) if r[0] is None else r[0], (r[1] or "").encode()) for r in corpus()]


def test_suffix_dedup(docs, empty):
    want, seen = {}, {}
    for i, t in pairs():
        for k in range(len(t) - 99):
            w = t[k : k + 100]
            seen[w] = min(seen.get(w, (i, k)), (i, k))
    for i, t in pairs():
        gone = bytearray(len(t))
        for k in range(len(t) - 99):
            if seen[t[k : k + 100]] < (i, k):
                gone[k : k + 100] = b"\1" * 100
        kept = bytes(c for c, g in zip(t, gone) if not g)
        want[i] = (len(t), sum(gone), sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone)), hashlib.sha256(kept).hexdigest())
    got = suffix_dedup.suffix_dedup(docs).collect()
    assert len(got) == len(corpus())
    for r in got:
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[-(2**63) if r.doc_id is None else r.doc_id]
        assert hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256
    assert suffix_dedup.suffix_dedup(empty).count() == 0


def test_kmer_dedup(docs, empty):
    seen, want = {}, {}
    for i, t in pairs():
        w = t.split()
        for k in range(len(w) - 49):
            key = tuple(w[k : k + 50])
            seen[key] = min(seen.get(key, i), i)
    for i, t in pairs():
        w, gone = t.split(), [0] * len(t.split())
        for k in range(len(w) - 49):
            if seen[tuple(w[k : k + 50])] < i:
                gone[k : k + 50] = [1] * 50
        want[i] = (len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest())
    got = kmer_dedup.kmer_dedup(docs).collect()
    assert len(got) == len(corpus()) and sum(r.n_removed for r in got) > 0
    for r in got:
        assert (r.n_words, r.n_removed, r.kept_sha256) == want[-(2**63) if r.doc_id is None else r.doc_id]
    assert kmer_dedup.kmer_dedup(empty).count() == 0


def test_frequent_minimisers_are_split_without_loss(spark, monkeypatch):
    from loomcast.llm import _superkmers

    rng = random.Random(1)
    passage = prose(rng, 60)
    rows = [(i, prose(rng, 30, 5000) + " " + passage + " " + prose(rng, 30, 5000)) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert len(_superkmers.frequent(df, kmer_dedup.WORDS, len(rows)))
    split = {r.doc_id: r.n_removed for r in kmer_dedup.kmer_dedup(df).collect()}
    monkeypatch.setattr(_superkmers, "frequent", lambda *a: np.zeros(0, np.uint64))
    assert split == {r.doc_id: r.n_removed for r in kmer_dedup.kmer_dedup(df).collect()}
    assert split[0] == 0 and all(60 <= split[i] <= 62 for i in range(1, 120))  # a neighbouring word may agree by chance


def test_long_texts_are_cut_into_overlapping_stretches(monkeypatch):
    import pandas as pd

    from loomcast.llm import _superkmers

    rng = random.Random(9)
    passage = prose(rng, 120)
    rows = [(1, "  " + prose(rng, 700) + " " + passage + "\n" + prose(rng, 300) + " "), (2, prose(rng, 90) + " " + passage + " " + prose(rng, 900)), (3, passage), (4, "x" * 5000 + " " + prose(rng, 60)), (5, "")]
    batch = pd.DataFrame([(i, 0, t) for i, t in rows], columns=["_id", "_t", "text"])

    def spans(spec, *how):
        sent = pd.concat(_superkmers.scatter(spec, np.zeros(0, np.uint64), 2, *how[1:])(iter([batch])))
        found = pd.concat([_superkmers.bucket_of(spec, how[0], 1, *how[1:])((b,), g) for b, g in sent.groupby("bucket")])
        got = _superkmers.merged(0, found)
        return {i: (np.frombuffer(a, np.int32).tolist(), np.frombuffer(b, np.int32).tolist()) for i, a, b in zip(got["_id"], got["span_from"], got["span_to"])}

    for spec, *how in ((suffix_dedup.BYTES, suffix_dedup.resolve, suffix_dedup.whole_classes), (kmer_dedup.WORDS, kmer_dedup.resolve)):
        monkeypatch.setattr(_superkmers, "LONG", 1 << 30)
        whole = spans(spec, *how)
        monkeypatch.setattr(_superkmers, "LONG", 1200)
        assert spans(spec, *how) == whole and {2, 3} <= set(whole)


def test_hash_collisions_do_not_join_different_suffixes(monkeypatch):
    """With every prefix hash equal, verification on the bytes still tells windows apart."""
    from loomcast.llm._superkmers import Strings

    text = b"abcd" * 30 + b"abce" * 30
    s = Strings(np.array([0, 1]), np.array([5, 5], np.uint64), np.array([0, 0]), np.array([120, 120]), np.array([30, 30]), np.array([120, 120]), np.array([0, 120]), text, np.array([1, 2]))
    monkeypatch.setattr(suffix_dedup.Suffixes, "extension", lambda self, a, b: np.full(len(a), self.k))
    assert not len(suffix_dedup.resolve(suffix_dedup.BYTES, s, np.array([0, 1]))[0])


def test_every_removed_byte_is_decided_by_neighbours_in_the_suffix_order(monkeypatch):
    """The same steps as on executors, here in one process: chunks, buckets, spans."""
    import pandas as pd

    from loomcast.llm import _superkmers

    def spans():
        rows, spec = [(i, 0, t) for i, t in enumerate(dict.fromkeys(t for _, t in pairs())) if t], suffix_dedup.BYTES
        sent = []
        for lo in (0, 6):  # two chunks, so that both chunks and buckets find repeats
            batch = pd.DataFrame([(i, m, t.decode()) for i, m, t in rows[lo : lo + 6 if lo == 0 else None]], columns=["_id", "_t", "text"])
            sent.append(pd.concat(_superkmers.scatter(spec, np.zeros(0, np.uint64), 3, suffix_dedup.whole_classes)(iter([batch]))))
        found = [_superkmers.bucket_of(spec, suffix_dedup.resolve, 1, suffix_dedup.whole_classes)((b,), g) for b, g in pd.concat(sent).groupby("bucket")]
        blobs = pd.concat(found)
        return sum(int((np.frombuffer(b, np.int32) - np.frombuffer(a, np.int32)).sum()) for a, b in zip(*(_superkmers.merged(0, blobs)[c] for c in ("span_from", "span_to")))) if len(blobs) else 0

    assert spans() > 1000
    monkeypatch.setattr(suffix_dedup.Suffixes, "extension", lambda self, a, b: np.zeros(len(a), np.int64))
    assert spans() == 0


def test_merge_sort_orders_suffixes():
    rng = random.Random(2)
    text = np.frombuffer(bytes(rng.choice(b"ab") for _ in range(400)), np.uint8)
    at, group = np.arange(300), np.repeat([0, 1, 2], [1, 99, 200])
    order = suffix_dedup.merge_sort(at, group, suffix_dedup.Suffixes(text, 100))
    raw = text.tobytes()
    for g in range(3):
        mine = [raw[at[i] : at[i] + 100] for i in order[group == g]]
        assert mine == sorted(mine)


def test_line_dedup(docs, empty):
    lines, held = {}, defaultdict(set)
    for i, t in pairs():
        lines[i] = t.decode().split("\n")
        for x in lines[i]:
            k = x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
            if len(k) >= 20:
                held[k].add(i)
    common = {k: max(v) for k, v in held.items() if len(v) >= 3}
    got = line_dedup.line_dedup(docs)
    assert "_id" in got.columns and got.where("_id = 'clash'").count() == len(corpus()) - 1
    for r in got.collect():
        i = -(2**63) if r.doc_id is None else r.doc_id
        kept = [x for x in lines[i] if common.get(x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)}), i) == i]
        assert (r.text, r.n_lines, r.n_dropped) == ("\n".join(kept), len(lines[i]), len(lines[i]) - len(kept))
    assert common and line_dedup.line_dedup(empty).count() == 0


def test_line_dedup_streams_sorted_ranges(docs, monkeypatch):
    """One range exchange, the sort kept above it, and a window that streams in its order without another exchange."""
    plans, stored = {}, line_dedup.stored

    def noted(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString().splitlines()
        return stored(df, name)

    monkeypatch.setattr(line_dedup, "stored", noted)
    line_dedup.line_dedup(docs).count()
    at = lambda word: [i for i, x in enumerate(plans["streamed"]) if word in x]
    ranges, sorts, windows = at("Exchange rangepartitioning(h1"), [i for i in at(" Sort ") if "_id" in plans["streamed"][i]], at("Window ")
    assert len(ranges) == 1 and sorts and windows and max(windows) < min(sorts) < ranges[0]
    assert not [i for i in at("Exchange hashpartitioning") if i < ranges[0]]


def test_line_dedup_cuts_a_frequent_line(spark, monkeypatch):
    rng = random.Random(8)
    hot, warm = "A line that nearly every document holds", "another line that some of them hold"
    rows = [(i, "\n".join([prose(rng, 8), *([hot] if i % 9 else []), prose(rng, 8), *([warm] * (i % 3 == 0)), "x" * 30 + str(i // 2), hot.upper() if i % 5 == 0 else ""])) for i in range(400)]
    df = spark.createDataFrame([*rows, (None, hot), (None, hot)], "doc_id long, text string")
    plain = sorted(map(str, line_dedup.line_dedup(df).collect()))
    monkeypatch.setattr(line_dedup, "CUT_ROWS", 100)
    keyed = line_dedup.stored(df.selectExpr("doc_id", "posexplode(split(text, '\n')) as (pos, line)").selectExpr("xxhash64(line) h1", "xxhash64('s', line) h2", "coalesce(doc_id, -9) _id", "pos"), "t")
    got = line_dedup.streamed(keyed)
    assert got.where("is_cut").select("h1", "cut").distinct().count() > 2
    assert sorted(map(str, line_dedup.line_dedup(df).collect())) == plain


def test_jaccard_join(docs, empty):
    rows = pairs()
    sets = [set(jaccard_join.shingles(t.decode()).tolist()) for _, t in rows]
    links = [[j for j in range(len(rows)) if j != i and sets[i] and len(sets[i] & sets[j]) * 5 >= 4 * len(sets[i] | sets[j])] for i in range(len(rows))]
    want = Counter()
    for i, (d, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            new = [j for j in links[todo.pop()] if j not in seen]
            seen.update(new)
            todo += new
        want[(d, min(rows[j][0] for j in seen), len(links[i]))] += 1
    plain = lambda x: -(2**63) if x is None else x
    assert Counter((plain(r.doc_id), plain(r.class_id), r.n_links) for r in jaccard_join.jaccard_classes(docs).collect()) == want
    assert jaccard_join.jaccard_classes(empty).count() == 0
    kept = jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns and {plain(r.doc_id) for r in kept.collect()} == {c for d, c, _ in want}


def test_jaccard_join_counts_repeated_rows_once_each(spark):
    base = " ".join(f"w{i}" for i in range(100))
    rows = [(1, base), (1, base), (2, base + " end"), (2, base + " end"), (3, "other words stand here alone")]
    got = Counter(map(tuple, jaccard_join.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == Counter({(1, 1, 3): 2, (2, 1, 3): 2, (3, 3, 0): 1})


def test_jaccard_join_of_large_groups_in_blocks(spark, monkeypatch):
    rng = random.Random(3)
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(w if rng.random() > 0.006 else f"e{i}" for w in base)) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    one = sorted(map(tuple, jaccard_join.jaccard_classes(df).collect()))
    monkeypatch.setattr(jaccard_join, "BLOCK", 16)
    assert sorted(map(tuple, jaccard_join.jaccard_classes(df).collect())) == one
    sets = [set(jaccard_join.shingles(t).tolist()) for _, t in rows]
    assert [n for _, _, n in one] == [sum(len(a & b) * 5 >= 4 * len(a | b) for b in sets) - 1 for a in sets]


def distance(item, text):
    row = list(range(len(item) + 1))
    best = row[-1]
    for c in text:
        prev, row[0] = row[0], 0
        for j in range(1, len(row)):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (item[j - 1] != c))
        best = min(best, row[-1])
    return best


def test_decontaminate(spark, docs, empty):
    rng = random.Random(4)
    items = [(i, prose(rng, 12)) for i in range(6)] + [(6, None), (7, " "), (0, "   "), (None, prose(rng, 12))]
    texts = []
    for i, t in items:
        if t and t.strip():
            edited = t[:10] + "#" + t[11:25] + t[26:]
            texts += [prose(rng, 30) + " " + t.upper().replace(" ", "\n", 1) + " " + prose(rng, 5), prose(rng, 9) + " " + edited + " " + prose(rng, 9), prose(rng, 10) + t[: len(t) // 2] + prose(rng, 10)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, texts[0]), (50, None), (51, "")], "doc_id long, text string")
    it = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.distance for r in decontaminate.find_leaks(df, it, rate=0.05).collect()}
    want = {}
    for d, t in [*enumerate(texts), (None, texts[0])]:
        for i, x in items:
            x = decontaminate.normal(x)
            if x and (n := distance(x, decontaminate.normal(t))) <= int(len(x) * 0.05):
                want[(d, i)] = n
    assert got == want and len(want) >= 14
    for r in decontaminate.find_leaks(df.where("doc_id = 0"), it).collect():
        assert decontaminate.normal(texts[0])[r.match_from : r.match_to] == decontaminate.normal(items[r.item_id][1])
    spelt = spark.createDataFrame([(1, "Alpha  beta gamma delta"), (1, "other words here"), (1, "alpha beta\ngamma DELTA"), (2**53 + 1, "alpha beta gamma delta"), (None, "other words here")], "item_id long, text string")
    held = spark.createDataFrame([(0, "say alpha beta gamma delta now"), (1, "alpha " * 300)], "doc_id long, text string")
    assert Counter((r.doc_id, r.item_id) for r in decontaminate.find_leaks(held, spelt).collect()) == Counter([(0, 1), (0, 2**53 + 1)])
    clean = decontaminate.decontaminate(docs, it)
    assert clean.count() == len(corpus()) and clean.columns == docs.columns
    assert decontaminate.find_leaks(empty, it).count() == 0 and decontaminate.find_leaks(df, it.limit(0)).count() == 0


def plain_katz(rows, out):
    """Scores and probability functions from dictionaries of whole n-grams, by the formulas alone."""
    tokens = [[*re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")), "\n"] for _, t in rows]
    grams = [Counter(), Counter(), Counter()]
    for (i, _), t in zip(rows, tokens):
        for n in range(3):
            grams[n].update([] if out(i) else zip(*[t[k:] for k in range(n + 1)]))
    total = sum(grams[0].values()) + len(grams[0]) + 1
    one = lambda w: (grams[0][(w,)] + 1) / total

    def discounts(counts):
        n, d = Counter(counts.values()), {}
        top = 6 * n[6] / n[1] if n[1] else 1
        for r in range(1, 6):
            x = ((r + 1) * n[r + 1] / (r * n[r]) - top) / (1 - top) if n[r] and top < 1 else 0
            d[r] = x if 0 < x < 1 else (r - 0.5) / r
        return d

    after = defaultdict(dict)
    for g in grams[1:]:
        for x, c in g.items():
            after[x[:-1]][x[-1]] = c
    d = {n: discounts(grams[n]) for n in (1, 2)}

    @functools.cache
    def p(*context):
        lower = p(*context[1:]) if context else None
        if not context:
            return one
        seen = after.get(context)
        if not seen:
            return lower
        size = sum(seen.values()) + (0 if min(seen.values()) <= 5 else 0.1)
        mine = {w: c * d[len(context)].get(c, 1) / size for w, c in seen.items()}
        alpha = (1 - sum(mine.values())) / (1 - sum(map(lower, seen)))
        return lambda w: mine[w] if w in mine else alpha * lower(w)

    scores = []
    for (i, _), t in zip(rows, tokens):
        score = sum(math.log10(p(*t[max(0, k - 2) : k])(w)) for k, w in enumerate(t))
        scores.append((i, out(i), len(t), sum(grams[0][(w,)] > 0 for w in t), sum(grams[0].values()), sum(math.log10(one(w)) for w in t), score))
    return scores, p, grams, after


def katz_corpora():
    rng = random.Random(11)
    some = [f"w{i}" for i in range(60)]
    zipf = [(i, " ".join(rng.choices(some, [1 / (k + 1) for k in range(60)], k=rng.randrange(60)))) for i in range(60)]
    often = [(300 + i, "a b c a b c a b d") for i in range(8)]  # contexts whose counts are all above CUT
    return [[(r[0], r[1]) for r in corpus()], [*zipf, (200, "unk " + zipf[3][1] + " zzz w1 w2"), (202, "w1 " * 90), *often, (402, "a b e b c")]]


@pytest.mark.parametrize("which", [0, 1])
def test_katz(spark, which, monkeypatch):
    rows, out = katz_corpora()[which], lambda i: i is not None and i % 5 == 2
    want = plain_katz(rows, out)[0]
    df, held = spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") % 5 == 2
    close = lambda rows: Counter((*r[:5], round(r[5], 4), round(r[6], 4)) for r in rows)
    assert close(katz_lm.katz_scores(df, held).collect()) == close(want)


def test_katz_tables_are_exactly_normalised(spark):
    rows, out = katz_corpora()[1], lambda i: i % 5 == 2
    _, p, grams, after = plain_katz(rows, out)
    got = katz_lm.katz_tables(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") % 5 == 2).collect()
    name = {int(katz_lm.END.astype(np.int64)): "\n"} | {int(np.uint64(katz_lm._name(w.encode())).astype(np.int64)): w for (w,) in grams[0] if w != "\n"}
    table = {(r.order, *(name[x] for x in (r.u, r.v, r.w) if x is not None), r.w is None): r for r in got}
    assert {k[:1] + k[1:-1] for k in table if not k[-1]} == {(n + 1, *g) for n in range(3) for g in grams[n]}
    assert all(table[(n + 1, *g, False)].n == c for n in range(3) for g, c in grams[n].items())
    assert {k[1:-1] for k in table if k[-1]} == set(after)
    unknown, words_ = 1 / (sum(grams[0].values()) + len(grams[0]) + 1), [w for (w,) in grams[0]]

    def q(context, w):
        if r := table.get((len(context) + 1, *context, w, False)):
            return r.p
        if not context:
            return unknown
        a = table.get((len(context) + 1, *context, True))
        return (a.p if a else 1) * q(context[1:], w)

    for context in [*after, ("w0", "none"), ("none",), ()]:
        assert math.isclose(sum(q(context, w) for w in words_) + q(context, "?"), 1, rel_tol=1e-9), context
        assert math.isclose(q(context, "?"), p(*context)("?"), rel_tol=1e-9)


def test_commonest_words_are_taken_from_the_top_and_no_more(spark):
    counts = {i: 1 + 900 // (i + 1) for i in range(2000)}  # more than half of the words tie at 1
    df = spark.createDataFrame(list(counts.items()), "w long, n long")
    for most in (0, 1, 7, 500, 1400, 2000, 5000):
        got = katz_lm.commonest(df, most)
        assert len(got) <= most and got["n"].is_monotonic_decreasing and not got["w"].duplicated().any()
        least = sorted(counts.values(), reverse=True)[min(most, 2000) - 1] if most else 10**9
        assert {w for w, n in counts.items() if n > least} <= set(got["w"])
        assert most < 2000 or len(got) == 2000
    assert katz_lm.commonest(df.limit(0), 5).empty


def test_katz_with_fewer_codes_than_words(spark, monkeypatch):
    rows, held = katz_corpora()[1], F.col("doc_id") % 5 == 2
    df = spark.createDataFrame(rows, "doc_id long, text string")
    close = lambda rows: Counter((*r[:5], round(r[5], 4), round(r[6], 4)) for r in rows)
    want, all_of = close(katz_lm.katz_scores(df, held).collect()), katz_lm.commonest
    monkeypatch.setattr(katz_lm, "commonest", lambda u, most: all_of(u, 9))
    assert close(katz_lm.katz_scores(df, held).collect()) == want


def test_katz_edges(docs, empty):
    held = (F.col("doc_id") % 5) == 2
    assert katz_lm.katz_scores(empty, held).count() == 0
    none = katz_lm.katz_scores(docs, F.lit(True)).collect()
    assert len(none) == len(corpus()) and {(r.train_tokens, r.score) for r in none} == {(0, 0.0)}


def test_topk(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.normal(0, 0.2, 8)]) for i in range(300)] + [(400, None), (401, [1.0, None]), (402, [float("nan")] * 8), (403, []), (None, [1.0] * 8), (404, [float("inf")] * 8), (405, [0.5] * 8), (406, [0.5] * 8)]
    df = topk_search.impacts(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    v = {i: np.pad(np.floor(256 * np.array(x, float)), (0, 8 - len(x))).astype(int) for i, x in rows if i is not None and x is not None and None not in x and np.isfinite(x).all()}
    got = topk_search.search(topk_search.build_index(df), df.where("vec_id % 50 = 0"), 5).collect()
    want = [(q, r + 1, i, s) for q in v if q % 50 == 0 for r, (s, i) in enumerate(sorted(((int(v[q] @ v[i]), i) for i in v if i != q), key=lambda x: (-x[0], x[1]))[:5])]
    assert sorted(map(tuple, got)) == sorted(want)
    none = df.limit(0)
    assert topk_search.search(topk_search.build_index(none), df).count() == 0 and topk_search.search(topk_search.build_index(df), none).count() == 0


def test_topk_keeps_large_vectors(spark):
    rng = np.random.default_rng(1)
    big = {0: [2.0**19, 1.0, 0.0], 7: [-(2.0**24), 3.0, 1.5], 50: [2.0**21 + 1, -2.0, 0.25], 60: [524287.996, 524287.992, 524287.988]}
    rows = [(i, big.get(i, [float(x) for x in rng.normal(0, 400000 if i % 2 else 1, 3)])) for i in range(120)]
    v = {i: [math.floor(256 * x) for x in e] for i, e in rows}
    df = topk_search.impacts(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = topk_search.search(topk_search.build_index(df), df.where("vec_id % 10 = 0"), 5).collect()
    dot = lambda a, b: sum(x * y for x, y in zip(v[a], v[b]))
    want = [(q, r + 1, i, s) for q in v if q % 10 == 0 for r, (s, i) in enumerate(sorted(((dot(q, i), i) for i in v if i != q), key=lambda x: (-x[0], x[1]))[:5])]
    assert sorted(map(tuple, got)) == sorted(want) and {x.vec_id for x in got} & set(big)
    far = topk_search.impacts(spark.createDataFrame([(0, [2.0**30]), (1, [2.0**30])], "vec_id long, embedding array<double>"))
    with pytest.raises(Exception, match="beyond 64 bits"):
        topk_search.search(topk_search.build_index(far), far).collect()
    with pytest.raises(Exception, match="beyond 64 bits"):
        topk_search.impacts(spark.createDataFrame([(0, [1e300])], "vec_id long, embedding array<double>")).collect()


def test_url_filter(spark, monkeypatch):
    events = spark.createDataFrame([("bad.com", 10, "block"), ("bad.com", 20, "remove"), ("ok.bad.com", 5, "allow"), ("BAD.com", 30, "block"), (None, 1, "block"), ("x.org", None, "block")], "key string, day long, action string")
    rows = [("http://bad.com/a", 9, False), ("http://www.bad.com", 10, True), ("https://u:p@BAD.com:80/?q", 19, True), ("http://bad.com", 20, False), ("http://bad.com", 31, True), ("http://a.ok.bad.com/", 12, False), (None, 12, False), ("nonsense", 12, False), ("http://bad.com", None, False), ("http://notbad.com", 12, False)]
    caps = spark.createDataFrame([(i, u, d, "e", "k") for i, (u, d, _) in enumerate(rows)] * 2, "page_id long, url string, fetch_day long, e string, _day string")
    got = url_filter.url_filter(caps, events)
    assert Counter((r.page_id, r.blocked) for r in got.collect()) == Counter({(i, x[2]): 2 for i, x in enumerate(rows)})
    assert {"e", "_day"} <= set(got.columns)
    hosts = spark.createDataFrame([(i, f"http://h{i}.hot.com/") for i in range(60)] + [(60, "http://[2001:db8::1]:80/x"), (61, "http://10.0.0.1/"), (62, "http://hot.com")] + [(63, "http://one.hot.com/")] * 40, "page_id long, url string").withColumn("fetch_day", F.lit(3))
    listed = spark.createDataFrame([("hot.com", 1, "block"), ("0.1", 1, "block"), ("one.hot.com", 2, "allow"), ("[2001:db8::1]", 0, "block")], "key string, day long, action string")
    small = sorted(map(str, url_filter.url_filter(hosts, listed).collect()))
    by = {r.page_id: r for r in url_filter.url_filter(hosts, listed).collect()}
    assert by[5].blocked and by[60].blocked and by[60].host == "[2001:db8::1]" and not by[61].blocked and by[62].blocked and not by[63].blocked
    monkeypatch.setattr(_common, "BROADCAST_BYTES", -1)
    monkeypatch.setattr(_common, "HOT_ROWS", 10)
    assert sorted(map(str, url_filter.url_filter(hosts, listed).collect())) == small
    assert url_filter.url_filter(caps.limit(0), events).count() == 0 and url_filter.url_filter(caps, events.limit(0)).where("blocked").count() == 0


def test_quality(spark, docs, empty):
    rng = random.Random(6)
    rows = [(i, prose(rng, 60) if i % 3 else " ".join(w + "###" for w in prose(rng, 60).split()), int(i % 3 > 0)) for i in range(300)]
    df, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2], 0) for r in rows] + [(None, 1, 0), (999, 5, 0)], "doc_id long, quality int, toxic int")
    model = quality_gam.train(df, labels, held_out=quality_gam.fold(3) == 1)
    got = {r.doc_id: r for r in quality_gam.classify(df, model).collect()}
    right = [got[r[0]].predicted == r[2] for r in rows]
    assert sum(right) / len(right) > 0.95
    odd = quality_gam.classify(docs, model)
    assert odd.count() == len(corpus()) and odd.where("score is null or score < 0 or score > 1").count() == 0
    assert quality_gam.classify(empty, model).count() == 0
    again = df.unionAll(df).unionAll(spark.createDataFrame([(4, "w1 " * 50)] * 500, df.schema))
    one, two = (quality_gam.train(again, labels, max_rows=200) for _ in range(2))
    assert {r.score for r in quality_gam.classify(df.limit(5), one).collect()} == {r.score for r in quality_gam.classify(df.limit(5), two).collect()}
    blank = quality_gam.train(df, labels.limit(0))
    assert {round(r.score, 3) for r in quality_gam.classify(df, blank).collect()} == {0.5}


def test_quality_tables_against_a_plain_booster():
    """The first rounds' tables, and a score, from loops over rows."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(120, 3))
    y = (x[:, 0] * x[:, 1] + 0.3 * x[:, 2] > 0).astype(float)
    model = quality_gam.fit(x, y, rounds=3, max_pairs=2)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, 33)[1:-1])) for j in range(3)]
    bins = [[int((edges[j] <= v).sum()) for v in x[:, j]] for j in range(3)]
    f = [math.log(((y.sum() + 1) / 122) / (1 - (y.sum() + 1) / 122))] * 120
    tables = [[0.0] * (len(e) + 1) for e in edges]
    assert [list(model.bins(x)[:, j]) for j in range(3)] == bins
    for _ in range(3):
        for j in range(3):
            p = [1 / (1 + math.exp(-v)) for v in f]
            g, h = [0.0] * len(tables[j]), [0.0] * len(tables[j])
            for i, b in enumerate(bins[j]):
                g[b] += y[i] - p[i]
                h[b] += max(p[i] * (1 - p[i]), 1e-6)
            step = quality_gam._tree(np.array(g), np.array(h), 2.0) * 0.15
            for i, b in enumerate(bins[j]):
                f[i] += step[b]
            tables[j] = [a + b for a, b in zip(tables[j], step)]
    assert all(np.allclose(a, b) for a, b in zip(tables, model.tables))
    score = []
    for i in range(120):
        total = model.intercept + sum(model.tables[j][bins[j][i]] for j in range(3))
        total += sum(t[bins[a][i] // model.coarse][bins[b][i] // model.coarse] for a, b, t in model.pairs)
        score.append(1 / (1 + math.exp(-total)))
    assert np.allclose(score, model.score(x)) and len(model.pairs) == 2


def test_mix_ranks_sources_over_ranges(spark):
    rows = [(i, f"s{i % 37:02d}" if i % 37 else None, "w " * (1 + i % 11)) for i in range(800)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = {r.source: (r.source_size, r.target) for r in mix_sources.mix(df).collect()}
    size = Counter()
    for i, s, t in rows:
        size[s] += len(t.split())
    names = sorted(size, key=lambda s: (s is None, s))
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    capped = set()
    while True:
        rest, share = sum(size.values()) - sum(3 * size[s] for s in capped), sum(weight[s] for s in names if s not in capped)
        more = {s for s in names if s not in capped and weight[s] * rest / share > 3 * size[s]}
        if not more:
            break
        capped |= more
    for s in names:
        assert got[s][0] == size[s] and math.isclose(got[s][1], 3 * size[s] if s in capped else weight[s] * rest / share)


def test_mix(docs, empty):
    out = mix_sources.mix(docs)
    rows = out.collect()
    assert len(rows) == len(corpus()) and rows[0]["size"] != "big"
    total = sum(r["size"] for r in rows)
    targets = {r.source: (r.source_size, r.target) for r in rows}
    assert math.isclose(sum(t for _, t in targets.values()), total, rel_tol=1e-9) and all(t <= 3 * s for s, t in targets.values())
    assert all(0 <= r.copies <= 3 for r in rows)
    assert sorted((str(r.doc_id), r.copies) for r in mix_sources.mix(docs).collect()) == sorted((str(r.doc_id), r.copies) for r in rows)
    again = mix_sources.emitted(docs)
    assert again.columns == docs.columns and again.count() == sum(r.copies for r in rows)
    assert mix_sources.mix(empty).count() == 0


def test_joins_beyond_the_broadcast_bound_give_the_same(docs, monkeypatch):
    def results():
        plain = lambda df, *c: sorted(str(tuple(r)) for r in df.select(*c).collect())
        return plain(suffix_dedup.suffix_dedup(docs), "doc_id", "n_removed", "kept_sha256"), plain(line_dedup.line_dedup(docs), "doc_id", "n_dropped", "text"), plain(jaccard_join.jaccard_classes(docs), "doc_id", "class_id", "n_links"), plain(jaccard_join.keep_one(docs), "doc_id")

    small = results()
    monkeypatch.setattr(_common, "BROADCAST_BYTES", -1)
    assert results() == small
    monkeypatch.setattr(_common, "HOT_ROWS", 1)  # every key that repeats is dealt apart
    assert results() == small

"""Product codes, toxicity and spelling variants against brute force on small tables with nulls, ties, repeats and clashing names."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from loomcast.llm import _common, spelling, toxicity, vector_codes

VECTORS = "vec_id long, embedding array<double>, label int, code string, v string, _l string, upper int"


def plain_codes(rows, entries=256, rounds=4):
    """Lloyd without bounds, in Python's integers."""
    kept = [(i, [math.floor(1024 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    length = len(kept[0][1]) if kept else 0
    fits = [r for r in kept if len(r[1]) == length]
    w = length // 4
    cut = lambda v, p: v[p * w : (p + 1) * w]
    books = [[cut(r[1], p) for r in kept[:entries] if len(r[1]) == length] for p in range(4)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    find = lambda v: [min(range(len(books[p])), key=lambda e: (far(cut(v, p), books[p][e]), e)) for p in range(4)]
    for _ in range(rounds):
        own = defaultdict(list)
        for _, v, _ in fits:
            for p, e in enumerate(find(v)):
                own[p, e].append(cut(v, p))
        for (p, e), vs in own.items():
            books[p][e] = [sum(c) // len(vs) for c in zip(*vs)]
    out, errors = [], Counter()
    for i, v, label in kept:
        code = error = None
        if len(v) == length:
            at = find(v)
            code, error = "".join(f"{e:02x}" for e in at), sum(far(cut(v, p), books[p][e]) for p, e in enumerate(at))
            errors[label] += error
        out.append([i, code, error, label])
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted((repr((i, code, error, errors[label] if label in errors else None, digest)) for i, code, error, label in out))


def vectors(n, dims, seed, spread=1.0):
    rng = random.Random(seed)
    rows = [(i, [round(rng.gauss(0, spread), 1) for _ in range(dims)], rng.choice([1, 2, None])) for i in range(n)]
    rows += [(n + 1, None, 1), (n + 2, [float("nan")] * dims, 1), (n + 3, [None] + [0.0] * (dims - 1), 2), (n + 4, [float("inf")] * dims, 2), (None, [0.5] * dims, None), rows[3], rows[3], (7, [0.1] * dims, 1)]
    rng.shuffle(rows)
    return rows


def coded(spark, rows, **how):
    df = spark.createDataFrame([(*r, "c", "v", "l", 1) for r in rows], VECTORS)
    return sorted(repr((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256)) for r in vector_codes.vector_codes(df, **how).collect())


@pytest.mark.parametrize("rows,how", [(vectors(120, 8, 1), {"entries": 16}), (vectors(60, 4, 2), {"entries": 16}), (vectors(40, 8, 3, 3e4), {"entries": 8}), (vectors(12, 8, 4, 1e6), {"entries": 14}), (vectors(20, 4, 5) + [(90, [0.1, 0.2], 3), (91, [], 3)], {})])
def test_vector_codes(spark, rows, how):
    assert coded(spark, rows, **how) == plain_codes(rows, **how)


def test_vector_codes_of_nothing(spark):
    assert coded(spark, []) == []
    assert coded(spark, [(1, None, 1), (2, [float("nan")], 1)]) == []
    odd = coded(spark, [(1, [0.5, 0.5, 0.5], None)])
    assert len(odd) == 1 and odd[0].startswith("(1, None, None, None")


def test_bounds_spare_scans_and_change_nothing(spark):
    """Where clusters are apart most parts are scanned once; each round's bounds hold."""
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.integers(-20, 20, (80, 4)) + 5000 * k for k in range(6)]).astype(np.int64)
    rng.shuffle(x)
    books, before, old, scans = x[:12].copy(), None, None, []
    for _ in range(5):
        at, upper, lower, n = vector_codes.assign(x, books, before, vector_codes.Moves(old, books) if old is not None else None)
        d2 = ((x[:, None] - books[None]) ** 2).sum(2)
        assert (at == d2.argmin(1)).all() and (upper.astype(float) ** 2 >= d2.min(1)).all()
        d2[np.arange(len(x)), at] = 2**62
        assert (lower.astype(float) ** 2 <= d2.min(1)).all()
        scans.append(n)
        old, before = books, (at, upper, lower)
        books = np.array([x[at == e].sum(0) // max((at == e).sum(), 1) if (at == e).any() else books[e] for e in range(12)])
    assert scans[0] == len(x) and min(scans[1:]) < len(x)


def edits(x, y):
    if abs(len(x) - len(y)) > 1:
        return 2
    row = list(range(len(y) + 1))
    for i, a in enumerate(x, 1):
        last, row[0] = row[0], i
        for j, b in enumerate(y, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (a != b))
    return row[-1]


def plain_words(rows):
    n = Counter()
    for i, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}
    near = {w: [v for v in n if edits(w, v) == 1] for w in n}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, n[w], len(near[w]), form[w], n.get(form[w]), root))
    return sorted(map(repr, out))


def spelled():
    rng = random.Random(3)
    base = ["".join(rng.choice("abcÄéÿ") for _ in range(rng.randint(5, 9))) for _ in range(40)] + ["aaaaa", "aaaaaa", "aaaaaaa", "abababab", "babababa"]
    every = list(base)
    for w in base * 3:
        k = rng.randrange(len(w))
        every.append(rng.choice([w[:k] + w[k + 1 :], w[:k] + "x" + w[k:], w[:k] + "b" + w[k + 1 :]]))
    rows = [(i, rng.choice([" ", ", ", "-", "1", "\n"]).join(rng.choices(every, k=60) + [rng.choice(every).upper()]), "e") for i in range(40)]
    return rows + [(None, rows[0][1], None), (41, None, None), (42, "", None), rows[1], (43, "x" * 3000 + " " + "q" * 300, None), (44, "1 ".join(["q" * 300] * 3 + ["q" * 299] * 3 + ["q" * 20_000] * 3), None)]


@pytest.mark.parametrize("group,bucket", [(4096, 16_384), (5, 50)])
def test_spelling_variants(spark, monkeypatch, group, bucket):
    monkeypatch.setattr(spelling.linked, "__defaults__", (spelling.SHORTEST, group, bucket))
    rows = spelled()
    df = spark.createDataFrame([(*r, "w", "f") for r in rows], "doc_id long, text string, lang string, word string, form string")
    got = [tuple(r[c] for c in ("word", "n", "n_near", "form", "form_n", "root")) for r in spelling.spelling_variants(df).collect()]
    want = plain_words(rows)
    assert sorted(map(repr, got)) == want and any(r[3] for r in got) and len({r[5] for r in got}) < len(got)


@pytest.mark.parametrize("side", [0, 1])
def test_only_postings_that_an_edit_leaves_are_merged(monkeypatch, side):
    rng, seen, merge = random.Random(8), [], spelling.heapq.merge
    monkeypatch.setattr(spelling.heapq, "merge", lambda *lists: seen.append(sum(map(len, lists))) or merge(*lists))
    for m in (5, 8, 11):
        h = m // 2
        half = "abcde"[:h]
        own = lambda n: sorted({(half + r if side == 0 else r + half) for r in ("".join(rng.choices("abc", k=n - h)) for _ in range(40))})
        short, long = own(m), own(m + 1)
        want = {frozenset((x, w)) for x in short for w in short + long if edits(x, w) == 1 and not (side and x[:h] == w[:h])}
        mixed = short + long
        rng.shuffle(mixed)
        for first, second in ((mixed, None), (mixed[::2], mixed[1::2])):
            got = [frozenset(p) for p in spelling.near(m, side, first, second)]
            inside = {p for p in want if second is None or len(p & set(first)) == 1}
            assert len(got) == len(set(got)) and set(got) == inside and got
        seen.clear()
        assert not list(spelling.near(m, side, long, None)) and not sum(seen)  # longer words meet under the next key
        list(spelling.near(m, side, short, None))
        q = max(1, (m - h - 1) // 2)
        rests = [w[h:] if side == 0 else w[: m - h] for w in short]
        assert sum(seen) == sum(x[p : p + q] == y[p : p + q] for i, x in enumerate(rests) for y in rests[:i] for p in range(m - h - q + 1))


def test_spelling_variants_of_nothing(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "one two")], "doc_id long, text string")
    assert spelling.spelling_variants(df).count() == 0 and spelling.spelling_variants(df.limit(0)).count() == 0


def test_forms_lead_to_roots_in_few_rounds(spark):
    chain = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(20)], "word string, form string")
    got = {r.word: r.root for r in spelling.roots(_common.stored(chain, "chain")).collect()}
    assert got == {f"w{i}": "w20" for i in range(20)}


def speech(seed, n):
    """Documents of syllables; every seventh holds a few of five rude words."""
    rng = random.Random(seed)
    parts, rude = ["ta", "ren", "lo", "mi", "sel", "ku", "dor", "ni", "esh", "pa"], ["gruzwick", "blethorpe", "snivvock", "wurpled", "crottish"]
    rows = []
    for i in range(n):
        words = ["".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(rng.choice([30, 120, 400]))]
        toxic = i % 7 == 0
        for _ in range(rng.randint(1, 4) if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(rude) + rng.choice(["", ",", "."]))
        rows.append((seed * 100_000 + i, " ".join(words), int(toxic)))
    return rows


def test_toxicity_on_held_out_documents(spark):
    rows = speech(1, 700)
    df = spark.createDataFrame([(i, t, "x", 3) for i, t, _ in rows], "doc_id long, text string, score string, predicted int")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (rows[0][0], 1), (5, 7)], "doc_id long, toxic int")
    model = toxicity.train(df, labels, held_out=toxicity.fold(4) == 2)
    more = speech(2, 300) + [(None, None, 0), (1, "", 0), (2, "word " * 20_000, 0), (3, "z" * 100_000, 0), (4, "ta ren lo " * 5000 + " gruzwick blethorpe ", 1)]
    got = toxicity.classify(spark.createDataFrame([(i, t, "x", 3) for i, t, _ in more], df.schema), model).collect()
    assert len(got) == len(more) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    right = Counter((y, r.predicted) for (_, _, y), r in zip(more, got))
    assert right[1, 1] >= 0.95 * (right[1, 0] + right[1, 1]) and right[0, 0] >= 0.99 * (right[0, 0] + right[0, 1])


def test_toxicity_forgets_and_scores_alike(spark, monkeypatch):
    """What a task remembers decides nothing."""
    rows = speech(3, 60)
    toxic, plain = (Counter(w for _, t, y in rows if y == k for w in toxicity.windows(t)) for k in (1, 0))
    import pandas as pd

    table = lambda c: pd.DataFrame(sorted(c.items()), columns=["w", "n"])
    model = toxicity.compare(table(toxic), table(plain), 9)
    texts = [t for _, t, _ in rows] + ["", None]
    want = [model.gauge().features(t) for t in texts]
    gauge = model.gauge()
    assert [gauge.features(t) for t in texts] == want
    monkeypatch.setattr(toxicity, "MEMO", 7)
    gauge = model.gauge()
    assert [gauge.features(t) for t in texts] == want


def test_toxicity_without_examples(spark):
    df = spark.createDataFrame([(1, "some text"), (2, None), (None, "")], "doc_id long, text string")
    for labels in ([], [(1, 1)], [(1, 1), (2, 0)], [(9, 1), (None, 0), (1, None)]):
        model = toxicity.train(df, spark.createDataFrame(labels, "doc_id long, toxic int"))
        got = toxicity.classify(df, model).collect()
        assert len(got) == 3 and all(0 <= r.score <= 1 for r in got)
    assert toxicity.classify(df.limit(0), model).count() == 0


def test_paths_of_many_sets_are_dealt_over_tasks(spark, monkeypatch):
    """Near copies on one path: no task holds more of it than the bound, what stands for them meets, and links stay as they were."""
    import pandas as pd

    from loomcast.llm import jaccard_join as jj

    rng = random.Random(4)
    base = [f"w{rng.randrange(5000)}" for _ in range(120)]
    rows = []
    for i in range(300):
        words = list(base)
        words[rng.randrange(120)] = f"v{i}"
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, " ".join(f"u{rng.randrange(5000)}" for _ in range(60))) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    whole = {r.doc_id: (r.class_id, r.n_links) for r in jj.jaccard_classes(df).collect()}
    sizes, links = spark.sparkContext.accumulator(0), jj._links

    def watched(batches):
        for b in batches:
            for _, g in b.groupby(["path", "part"]):
                if g["parts"].iloc[0] > 1 and len(g) > 40:
                    sizes.add(1)
            yield from links(iter([b]))

    monkeypatch.setattr(jj, "PATH", 20)
    monkeypatch.setattr(jj, "_links", watched)
    assert {r.doc_id: (r.class_id, r.n_links) for r in jj.jaccard_classes(df).collect()} == whole
    assert sizes.value == 0 and whole[0] == (0, 299) and whole[1000] == (1000, 0)


def test_a_path_goes_on_from_batch_to_batch():
    """However a path is cut into batches, the same sets are connected."""
    import pandas as pd

    from loomcast.llm import jaccard_join as jj

    rng = np.random.default_rng(2)
    heads = rng.integers(1, 255, (5, jj.BINS)).astype(np.uint8)
    sk = heads[rng.integers(0, 5, 200)].copy()
    for x in sk:
        x[rng.integers(0, jj.BINS, rng.integers(0, 30))] = 7
    d = [bytes([i, 3] * 8) + b"\1" for i in range(200)]
    table = pd.DataFrame({"path": [1] * 150 + [2] * 50, "part": 0, "parts": 1, "d1": d, "sketch": [x.tobytes() for x in sk]})

    def classes(cuts):
        label = {x: x for x in d}

        def find(x):
            while label[x] != x:
                x = label[x]
            return x

        for b in jj._links(table.iloc[a:z] for a, z in zip([0, *cuts], [*cuts, 200])):
            for a, z in b[b["path"].isna()][["a", "b"]].itertuples(index=False):
                label[max(find(a), find(z))] = min(find(a), find(z))
        return [find(x) for x in d]

    want = classes([])
    assert 2 <= len(set(want)) < 60
    for cuts in ([1], [75, 149, 150, 151], list(range(10, 200, 10))):
        got = classes(cuts)
        assert len(set(got)) <= 1.2 * len(set(want)) + 1

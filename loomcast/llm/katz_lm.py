"""Katz back-off language model of order 3: Good-Turing discounted n-grams with exactly normalised back-off weights.

    P(w | u v) = d3(c) c / C(u v)          where c = c(u v w) > 0 in the training documents
               = alpha(u v) P(w | v)        otherwise; P(w | v) alike over bigrams, backing off to P(w)
    P(w)       = (c(w) + 1) / (N + V + 1)   for known words, and for the one unknown word with c = 0

d(1) .. d(CUT) are Katz's discounts from the counts of counts of each order; alpha makes every context sum
to exactly 1. A context whose counts are all above CUT has nothing discounted: only there RESERVE is added
to its total. The first word of a text has no context, the second a context of one word.

Tables are dealt out by the middle word v, where all of P(. | u v) and P(. | v) lie together. A chunk of
documents sends each bucket the trigrams it has there with the documents that hold them; what returns for
a document are sums of logarithms. Counts of rare words, and bigrams of a middle word whose share of all
tokens is so large that it is spread by (u, v), are partial in a bucket: it sends them to merges, dealt by
ranges of the last word's hash, which answer with the sums. With these the recursion ends in the bucket.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import id_in, id_out, release, stored
from ._superkmers import mixed, pack, unpack

RESERVE, CUT = 0.1, 5
#: Bytes of text in a chunk and meant for a bucket; documents in a chunk at most.
CHUNK, BUCKET, DOCS = 6 << 20, 9 << 20, 60_000
#: The commonest words are written as codes, others by their hash: a table of fixed size that loses nothing.
CODES = (1 << 18) - 1
#: A middle word is spread when its share of the training tokens is that of a bucket, but not below FREQUENT.
FREQUENT = 1e-4
_G = np.uint64(0x9E3779B97F4A7C15)
#: No word contains a space. NONE is the code of what precedes a text.
END, NONE = np.uint64(xxhash.xxh3_64_intdigest(b" end")), CODES
#: kind and key: docs, sums (chunk), late, answer (bucket), ask (merge), stats (none); place: which bucket asks, which merge answers.
PARTS = "kind string, key long, place long, blob binary"
COLUMNS = ["kind", "key", "place", "blob"]


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").lower().split()


def _name(w: bytes) -> int:
    return xxhash.xxh3_64_intdigest(w)


def pack_sorted(h: np.ndarray) -> bytes:
    """Ascending hashes as byte planes of their differences, which compress."""
    return np.ascontiguousarray(np.diff(h, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T).tobytes()


def unpack_sorted(b: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64)


#: Sums of logarithms travel as whole multiples of this.
_UNIT = 1e-9


def _whole(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(np.rint(x / _UNIT).astype(np.int64).view(np.uint8).reshape(-1, 8).T)


def _real(planes: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(planes.T).view(np.int64).ravel() * _UNIT


class Lexicon:
    """What every task knows of words: hashes and training counts of the commonest, and which middle words are spread.

    hashes come by falling count, so that common words have small codes: their high bytes compress.
    """

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, hot: np.ndarray):
        fill = CODES + 1 - len(hashes)
        self.hashes, self.counts, self.hot = hashes, np.pad(counts, (0, fill)), np.pad(np.isin(hashes, hot), (0, fill))
        self._code = np.argsort(hashes)
        self._sorted = hashes[self._code]

    def codes(self, h: np.ndarray) -> np.ndarray:
        """Codes of hashes, -1 for those that are not among the commonest."""
        if not len(self.hashes):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self._sorted, h), len(self.hashes) - 1)
        return np.where(self._sorted[at] == h, self._code[at], -1)

    def ids(self, h: np.ndarray, rare: np.ndarray) -> np.ndarray:
        """Codes of hashes, beyond them places among the rare."""
        c = self.codes(h)
        return np.where(c >= 0, c, CODES + 1 + np.searchsorted(rare, h))

    def names(self, ids: np.ndarray, rare: np.ndarray) -> np.ndarray:
        every = np.concatenate([self.hashes, np.zeros(CODES + 1 - len(self.hashes), np.uint64), rare])
        return every[ids]


def _planes(ids: np.ndarray) -> bytes:
    """Numbers below 2^32 as byte planes, which compress."""
    return np.ascontiguousarray(ids.astype(np.uint32).view(np.uint8).reshape(-1, 4).T).tobytes()


def _plain(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(4, -1).T).view(np.int32).ravel()


def _counts(n: np.ndarray) -> bytes:
    """Counts of the corpus, which 32 bits may not hold, as byte planes."""
    return np.ascontiguousarray(n.astype(np.int64).view(np.uint8).reshape(-1, 8).T).tobytes()


def _counted(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(8, -1).T).view(np.int64).ravel()


def _edges(*columns: np.ndarray) -> np.ndarray:
    """Where any of the columns changes, 0 first."""
    if not len(columns[0]):
        return np.zeros(0, np.int64)
    new = np.zeros(len(columns[0]), bool)
    new[0] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _lengths(edges: np.ndarray, n: int) -> np.ndarray:
    return np.diff(np.append(edges, n))


class _Chunk:
    def __init__(self):
        self.known: dict[bytes, int] = {}
        self.ids: list[np.ndarray] = []
        self.docs: list[tuple] = []
        self.size = 0

    def add(self, doc_id, held_out: bool, text: str | None) -> None:
        w, known = words(text), self.known
        self.ids.append(np.fromiter((known.setdefault(x, len(known) + 2) for x in w), np.int32, len(w)))
        self.docs.append((doc_id, held_out))
        self.size += len(text or "") + 64

    def blobs(self, number: int, buckets: int, lexicon: Lexicon) -> Iterator[tuple]:
        """(bucket, kind, blob): the documents, and for each bucket its trigrams with the documents of each."""
        ids, held = [d[0] for d in self.docs], np.array([d[1] for d in self.docs], bool)
        n = np.array([len(x) + 1 for x in self.ids], np.int64)
        yield number % buckets, "docs", pack((number, ids, held, n))
        bits = np.packbits(~held).tobytes()
        # local words: 0 for none, 1 for the end; renumbered by bucket, then code, so that sorting by word sorts by both
        h = np.concatenate([np.array([0, END], np.uint64), np.fromiter((_name(x) for x in self.known), np.uint64, len(self.known))])
        to = (mixed(h * _G) % np.uint64(buckets)).astype(np.int64)
        code = lexicon.codes(h)
        order = np.lexsort((h[1:], np.where(code < 0, CODES, code)[1:], to[1:])) + 1
        rank = np.zeros(len(h), np.int32)
        rank[order] = np.arange(1, len(h), dtype=np.int32)
        h, to, code = (np.concatenate([x[:1], x[order]]) for x in (h, to, code))
        code[0] = NONE
        hot = lexicon.hot[code] & (code >= 0)
        end = np.ones(1, np.int32)
        w = rank[np.concatenate([y for x in self.ids for y in (x, end)])]
        start = np.cumsum(n) - n
        v = np.concatenate([[0], w[:-1]]).astype(np.int32)
        v[start] = 0
        u = np.concatenate([[0], v[:-1]]).astype(np.int32)
        u[start] = 0
        doc = np.repeat(np.arange(len(n), dtype=np.uint16), n)
        spread = hot[v] | (v == 0)
        m = np.int64(len(h))
        del start
        for some, deal in ((np.flatnonzero(~spread), None), (np.flatnonzero(spread), "mixed")):
            x, y, z, d = u[some], v[some], w[some], doc[some]
            b = to[y] if deal is None else np.where(y == 0, to[z], (mixed(h[y] * _G + h[x]) % np.uint64(buckets)).astype(np.int64))
            if deal is None and m < 1 << 20:
                o = np.argsort((y * m + x) * m + z, kind="stable")
            else:
                o = np.lexsort((z, x, y, b))
            x, y, z, d, b = x[o], y[o], z[o], d[o], b[o]
            del o
            heads = _edges(x, y, z, d)  # a document that holds a gram several times sends it once
            times, x, y, z, d, b = _lengths(heads, len(d)), x[heads], y[heads], z[heads], d[heads], b[heads]
            cut = np.searchsorted(b, np.arange(buckets + 1))
            for k in np.flatnonzero(cut[1:] > cut[:-1]):
                s = slice(cut[k], cut[k + 1])
                yield int(k), "grams", self._blob(number, bits, len(n), h, code, x[s], y[s], z[s], d[s], times[s])

    @staticmethod
    def _blob(number, bits, docs, h, code, u, v, w, doc, times) -> bytes:
        gram = _edges(u, v, w)
        gu, gv, gw = u[gram], v[gram], w[gram]
        ctx = _edges(gu, gv)
        mid = _edges(gv[ctx])
        used = (gu[ctx], gv[ctx][mid], gw)
        rare = np.unique(np.concatenate([h[x[code[x] < 0]] for x in used]))
        write = lambda x: _planes(np.where(code[x] >= 0, code[x], CODES + 1 + np.searchsorted(rare, h[x])))
        return pack((number, docs, bits, pack_sorted(rare), write(used[1]), _planes(_lengths(mid, len(ctx))), write(used[0]), _planes(_lengths(ctx, len(gram))), write(used[2]), _planes(_lengths(gram, len(doc))), doc, _planes(times)))


def _chunks(buckets: int, lexicon) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, seq, chunk = TaskContext.get().partitionId(), 0, _Chunk()

        def flush() -> Iterator[pd.DataFrame]:
            nonlocal seq, chunk
            rows = []
            for row in chunk.blobs((part << 24) + seq, buckets, lexicon.value):
                rows.append(row)
                if len(rows) == 64:
                    yield pd.DataFrame(rows, columns=["bucket", "kind", "blob"])
                    rows = []
            yield pd.DataFrame(rows, columns=["bucket", "kind", "blob"])
            seq, chunk = seq + 1, _Chunk()
            release()

        for b in batches:
            for i, o, t in zip(b["doc_id"].tolist(), b["held_out"].tolist(), b["text"]):
                chunk.add(i, o, t)
                if chunk.size >= CHUNK or len(chunk.docs) >= DOCS:
                    yield from flush()
        if chunk.docs:
            yield from flush()

    return run


def _logs(n: np.ndarray) -> np.ndarray:
    return np.log10(np.maximum(n, 1))


class _Contexts:
    """Totals of contexts from the counts c of what follows, `of` the context of each."""

    def __init__(self, of: np.ndarray, c: np.ndarray, size: int):
        total = lambda x: np.bincount(of, x, size)
        self.plain, self.low = total(c), total((c > 0) & (c <= CUT))
        self.total = self.plain + np.where((self.plain > 0) & (self.low == 0), RESERVE, 0.0)

    @staticmethod
    def mass(c: np.ndarray, discounts: np.ndarray) -> np.ndarray:
        """Discounted counts."""
        return np.where(c > CUT, c, discounts[np.clip(c, 1, CUT) - 1] * c).astype(float)


def _alpha(used: np.ndarray, below: np.ndarray) -> np.ndarray:
    """What is left over what the lower order leaves."""
    return np.maximum(1 - used, 0) / np.maximum(1 - below, 1e-300)


def _sums(number: int, docs: np.ndarray, real: list[np.ndarray], whole: list[np.ndarray]) -> tuple:
    """A chunk's sums by document, for the documents that have any."""
    here = np.unique(docs)
    at = np.searchsorted(here, docs)
    add = lambda x: np.bincount(at, x, len(here))
    return ("sums", number, 0, pack((here.astype(np.uint16), np.stack([_whole(add(x)) for x in real]), np.stack([add(x).astype(np.int32) for x in whole]))))


def _ranges(h: np.ndarray, merges: int) -> np.ndarray:
    """Where the ranges of ascending hashes begin and end; merges is a power of two."""
    if merges == 1:
        return np.array([0, len(h)])
    step = np.uint64(2**64 // merges)
    return np.concatenate([[0], np.searchsorted(h, step * np.arange(1, merges, dtype=np.uint64)), [len(h)]])


def _count(lexicon, merges: int) -> Callable:
    """A bucket: counts trigrams, adds up what tokens of seen trigrams give their documents, keeps the rest for later."""

    def run(key, blobs: pd.DataFrame) -> pd.DataFrame:
        release()  # what the bucket before left
        lex, bucket = lexicon.value, int(key[0])
        out, got = [], []
        for kind, blob in zip(blobs["kind"], blobs["blob"]):
            g = unpack(blob)
            if kind == "docs":
                out.append(("docs", g[0], 0, blob))
            else:
                got.append((*g[:3], unpack_sorted(g[3]), *map(_plain, g[4:10]), g[10].astype(np.int32), _plain(g[11])))
        if not got:
            return pd.DataFrame(out, columns=COLUMNS)
        rare = np.unique(np.concatenate([g[3] for g in got]))
        us, vs, ws, trained = [], [], [], []
        for _, docs, bits, own, v, per_v, u, per_ctx, w, per_gram, doc, times in got:
            at = np.searchsorted(rare, own)
            known = lambda x: np.where(x <= CODES, x, CODES + 1 + np.append(at, 0)[np.maximum(x - CODES - 1, 0)])  # noqa: E731, B023
            vs.append(np.repeat(np.repeat(known(v).astype(np.int32), per_v), per_ctx))
            us.append(np.repeat(known(u).astype(np.int32), per_ctx))
            ws.append(known(w).astype(np.int32))
            train = np.unpackbits(np.frombuffer(bits, np.uint8), count=docs)
            trained.append(np.add.reduceat(train[doc] * times, np.cumsum(per_gram) - per_gram))
        got = [(g[0], len(g[8]), g[9], g[10].astype(np.uint16), g[11]) for g in got]
        top = np.int64(CODES + 1 + len(rare))
        ctx, of = np.unique(np.concatenate(vs) * top + np.concatenate(us), return_inverse=True)
        del us, vs
        gram, at = np.unique(of * top + np.concatenate(ws), return_inverse=True)
        del ws, of
        at, grams = at.astype(np.int32), len(gram)
        c = np.bincount(at, np.concatenate(trained), grams).astype(np.int64)
        gc, gw = (gram // top).astype(np.int32), (gram % top).astype(np.int32)
        cv, cu = (ctx // top).astype(np.int32), (ctx % top).astype(np.int32)
        del trained, gram, ctx
        three = (cu != NONE)[gc]
        totals = _Contexts(gc, np.where(three, c, 0), len(cv)).total
        tri = np.bincount(np.minimum(c[three], CUT + 2), minlength=CUT + 3)[1 : CUT + 2]
        # bigrams: whole for a middle word that lies here alone, else to be added up
        gv = cv[gc]
        has = np.flatnonzero(gv != NONE)
        pair, of = np.unique(gv[has] * top + gw[has], return_inverse=True)
        c2 = np.bincount(of, c[has], len(pair)).astype(np.int64)
        pv, pw = (pair // top).astype(np.int32), (pair % top).astype(np.int32)
        del gv, has, pair, of
        spread = np.append(lex.hot, np.zeros(len(rare), bool))[pv]
        two = np.bincount(np.minimum(c2[~spread], CUT + 2), minlength=CUT + 3)[1 : CUT + 2]
        out.append(("stats", 0, 0, pack((tri.tolist(), two.tolist()))))
        # what other buckets hold a part of goes to merges, by ranges of the last word's hash
        asked = np.unique(gw[gw > CODES])
        n1 = np.bincount(np.searchsorted(asked, gw[gw > CODES]), c[gw > CODES], len(asked)).astype(np.int64)
        h1, h2, v2, n2 = rare[asked - CODES - 1], lex.names(pw[spread], rare), pv[spread], c2[spread]
        o = np.lexsort((v2, h2))
        h2, v2, n2 = h2[o], v2[o], n2[o]
        e1, e2 = _ranges(h1, merges), _ranges(h2, merges)
        for k in range(merges):
            x, y = slice(e1[k], e1[k + 1]), slice(e2[k], e2[k + 1])
            out.append(("ask", k, bucket, pack((pack_sorted(h1[x]), _counts(n1[x]), pack_sorted(h2[y]), _planes(v2[y]), _counts(n2[y])))))
        seen = three & (c > 0)
        del c2, pv, pw, spread
        base = np.append(_logs(lex.counts + 1), np.zeros(len(rare)))
        open_ = np.flatnonzero(~seen)
        place = np.full(grams, -1, np.int32)
        place[open_] = np.arange(len(open_))
        late, lo = [], 0
        for number, n, per_gram, doc, times in got:
            g = np.repeat(at[lo : lo + n], per_gram)
            lo += n
            t, cg, ok = times.astype(float), c[g], seen[g]
            value = np.where(ok, _logs(cg) - np.log10(np.maximum(totals[gc[g]], 1e-300)), 0.0)
            low = [np.where(ok & (cg == r), t, 0) for r in range(1, CUT + 1)]
            out.append(_sums(number, doc, [value * t, base[gw[g]] * t], [(gw[g] < len(lex.hashes)) * t, *low]))
            wait, scarce = place[g] >= 0, gw[g] > CODES
            if wait.any() or scarce.any():
                late.append((number, doc[wait].astype(np.uint16), _planes(times[wait]), _planes(place[g[wait]]), doc[scarce].astype(np.uint16), _planes(times[scarce]), _planes(gw[g[scarce]] - CODES - 1)))
        # the bucket's tables, as they are stored: contexts, and of each its words with counts
        keep = np.flatnonzero(c > 0)
        used = np.unique(gc[keep])
        blob = pack((pack_sorted(rare), _planes(cv[used]), _planes(cu[used]), _planes(np.bincount(np.searchsorted(used, gc[keep]), minlength=len(used))), _planes(gw[keep]), _counts(c[keep]), _planes(cv[gc[open_]]), _planes(cu[gc[open_]]), _planes(gw[open_]), late, _planes(asked - CODES - 1), pack_sorted(h2), _planes(v2)))
        out.append(("late", bucket, 0, blob))
        return pd.DataFrame(out, columns=COLUMNS)

    return run


def _merge(lexicon) -> Callable:
    """A range of last words: adds up what buckets hold of words and of spread bigrams, and answers each."""

    def run(key, asks: pd.DataFrame) -> pd.DataFrame:
        lex, got = lexicon.value, [unpack(b) for b in asks["blob"]]
        h1, n1, h2, v2, n2 = ([read(g[i]) for g in got] for i, read in enumerate((unpack_sorted, _counted, unpack_sorted, _plain, _counted)))
        words_, at1 = np.unique(np.concatenate(h1), return_inverse=True)
        c1 = np.bincount(at1, np.concatenate(n1), len(words_)).astype(np.int64)
        w, v = np.concatenate(h2), np.concatenate(v2)
        o = np.lexsort((v, w))
        heads = _edges(w[o], v[o])
        at2 = np.empty(len(w), np.int64)
        at2[o] = np.repeat(np.arange(len(heads)), _lengths(heads, len(w)))
        c2 = np.bincount(at2, np.concatenate(n2), len(heads)).astype(np.int64)
        w, v = w[o][heads], v[o][heads].astype(np.int64)
        code = lex.codes(w)
        count = np.where(code >= 0, lex.counts[code], np.append(c1, 0)[np.searchsorted(words_, w)])
        mids, of = np.unique(v, return_inverse=True)
        total = lambda x: np.bincount(of, x, len(mids)).astype(np.int64)
        table = [total(c2 == r) for r in range(1, CUT + 1)] + [total(np.where(c2 > CUT, c2, 0)), total(np.where(c2 > 0, count + 1, 0))]
        two = np.bincount(np.minimum(c2, CUT + 2), minlength=CUT + 3)[1 : CUT + 2]
        out = [("spread", int(key[0]), 0, pack((mids.tolist(), np.stack(table, 1).tolist(), two.tolist())))]
        lo1 = lo2 = 0
        for place, x, y in zip(asks["place"].tolist(), h1, h2):
            out.append(("answer", place, int(key[0]), pack((_counts(c1[at1[lo1 : lo1 + len(x)]]), _counts(c2[at2[lo2 : lo2 + len(y)]])))))
            lo1, lo2 = lo1 + len(x), lo2 + len(y)
        release()
        return pd.DataFrame(out, columns=COLUMNS)

    return run


def good_turing(counts: list[int]) -> np.ndarray:
    """Katz's discounts of the counts 1..CUT from counts of counts 1..CUT+1; (r - 1/2) / r where they give none in (0, 1)."""
    n = np.array(counts, float)
    out = np.array([(r - 0.5) / r for r in range(1, CUT + 1)])
    top = (CUT + 1) * n[CUT] / n[0] if n[0] else 1.0
    for r in range(1, CUT + 1):
        if n[r - 1] and top < 1:
            d = ((r + 1) * n[r] / (r * n[r - 1]) - top) / (1 - top)
            out[r - 1] = d if 0 < d < 1 else out[r - 1]
    return out


class _Model:
    """A bucket's part of the model, from its stored tables and the answers to what it asked."""

    def __init__(self, lex: Lexicon, blob: bytes, answers: list[bytes], d2: np.ndarray, d3: np.ndarray, total: int, spread: dict):
        t = unpack(blob)
        self.lex, self.rare, self.total, self.late = lex, unpack_sorted(t[0]), total, t[9]
        self.cv, self.cu, per, self.w = (_plain(x).astype(np.int64) for x in t[1:5])
        self.c = _counted(t[5])
        self.open = tuple(_plain(x).astype(np.int64) for x in t[6:9])
        top = self.top = np.int64(CODES + 1 + len(self.rare))
        got = [unpack(b) for b in answers]
        n1, n2 = (np.concatenate([_counted(g[i]) for g in got]) for i in range(2))
        self.count = np.concatenate([lex.counts, np.zeros(len(self.rare), np.int64)])
        self.count[_plain(t[10]) + CODES + 1] = n1
        self.p1 = (self.count + 1) / total
        self.ctx = np.repeat(np.arange(len(per)), per)
        # order 2
        has = self.cv[self.ctx] != NONE
        ov, ou, ow = self.open
        pairs = np.concatenate([self.cv[self.ctx][has] * top + self.w[has], ov[ov != NONE] * top + ow[ov != NONE]])
        self.pair, at = np.unique(pairs, return_inverse=True)
        c2 = np.bincount(at[: has.sum()], self.c[has], len(self.pair)).astype(np.int64)
        self.pv, self.pw = self.pair // top, self.pair % top
        if len(n2):
            c2[np.searchsorted(self.pair, _plain(t[12]) * top + lex.ids(unpack_sorted(t[11]), self.rare))] = n2
        self.c2 = c2
        self.middles, of = np.unique(self.pv, return_inverse=True)
        two = _Contexts(of, c2, len(self.middles))
        used, below = np.bincount(of, np.where(c2 > 0, two.mass(c2, d2), 0), len(self.middles)), np.bincount(of, np.where(c2 > 0, self.p1[self.pw], 0), len(self.middles))
        for i in np.flatnonzero(np.append(lex.hot, np.zeros(len(self.rare), bool))[self.middles]):
            two.total[i], used[i], below[i] = spread[int(self.middles[i])]
        self.alpha2 = np.where(two.total > 0, _alpha(used / np.maximum(two.total, 1e-300), below), 1.0)
        self.known = two.total > 0
        self.p2 = np.where(c2 > 0, two.mass(c2, d2) / np.maximum(two.total[of], 1e-300), self.alpha2[of] * self.p1[self.pw])
        # order 3
        self.three = self.cu[self.ctx] != NONE
        c = np.where(self.three, self.c, 0)
        t3 = _Contexts(self.ctx, c, len(per))
        self.p3 = np.where(self.three, t3.mass(self.c, d3) / np.maximum(t3.total[self.ctx], 1e-300), 0)
        lower = np.zeros(len(self.ctx))
        lower[has] = self.p2[at[: has.sum()]]
        self.alpha3 = _alpha(np.bincount(self.ctx, self.p3, len(per)), np.bincount(self.ctx, np.where(self.three, lower, 0), len(per)))

    def values(self) -> np.ndarray:
        """log10 of the probability of each gram that was left open: from unseen trigrams down, as far as needed."""
        v, u, w = self.open
        out = np.log10(self.p1[w])
        two = v != NONE
        if len(self.pair):
            out[two] = np.log10(self.p2[np.searchsorted(self.pair, v[two] * self.top + w[two])])
        key = v * self.top + u
        have = self.cv * self.top + self.cu
        if len(have):
            at = np.minimum(np.searchsorted(have, key), len(have) - 1)
            off = (u != NONE) & (have[at] == key)
            out[off] += np.log10(np.maximum(self.alpha3[at[off]], 1e-300))
        return out

    def sums(self) -> list[tuple]:
        value, rows = self.values(), []
        scarce = self.count[CODES + 1 :]
        for number, doc, times, at, doc1, times1, rare in self.late:
            d, t, t1, r = np.concatenate([doc, doc1]).astype(np.int64), _plain(times), _plain(times1), _plain(rare)
            none, none1, zero = np.zeros(len(t)), np.zeros(len(t1)), np.zeros(len(d))
            real = [np.concatenate([value[_plain(at)] * t, none1]), np.concatenate([none, _logs(scarce[r] + 1) * t1])]
            rows.append(_sums(number, d, real, [np.concatenate([none, (scarce[r] > 0) * t1]), *[zero] * CUT]))
        return rows

    def tables(self) -> pd.DataFrame:
        """(order, u, v, w, n, p): grams; w null: contexts, with p their alpha. A spread word's bigrams come from each of its buckets."""
        name = lambda x: self.lex.names(x, self.rare).astype(np.int64)
        s, real = self.three, self.c2 > 0
        ctx = np.flatnonzero(self.cu != NONE)
        grams = [pd.DataFrame({"order": 3, "u": name(self.cu[self.ctx[s]]), "v": name(self.cv[self.ctx[s]]), "w": name(self.w[s]), "n": self.c[s], "p": self.p3[s]}), pd.DataFrame({"order": 2, "u": None, "v": name(self.pv[real]), "w": name(self.pw[real]), "n": self.c2[real], "p": self.p2[real]})]
        above = [pd.DataFrame({"order": 3, "u": name(self.cu[ctx]), "v": name(self.cv[ctx]), "w": None, "n": None, "p": self.alpha3[ctx]}), pd.DataFrame({"order": 2, "u": None, "v": name(self.middles[self.known]), "w": None, "n": None, "p": self.alpha2[self.known]})]
        return pd.concat([x.astype({"u": "Int64", "w": "Int64", "n": "Int64"}) for x in (*grams, *above)], ignore_index=True)


TABLES = "order int, u long, v long, w long, n long, p double"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _finish(d3: np.ndarray, total: int, tokens: int) -> Callable:
    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        parts = {k: [unpack(b) for b in g] for k, g in rows.groupby("kind")["blob"]}
        _, ids, held, n = parts["docs"][0]
        real, whole = np.zeros((2, len(n))), np.zeros((CUT + 1, len(n)))
        for here, x, y in parts.get("sums", []):
            real[:, here] += np.stack([_real(p) for p in x])
            whole[:, here] += y
        return pd.DataFrame({"doc_id": np.array(ids, np.int64), "held_out": held, "n_tokens": n, "n_known": whole[0].astype(np.int64), "train_tokens": tokens, "base_score": real[1] - n * np.log10(total), "score": real[0] + np.log10(d3) @ whole[1:]})

    return run


def unigrams(docs: DataFrame) -> DataFrame:
    """(w, n): every word of the training documents and the end by hash, with its count, as a stored table."""

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: Counter = Counter()

        def rows() -> pd.DataFrame:
            return pd.DataFrame({"w": np.fromiter(map(_name, found), np.uint64, len(found)).astype(np.int64), "n": np.fromiter(found.values(), np.int64, len(found))})

        ends = 0
        for b in batches:
            for t in b["text"]:
                found.update(words(t))
                ends += 1
            if len(found) > 1 << 18:
                yield rows()
                found.clear()
        yield rows()
        if ends:
            yield pd.DataFrame({"w": [int(END.astype(np.int64))], "n": [ends]})

    counted = docs.where("not held_out").select("text").mapInPandas(look, "w long, n long")
    return stored(counted.groupBy("w").agg(F.sum("n").alias("n")), "unigrams")


def commonest(unigrams: DataFrame, most: int) -> pd.DataFrame:
    """At most `most` of the commonest words (w, n), by falling count; the driver receives about so many rows however large the table is.

    Counts are grouped by their nine leading bits, which makes 15 000 groups at most; groups are taken from the
    top, and of the first that is too large a share by hash. Which words get in decides how they are written,
    never what is counted.
    """
    group = F.expr("shiftleft(shiftright(n, greatest(0, length(bin(n)) - 9)), greatest(0, length(bin(n)) - 9))")
    hist = unigrams.groupBy(group.alias("n")).agg(F.count(F.lit(1)).alias("words")).toPandas().sort_values("n", ascending=False)
    upto = hist["words"].cumsum()
    if (upto > most).any():
        n, words_, above = (int(x[upto > most].iloc[0]) for x in (hist["n"], hist["words"], upto - hist["words"]))
        mine = F.pmod(F.xxhash64("w"), F.lit(1 << 30)) < (most - above) * (1 << 30) // words_
        unigrams = unigrams.where((group > n) | ((group == n) & mine))
    return unigrams.select("w", "n").toPandas().sort_values(["n", "w"], ascending=[False, True]).head(most)


class _Fitted:
    """Stored counts of a corpus and what follows from them for all buckets."""

    def __init__(self, docs: DataFrame, held_out: F.Column):
        docs = docs.select(id_in(), F.coalesce(held_out, F.lit(False)).alias("held_out"), "text")
        spark = docs.sparkSession
        size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
        self.buckets = int(max(6, size // BUCKET))
        merges = 1 << max(0, (self.buckets // 4).bit_length() - 1)
        self.unigrams = unigrams(docs)
        self.tokens, known = self.unigrams.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
        self.total = self.tokens + known + 1
        top = commonest(self.unigrams, CODES)
        h, n = top["w"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.int64)
        often = max(FREQUENT, 1 / self.buckets) * self.tokens
        self.lexicon = spark.sparkContext.broadcast(Lexicon(h, n, h[(n >= often) & (h != END)]))
        blobs = docs.mapInPandas(_chunks(self.buckets, self.lexicon), "bucket int, kind string, blob binary")
        self.parts = stored(blobs.repartition(self.buckets, "bucket").groupBy("bucket").applyInPandas(_count(self.lexicon, merges), PARTS), "katz")
        asks = self.parts.where("kind = 'ask'").select(F.col("key").alias("merge"), "place", "blob")
        self.merged = stored(asks.repartition(merges, "merge").groupBy("merge").applyInPandas(_merge(self.lexicon), PARTS), "katz-merged")
        two = np.zeros(CUT + 1, np.int64)
        tri, table = two.copy(), {}
        for r in self.parts.where("kind = 'stats'").select("blob").toLocalIterator():
            a, b = unpack(bytes(r[0]))
            tri, two = tri + a, two + b
        for r in self.merged.where("kind = 'spread'").select("blob").toLocalIterator():
            mids, rows, n2 = unpack(bytes(r[0]))
            two += n2
            for v, x in zip(mids, rows):
                table[v] = table.get(v, 0) + np.array(x)
        self.d3, self.d2 = good_turing(tri.tolist()), good_turing(two.tolist())
        #: of each spread middle word its total, discounted mass, and P(w) of what is seen after it
        self.spread = {}
        for v, x in table.items():
            low, rest, below = np.arange(1, CUT + 1) * x[:CUT], float(x[CUT]), float(x[CUT + 1])
            c = low.sum() + rest
            self.spread[v] = (c + (RESERVE if c and not low.sum() else 0.0), float(low @ self.d2) + rest, below / self.total)

    def each(self, run: Callable, schema: str) -> DataFrame:
        """run on every bucket's part of the model."""
        lexicon, d2, d3, total, spread = self.lexicon, self.d2, self.d3, self.total, self.spread
        names = [c.split()[0] for c in schema.split(", ")]

        def task(key, rows: pd.DataFrame) -> pd.DataFrame:
            answers = rows[rows["kind"] == "answer"].sort_values("place")["blob"].tolist()
            out = [run(_Model(lexicon.value, b, answers, d2, d3, total, spread)) for b in rows["blob"][rows["kind"] == "late"]]
            release()
            return pd.concat(out, ignore_index=True) if out else pd.DataFrame(columns=names)

        rows = self.parts.where("kind = 'late'").unionAll(self.merged.where("kind = 'answer'")).withColumnRenamed("key", "bucket")
        return rows.repartition(self.buckets, "bucket").groupBy("bucket").applyInPandas(task, schema)


def katz_tables(docs: DataFrame, held_out: F.Column) -> DataFrame:
    """The model as rows (order, u, v, w, n, p), words by hash.

    With w: a gram with its training count and probability given its context (order 1: no context).
    Without w: a context with its back-off weight. Null texts count their end; an empty table: no rows.
    """
    fit = _Fitted(docs, held_out)
    one = fit.unigrams.select(F.lit(1).alias("order"), F.lit(None).cast("long").alias("u"), F.lit(None).cast("long").alias("v"), "w", "n", ((F.col("n") + 1) / F.lit(float(fit.total))).alias("p"))
    return fit.each(lambda m: m.tables(), TABLES).distinct().unionByName(one)


def katz_scores(docs: DataFrame, held_out: F.Column) -> DataFrame:
    """A row per document as SCORES: learn from documents where held_out is not true, score all, whole.

    score is the log10 probability of the text's words and its end, base_score that of the add-one
    unigrams alone. Null text: only the end. A null held_out counts as training; repeated rows count and
    score each time. Without training documents N and V are 0 and every token has probability 1. An empty
    table: no rows.
    """
    fit = _Fitted(docs, held_out)
    more = fit.each(lambda m: pd.DataFrame(m.sums(), columns=COLUMNS)[["kind", "key", "blob"]], "kind string, key long, blob binary")
    mine = fit.parts.where("kind in ('docs', 'sums')").select("kind", "key", "blob").unionAll(more)
    return id_out(mine.groupBy("key").applyInPandas(_finish(fit.d3, fit.total, fit.tokens), SCORES))


def op3(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return katz_scores(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2)

"""Windows of k units that occur again, found by super-k-mers.

Units are bytes or words. Every window of k units has a minimiser: its g-gram with the least hash, the
leftmost of equals. Consecutive windows with one minimiser travel together as one packed string to the
bucket of that minimiser's hash; equal windows have equal minimisers at equal offsets, so a bucket sees
every occurrence of its windows. Repeats of a whole string within a chunk of documents are settled
where they lie and only the first travels. Which strings and windows are equal is for the caller to say:
by an order of suffixes, or by hashes and a comparison. Minimisers that a sample of documents shows to be very
frequent are split: each of their windows travels alone, keyed by its own hash. The sample decides only
where strings travel, never which windows are equal.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import NULL_ID, hot_hashes, join_checked, stored

#: Bytes of text hashed at a time, bytes of text in a chunk, and bytes of packed strings meant for a bucket.
PIECE, CHUNK, BUCKET = 1 << 20, 16 << 20, 6 << 20
#: A text of more bytes is cut into stretches that overlap by a window less one unit.
LONG = 8 << 20
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: A key holds a gram's hash above and its place below.
_AT = np.uint64((1 << 32) - 1)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _B
    return x ^ (x >> np.uint64(29))


def _wider(h: np.ndarray, s: int) -> np.ndarray:
    """Hashes of grams twice as long."""
    if len(h) <= s:
        return h[:0]
    return mixed(h[:-s] * _A + h[s:])


@dataclass
class Windows:
    """What to window: k units, grams of g (a power of two), by word or by byte; whether only other documents count."""

    k: int
    g: int
    words: bool
    other_docs: bool

    def units(self, text: bytes) -> tuple[bytes, np.ndarray, np.ndarray]:
        """The text as compared, where each unit begins and ends in it."""
        if not self.words:
            at = np.arange(len(text))
            return text, at, at + 1
        words = text.split()
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        return b" ".join(words), np.concatenate([[0], ends[:-1] + 1]) if len(words) else ends, ends


def stretches(spec: Windows, text: bytes, size: int) -> Iterator[tuple[int, bytes]]:
    """(unit, stretch): consecutive stretches of about size bytes, each with the units that windows begun in it reach into."""
    if not spec.words:
        for at in range(0, max(len(text) - spec.k + 1, 1), size):
            yield at, text[at : at + size + spec.k - 1]
        return
    at = unit = 0
    while at < len(text):
        end = _word_end(text, at + size)
        own, reach = text[at:end], end
        for _ in range(spec.k - 1):  # k - 1 words more
            while reach < len(text) and text[reach : reach + 1].isspace():
                reach += 1
            reach = _word_end(text, reach)
        yield unit, text[at:reach]
        at, unit = end, unit + len(own.split())


def _word_end(text: bytes, at: int) -> int:
    """The first white space at or after a place."""
    while at < len(text) and not text[at : at + 1].isspace():
        at += 1
    return min(at, len(text))


_BYTE_HASH = mixed(np.arange(1, 257, dtype=np.uint64) * _A)


class Piece:
    """Super-k-mers of a few documents at once. Documents are told apart by their own first unit's position."""

    def __init__(self, spec: Windows, texts: list[bytes]):
        parts = [spec.units(t) for t in texts]
        self.buf = b"".join(p[0] for p in parts)
        base = np.cumsum([0, *(len(p[0]) for p in parts)])
        n = np.array([len(p[1]) for p in parts], np.int64)
        self.first = np.concatenate([[0], np.cumsum(n)])
        if spec.words:
            self.begin = np.concatenate([p[1] + b for p, b in zip(parts, base)] or [np.zeros(0, np.int64)]).astype(np.int64)
            self.end = np.concatenate([p[2] + b for p, b in zip(parts, base)] or [np.zeros(0, np.int64)]).astype(np.int64)
            known: dict[bytes, int] = {}
            words = [w for p in parts for w in p[0].split()]
            ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
            h = np.array([xxhash.xxh3_64_intdigest(w) for w in known], np.uint64)[ids] if words else np.zeros(0, np.uint64)
        else:
            raw = np.frombuffer(self.buf, np.uint8)
            self.begin, self.end = np.arange(len(raw)), np.arange(1, len(raw) + 1)
            h = _BYTE_HASH[raw]
        self._find(spec, h, n)

    def _find(self, spec: Windows, h: np.ndarray, n: np.ndarray) -> None:
        k, g, s = spec.k, spec.g, 1
        while s < g:
            h, s = _wider(h, s), s * 2
        self.gram = h
        wide = h
        while s * 2 <= k:
            wide, s = _wider(wide, s), s * 2
        self.wide, self.span = wide, s
        key = (h & ~_AT) | np.arange(len(h), dtype=np.uint64)
        w, s = k - g + 1, 1
        while s * 2 <= w:
            key, s = np.minimum(key[: max(len(key) - s, 0)], key[s:]), s * 2
        if s < w:
            key = np.minimum(key[: max(len(key) - (w - s), 0)], key[w - s :])
        # windows that lie within one document
        count = np.maximum(n - k + 1, 0)
        at = np.repeat(self.first[:-1] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        doc = np.repeat(np.arange(len(n)), count)
        pos = (key[at] & _AT).astype(np.int64)
        new = np.flatnonzero(np.diff(pos, prepend=-1))
        self.start, self.doc, self.anchor = at[new], doc[new], pos[new]
        self.windows = np.diff(np.append(new, len(at)))
        self.hash = mixed(self.gram[self.anchor] + np.uint64(1))
        self.length = self.windows + k - 1

    def digest(self, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """A hash of each run of units, from grams that cover it."""
        last = start + length - self.span
        return mixed(mixed(self.wide[start] * _A + self.wide[(start + last) // 2]) * _A + self.wide[last] + length.astype(np.uint64))

    def split(self, spec: Windows, hot: np.ndarray) -> None:
        """Strings of the hashes in hot become single windows under their own hash."""
        if not len(hot) or not len(self.hash):
            return
        at = np.minimum(np.searchsorted(hot, self.hash), len(hot) - 1)
        is_hot = hot[at] == self.hash
        if not is_hot.any():
            return
        n = self.windows[is_hot]
        start = np.repeat(self.start[is_hot] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        length = np.full(len(start), spec.k)
        join = lambda name, more: setattr(self, name, np.concatenate([getattr(self, name)[~is_hot], more]))
        join("doc", np.repeat(self.doc[is_hot], n))
        join("anchor", start)
        join("hash", mixed(self.digest(start, length) + np.uint64(7)))
        join("windows", np.ones(len(start), np.int64))
        join("length", length)
        join("start", start)

    def seal(self, spec: Windows) -> None:
        """Keep what describes the strings; drop what is as large as the text several times over."""
        self.digests = self.digest(self.start, self.length) ^ self.hash
        self.lo, self.hi = self.begin[self.start], self.end[self.start + self.length - 1]
        self.rel, self.offset = self.start - self.first[self.doc], self.anchor - self.start
        self.gram = self.wide = self.begin = self.end = self.start = self.anchor = None


def frequent(docs: DataFrame, spec: Windows, rows: int) -> np.ndarray:
    """Hashes of minimisers that many documents have."""

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lo in range(0, len(b), 50):
                p = Piece(spec, [(t or "").encode("utf-8", "replace") for t in b["text"].iloc[lo : lo + 50]])
                each = np.unique(np.stack([p.doc.astype(np.uint64), p.hash]), axis=1)[1] if len(p.hash) else p.hash
                yield pd.DataFrame({"h": each.astype(np.int64)})

    return hot_hashes(docs, rows, look, 17)


def pack(x) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(pickle.dumps(x, protocol=5))


def unpack(b: bytes):
    return pickle.loads(zstandard.ZstdDecompressor().decompress(b))


def _first_by(keys: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Order by the keys (the most important first), and where the first key changes in it."""
    order = np.lexsort(keys[::-1])
    k = keys[0][order]
    return order, np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.zeros(0, np.int64)


#: classes(cut, size, hash, offset): a number per string, the same for equal strings; cut(i) gives the bytes of strings, joined.
Classes = Callable[[Callable[[np.ndarray], bytes], np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def scatter(spec: Windows, hot: np.ndarray, buckets: int, classes: Classes | None = None) -> Callable:
    """The map side: rows of (_id, _t, text) to (bucket, blob)."""

    def flush(ids: list[int], marks: list[int], pieces: list[tuple[Piece, int]]) -> Iterator[pd.DataFrame]:
        ids_, marks_ = np.array(ids, np.int64), np.array(marks, np.int64)
        piece = np.concatenate([np.full(len(p.hash), i) for i, (p, _) in enumerate(pieces)])
        doc = np.concatenate([p.doc + base for p, base in pieces])
        rel, length, h, offset, digest, lo, hi = (np.concatenate([getattr(p, name) for p, _ in pieces]) for name in ("rel", "length", "hash", "offset", "digests", "lo", "hi"))
        if not len(h):
            return
        bufs = [p.buf for p, _ in pieces]
        # whole repeats within the chunk: the first stands for the others if the bytes agree
        cut = lambda i: b"".join([bufs[p][x:y] for p, x, y in zip(piece[i].tolist(), lo[i].tolist(), hi[i].tolist())])
        equal = digest if classes is None else classes(cut, hi - lo, h, offset)
        order, heads = _first_by((equal, ids_[doc], rel))
        group = np.zeros(len(order), np.int64)
        group[heads] = 1
        head = order[heads[np.cumsum(group) - 1]]
        i, j = order, head
        later = (ids_[doc[i]] > ids_[doc[j]]) if spec.other_docs else (ids_[doc[i]] > ids_[doc[j]]) | ((ids_[doc[i]] == ids_[doc[j]]) & (rel[i] > rel[j]))
        same = later if classes is not None else np.zeros(len(i), bool)
        for x in np.flatnonzero(later) if classes is None else ():
            a, b = i[x], j[x]
            same[x] = bufs[piece[a]][lo[a] : hi[a]] == bufs[piece[b]][lo[b] : hi[b]]
        done, travel = np.sort(i[same]), np.sort(i[~same])
        to = (h % np.uint64(buckets)).astype(np.int64)
        by_t, by_d = travel[np.argsort(to[travel], kind="stable")], done[np.argsort(to[done], kind="stable")]
        edges = np.arange(buckets + 1)
        at_t, at_d = np.searchsorted(to[by_t], edges), np.searchsorted(to[by_d], edges)
        out_b, out = [], []
        for b in range(buckets):
            t, d = by_t[at_t[b] : at_t[b + 1]], by_d[at_d[b] : at_d[b + 1]]
            if not len(t) and not len(d):
                continue
            used, inv = np.unique(doc[np.concatenate([t, d])], return_inverse=True)
            data = cut(t)
            out_b.append(b)
            out.append(pack((ids_[used], marks_[used].astype(np.int32), inv[: len(t)].astype(np.int32), (h[t] // np.uint64(buckets)).astype(np.uint32), rel[t].astype(np.int32), length[t].astype(np.int16), offset[t].astype(np.int16), (hi - lo)[t].astype(np.int32) if spec.words else None, data, inv[len(t) :].astype(np.int32), rel[d].astype(np.int32), length[d].astype(np.int16))))
            if len(out) == 64:
                yield pd.DataFrame({"bucket": out_b, "blob": out})
                out_b, out = [], []
        if out:
            yield pd.DataFrame({"bucket": out_b, "blob": out})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, marks, pieces, size = [], [], [], 0
        texts, held, base = [], 0, 0

        def piece() -> None:
            nonlocal texts, held, base
            if texts:
                p = Piece(spec, texts)
                p.split(spec, hot)
                p.seal(spec)
                pieces.append((p, base))
            base, texts, held = len(ids), [], 0

        for b in batches:
            for i, m, t in zip(b["_id"].tolist(), b["_t"].tolist(), b["text"]):
                raw = (t or "").encode("utf-8", "replace")
                if len(raw) > LONG:
                    piece()
                    for unit, part in stretches(spec, raw, LONG // 4):
                        if size >= CHUNK // (1 if spec.words else 2):
                            yield from flush(ids, marks, pieces)
                            ids, marks, pieces, size = [], [], [], 0
                        ids.append(i)
                        marks.append(m)
                        p = Piece(spec, [part])
                        p.split(spec, hot)
                        p.seal(spec)
                        p.rel += unit
                        pieces.append((p, len(ids) - 1))
                        size += len(part)
                    base = len(ids)
                    continue
                if held and held + len(raw) > PIECE:
                    piece()
                    if size >= CHUNK // (1 if spec.words else 2):
                        yield from flush(ids, marks, pieces)
                        ids, marks, pieces, size, base = [], [], [], 0, 0
                ids.append(i)
                marks.append(m)
                texts.append(raw)
                held, size = held + len(raw), size + len(raw)
        piece()
        if pieces:
            yield from flush(ids, marks, pieces)

    return run


@dataclass
class Strings:
    """A bucket's strings, each with 32 bits of its minimiser's hash, its offset and its place; text holds them back to back."""

    doc: np.ndarray
    hash: np.ndarray
    rel: np.ndarray
    length: np.ndarray
    offset: np.ndarray
    size: np.ndarray
    lo: np.ndarray
    text: bytes
    ids: np.ndarray


def _settle(spec: Windows, s: Strings, resolve: Callable, classes: Classes | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows to remove: (string, first window, number of windows)."""
    none = (np.zeros(0, np.int64),) * 3
    order, heads = _first_by((s.hash,))
    n = np.diff(np.append(heads, len(order)))
    keep = order[np.repeat(n, n) > 1]
    if not len(keep):
        return none
    cut = lambda i: [s.text[a:b] for a, b in zip(s.lo[keep[i]].tolist(), (s.lo[keep[i]] + s.size[keep[i]]).tolist())]
    if classes is not None:
        name = classes(lambda i: b"".join(cut(i)), s.size[keep], s.hash[keep], s.offset[keep])
    else:
        known: dict[tuple, int] = {}
        name = np.fromiter((known.setdefault((h, t), len(known)) for h, t in zip(s.hash[keep].tolist(), cut(slice(None)))), np.int64, len(keep))
    # equal whole strings: the first by document and place stands for them
    o, heads = _first_by((name, s.ids[s.doc[keep]], s.rel[keep]))
    rep = keep[o[heads]]
    of = rep[np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(o))))]
    i = keep[o]
    later = s.ids[s.doc[i]] > s.ids[s.doc[of]]
    if not spec.other_docs:
        later |= (s.ids[s.doc[i]] == s.ids[s.doc[of]]) & (s.rel[i] > s.rel[of])
    whole = i[later]
    # those that stand, where a minimiser has several different strings, and rows that tie with them
    oh, heads = _first_by((s.hash[rep],))
    n = np.diff(np.append(heads, len(oh)))
    cand = rep[oh[np.repeat(n, n) > 1]]
    at, first, count = resolve(spec, s, cand) if len(cand) else none
    tied = ~later & (i != of)
    if tied.any() and len(at):  # a row repeated under one id fares as the row it repeats
        o = np.argsort(at, kind="stable")
        lo, hi = np.searchsorted(at[o], of[tied]), np.searchsorted(at[o], of[tied], side="right")
        n = hi - lo
        run = o[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        at, first, count = np.concatenate([at, np.repeat(i[tied], n)]), np.concatenate([first, first[run]]), np.concatenate([count, count[run]])
    return np.concatenate([whole, at]), np.concatenate([np.zeros(len(whole), np.int64), first]), np.concatenate([s.length[whole] - spec.k + 1, count])


def runs_of(item_string: np.ndarray, item_window: np.ndarray, gone: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows marked gone, as runs of neighbours in one string."""
    s, w = item_string[gone], item_window[gone]
    o = np.lexsort((w, s))
    s, w = s[o], w[o]
    new = np.flatnonzero(np.append(True, (s[1:] != s[:-1]) | (w[1:] != w[:-1] + 1))) if len(s) else np.zeros(0, np.int64)
    return s[new], w[new], np.diff(np.append(new, len(s)))


def bucket_of(spec: Windows, resolve: Callable, doc_buckets: int, classes: Classes | None = None) -> Callable:
    """The reduce side: a bucket's blobs to (doc_bucket, blob of spans in units)."""

    def run(key, blobs: pd.DataFrame) -> pd.DataFrame:
        got = [unpack(b) for b in blobs["blob"]]
        base = np.cumsum([0, *(len(g[0]) for g in got)])
        cat = lambda i, kind=np.int64: np.concatenate([g[i] for g in got]).astype(kind)
        ids, marks = cat(0), cat(1)
        doc = np.concatenate([g[2] + b for g, b in zip(got, base)]).astype(np.int64)
        size = cat(7) if spec.words else cat(5)
        s = Strings(doc, cat(3, np.uint64), cat(4), cat(5), cat(6), size, np.cumsum(size) - size, b"".join(g[8] for g in got), ids)
        done = np.concatenate([g[9] + b for g, b in zip(got, base)]).astype(np.int64)
        done_rel, done_len = cat(10), cat(11)
        del got
        at, first, count = _settle(spec, s, resolve, classes) if len(doc) else (np.zeros(0, np.int64),) * 3
        d = np.concatenate([done, doc[at]])
        begin = np.concatenate([done_rel, s.rel[at] + first])
        end = np.concatenate([done_rel + done_len, s.rel[at] + first + count + spec.k - 1])
        to = (mixed(ids[d].astype(np.uint64)) % np.uint64(doc_buckets)).astype(np.int64)
        order, heads = _first_by((to, d, begin))
        rows = []
        for x, y in zip(heads, np.append(heads[1:], len(order))):
            o = order[x:y]
            rows.append((int(to[o[0]]), pack((ids[d[o]], marks[d[o]].astype(np.int32), begin[o].astype(np.int32), end[o].astype(np.int32)))))
        return pd.DataFrame(rows, columns=["doc_bucket", "blob"]).astype({"doc_bucket": "int32"})

    return run


def merged(key, blobs: pd.DataFrame) -> pd.DataFrame:
    """Each document's spans, overlapping and adjoining ones as one: (_id, _t, span_from, span_to), 32-bit numbers packed."""
    got = [unpack(b) for b in blobs["blob"]]
    ids, marks, begin, end = (np.concatenate([g[i] for g in got]).astype(np.int64) for i in range(4))
    o = np.lexsort((begin, marks, ids))
    ids, marks, begin, end = ids[o], marks[o], begin[o], end[o]
    new_doc = np.append(True, (ids[1:] != ids[:-1]) | (marks[1:] != marks[:-1]))
    g = np.cumsum(new_doc) - 1
    wide = np.int64(1) << 32
    reach = np.maximum.accumulate(end + g * wide) - g * wide
    new = np.append(True, new_doc[1:] | (begin[1:] > reach[:-1]))
    at = np.flatnonzero(new)
    a, b, owner = begin[at].astype(np.int32), reach[np.append(at[1:], len(o)) - 1].astype(np.int32), g[at]
    first = np.flatnonzero(new_doc)
    cut = np.searchsorted(owner, np.arange(len(first) + 1))
    return pd.DataFrame({"_id": ids[first], "_t": marks[first], "span_from": [a[x:y].tobytes() for x, y in zip(cut, cut[1:])], "span_to": [b[x:y].tobytes() for x, y in zip(cut, cut[1:])]})


SPANS = "_id long, _t long, span_from binary, span_to binary"


def keys() -> list:
    """A row's id and 31 bits of its text's hash."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("_id"), (F.xxhash64("text").bitwiseAND(F.lit(0x7FFFFFFF))).alias("_t")]


def find_spans(docs: DataFrame, spec: Windows, resolve: Callable, classes: Classes | None = None) -> DataFrame:
    """The units to remove of each document that loses any, as a stored table."""
    rows, size = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    mean_windows = (spec.k - spec.g + 2) / 2
    swell = (spec.k + mean_windows - 1) / mean_windows
    buckets = int(max(16, size * swell // BUCKET))
    doc_buckets = max(8, buckets // 8)
    hot = frequent(docs, spec, rows)
    packed = docs.select(*keys(), "text").mapInPandas(scatter(spec, hot, buckets, classes), "bucket int, blob binary")
    # a task for each bucket, so that tasks stay as large as buckets however many there are
    found = packed.repartition(buckets, "bucket").groupBy("bucket").applyInPandas(bucket_of(spec, resolve, doc_buckets, classes), "doc_bucket int, blob binary")
    return stored(found.groupBy("doc_bucket").applyInPandas(merged, SPANS), "spans")


def with_spans(docs: DataFrame, spans: DataFrame, run: Callable, schema: str) -> DataFrame:
    """Apply run to batches of docs' columns with span_from and span_to (null: none)."""
    joined = join_checked(docs.select("*", *keys()), spans, ["_id", "_t"], "left").drop("_id", "_t")
    return joined.mapInPandas(run, schema)

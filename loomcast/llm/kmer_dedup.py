"""Substring dedup of word windows by super-k-mers.

Consecutive windows that share a minimiser travel as one packed string to its bucket (see
_superkmers). There the windows of different strings are sorted, equal neighbours are verified on
their words, and each run of equal windows is counted exactly and knows its smallest document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame

from ._common import id_in, id_out
from ._superkmers import Strings, Windows, _first_by, find_spans, mixed, runs_of, with_spans

WORDS = Windows(k=50, g=8, words=True, other_docs=True)


def resolve(spec: Windows, s: Strings, cand: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of the candidates that also start in a smaller document, as runs."""
    n = s.length[cand] - spec.k + 1
    string = np.repeat(cand, n)
    window = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    texts, lo, hi = [], [], []
    for c in cand.tolist():
        t = s.text[s.lo[c] : s.lo[c] + s.size[c]]
        gaps = np.flatnonzero(np.frombuffer(t, np.uint8) == 32)
        begin, end = np.append(0, gaps + 1), np.append(gaps, len(t))
        m = s.length[c] - spec.k + 1
        texts += [t] * m
        lo.append(begin[:m])
        hi.append(end[spec.k - 1 :])
    lo, hi = np.concatenate(lo).tolist(), np.concatenate(hi).tolist()
    key = mixed(s.hash[string] + (s.offset[string] - window).astype(np.uint64))
    named = np.fromiter((xxhash.xxh3_64_intdigest(t[a:b]) for t, a, b in zip(texts, lo, hi)), np.uint64, len(lo))
    order, _ = _first_by((key, named))
    k, h = key[order], named[order]
    near = np.append(False, (k[1:] == k[:-1]) & (h[1:] == h[:-1]))
    words = lambda x: texts[x][lo[x] : hi[x]]
    same = near.copy()
    for x in np.flatnonzero(near):
        same[x] = words(order[x]) == words(order[x - 1])
    if (near & ~same).any():  # two texts of one hash: sorted by the words themselves
        order = np.array(sorted(range(len(key)), key=lambda x: (key[x], words(x))), np.int64)
        k = key[order]
        same = np.append(False, [k[x] == k[x - 1] and words(order[x]) == words(order[x - 1]) for x in range(1, len(order))])
    ids = s.ids[s.doc[string[order]]]
    heads = np.flatnonzero(~same)
    least = np.minimum.reduceat(ids, heads)[np.cumsum(~same) - 1]
    return runs_of(string[order], window[order], ids > least)


def _cut(words: list[bytes], a: bytes | None, b: bytes | None) -> tuple[list[bytes], int]:
    if a is None:
        return words, 0
    a, b = np.frombuffer(a, np.int32), np.frombuffer(b, np.int32)
    kept, at = [], 0
    for x, y in zip(a.tolist(), b.tolist()):
        kept += words[at:x]
        at = y
    return kept + words[at:], int((b - a).sum())


def kmer_dedup(docs: DataFrame, spec: Windows = WORDS, texts: bool = True) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept (the words that stay, joined by one space; only if texts) and kept_sha256.

    A word goes if a window of spec.k words that covers it also starts in a document with a smaller
    doc_id. Null text: no words. A null doc_id is smaller than all others. Rows that repeat a doc_id are
    one document: they never remove each other's words. Texts of fewer than k words lose none. An empty
    table: no rows. Other columns are ignored.
    """
    docs = docs.select(id_in(), "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lo in range(0, len(b), 500):
                part, rows = b.iloc[lo : lo + 500], []
                for t, x, y in zip(part["text"], part["span_from"], part["span_to"]):
                    words = (t or "").encode("utf-8", "replace").split()
                    left, gone = _cut(words, x, y)
                    kept = b" ".join(left)
                    rows.append((len(words), gone, hashlib.sha256(kept).hexdigest(), *([kept.decode("utf-8", "replace")] if texts else [])))
                yield pd.DataFrame(rows, columns=["n_words", "n_removed", "kept_sha256", *(["kept"] if texts else [])]).assign(doc_id=part["doc_id"].to_numpy())

    return id_out(with_spans(docs, find_spans(docs, spec, resolve), run, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * texts))


def op9(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return kmer_dedup(docs, texts=False)

"""Benchmark decontamination by pigeonhole edit matching.

A test item of m characters may be met with up to k = floor(rate * m) edits. Cut into k + 1 pieces, at
least one piece of any such match is untouched; an automaton finds all exact hits of all pieces in one
pass over a text, and Myers' bit-parallel distance verifies the neighbourhood of each hit.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import id_in, id_out, join_checked, stored, unpacked, whole

#: Characters of items that go out to the executors at a time: more items take more passes.
WAVE = 4 << 20
FOUND = "doc_id long, item_id long, distance int, match_from int, match_to int"


def normal(text: str | None) -> str:
    """Lower case, runs of white space as one space."""
    return " ".join((text or "").lower().split())


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """k + 1 pieces of about equal length with their offsets; none is empty when len(item) > k."""
    cuts = [len(item) * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:]) if b > a]


class Pattern:
    """An item as bit masks by character."""

    def __init__(self, text: str):
        self.m, self.peq = len(text), {}
        for i, c in enumerate(text):
            self.peq[c] = self.peq.get(c, 0) | 1 << i

    def scan(self, text: str, anchored: bool = False) -> Iterator[int]:
        """Myers: the distance of the item from the best stretch of text that ends at each place in turn.

        anchored: the stretch begins where text begins.
        """
        full, top = (1 << self.m) - 1, 1 << (self.m - 1)
        pv, mv, score, carry = full, 0, self.m, int(anchored)
        for c in text:
            eq = self.peq.get(c, 0)
            xv = eq | mv
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph, mh = (mv | ~(xh | pv)) & full, pv & xh
            score += bool(ph & top) - bool(mh & top)
            ph = (ph << 1 | carry) & full
            pv, mv = ((mh << 1) & full) | (~(xv | ph) & full), ph & xv
            yield score


class Matcher:
    """All items of a wave: one automaton of their pieces."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        self.items = [(i, t, int(len(t) * rate)) for i, t in items]
        self.patterns = [(Pattern(t), Pattern(t[::-1])) for _, t in items]
        self.hits = ahocorasick.Automaton()
        where: dict[str, list] = {}
        for n, (_, t, k) in enumerate(self.items):
            for at, piece in pieces(t, k):
                where.setdefault(piece, []).append((n, at))
        for piece, at in where.items():
            self.hits.add_word(piece, (len(piece), at))
        if where:
            self.hits.make_automaton()

    def match(self, text: str) -> list[tuple]:
        """(item_id, distance, from, to) of each item's best match within its budget; of equals the first to end."""
        near: dict[int, set] = {}
        if not text or not len(self.hits):
            return []
        for end, (length, owners) in self.hits.iter(text):
            for n, at in owners:
                _, t, k = self.items[n]
                start = end - length + 1 - at
                lo, hi = max(0, start - k), start + len(t) + k
                near.setdefault(n, set()).add((lo, hi))
        out = []
        for n, found in near.items():
            spans: list[list[int]] = []
            for lo, hi in sorted(found):  # every place is scanned once
                if spans and lo <= spans[-1][1]:
                    spans[-1][1] = max(hi, spans[-1][1])
                else:
                    spans.append([lo, hi])
            item, t, k = self.items[n]
            best = None
            for lo, hi in spans:
                for i, d in enumerate(self.patterns[n][0].scan(text[lo:hi])):
                    if d <= k and (best is None or (d, lo + i) < best):
                        best = (d, lo + i)
            if best:
                d, last = best
                back = text[max(0, last - len(t) - k) : last + 1][::-1]
                length = next(i + 1 for i, x in enumerate(self.patterns[n][1].scan(back, anchored=True)) if x == d) if d < len(t) else 0
                out.append((item, d, last + 1 - length, last + 1))
        return out


def find_leaks(docs: DataFrame, items: DataFrame, rate: float = 0.08) -> DataFrame:
    """(doc_id, item_id, distance, match_from, match_to): each document's best match of each item within its budget.

    Texts are compared in lower case with white space as single spaces; places are in that form. Null or
    blank items match nothing, null or blank texts hold nothing. An item that repeats under one id, in
    whatever spelling of case and white space, counts once, one text under two ids twice. Repeated documents are each answered. Items go out in waves of at
    most WAVE characters (an item longer than that alone), so what executors hold is bounded; documents
    are read once per wave.
    """
    spark = docs.sparkSession
    docs = docs.select(id_in(), "text")

    def wave(batch: list[tuple[int, str]]) -> DataFrame:
        sent = spark.sparkContext.broadcast(batch)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            matcher = Matcher(sent.value, rate)
            for b in batches:
                rows = [(i, *m) for i, t in zip(b["doc_id"], b["text"]) for m in matcher.match(normal(t))]
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "distance", "match_from", "match_to"]).astype({"item_id": "Int64"})

        return docs.mapInPandas(run, FOUND)

    found, batch, size, same, forms = None, [], 0, (), set()
    for row in items.select(F.col("item_id").cast("long"), "text").where("text is not null").distinct().orderBy("item_id", "text").toLocalIterator():
        text = normal(row["text"])
        if same != (row["item_id"],):
            same, forms = (row["item_id"],), set()
        if not text or text in forms:
            continue
        forms.add(text)
        if batch and size + len(text) > WAVE:
            found = wave(batch) if found is None else found.unionAll(wave(batch))
            batch, size = [], 0
        batch.append((row["item_id"], text))
        size += len(text)
    last = wave(batch) if batch or found is None else None
    return id_out(last if found is None else found if last is None else found.unionAll(last))


def decontaminate(docs: DataFrame, items: DataFrame, rate: float = 0.08) -> DataFrame:
    """The documents in which no item is found. Rows with a null doc_id are told apart by their text's hash."""
    key = F.xxhash64("doc_id", "text").alias("_key")
    keyed = whole(docs, key)
    leaks = find_leaks(docs.select(key.alias("doc_id"), "text"), items, rate).select(F.col("doc_id").alias("_key")).distinct()
    return join_checked(keyed, stored(leaks, "leaks"), ["_key"], "left_anti").select(*unpacked(docs.columns))


def op2(spark, sf_dir: str) -> DataFrame:
    return find_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))

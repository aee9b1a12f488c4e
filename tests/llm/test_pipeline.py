"""The pipeline keeps what each stage keeps, on the smallest tables."""

import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loomcast.llm import decontaminate, jaccard_join

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")
def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, seen = docs.columns, []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, FOLDER)
        out.write.parquet(str(tmp_path / str(i)))
        before, docs = docs, spark.read.parquet(str(tmp_path / str(i)))
        assert docs.columns == columns
        seen.append((before, docs))
    ids = lambda df: Counter(r.doc_id for r in df.select("doc_id").collect())
    good, lines, near, clean, mixed = (b for _, b in seen)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    kept = ids(good)
    right = [(i in kept) == bool(q) for i, q in labels.items()]
    assert sum(right) / len(right) > 0.95
    assert ids(lines) == kept
    rows = lines.select("doc_id", "text").collect()
    sets = {r.doc_id: set(jaccard_join.shingles(r.text).tolist()) for r in rows}
    stay, gone = set(ids(near)), set(kept) - set(ids(near))
    alike = lambda a, b: a and len(a & b) * 5 >= 4 * len(a | b)
    assert not any(alike(sets[a], sets[b]) for a in stay for b in stay if a < b)
    assert all(any(alike(sets[g], sets[o]) for o in sets if o != g) for g in gone)
    items = [decontaminate.normal(r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    texts = {r.doc_id: decontaminate.normal(r.text) for r in near.select("doc_id", "text").collect()}
    assert not any(t and t in texts[i] for i in ids(clean) for t in items)
    assert max(ids(mixed).values()) <= 3 and set(ids(mixed)) <= set(ids(clean))
    assert corpus_pipeline.run(spark, FOLDER).count() == mixed.count()
    assert mixed.where(F.col("text").isNull()).count() == 0

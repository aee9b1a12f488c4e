"""The corpus pipeline: each stage works on all that its predecessor kept.

Stages return the columns of their input with the input's values (line dedup: with reduced text),
whatever these columns are called. An empty table passes every stage as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomcast.llm import decontaminate, jaccard_join, line_dedup, mix_sources, quality_gam
from loomcast.llm._common import stored, unpacked, whole


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go. A null text is judged as an empty one; repeated rows fare alike."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    model = quality_gam.train(docs, labels, held_out=quality_gam.fold(3) == 1)
    return quality_gam.classify(whole(docs, "text"), model).where("predicted = 1").select(*unpacked(docs.columns))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that three documents or more hold stay in the last of them alone. A null text becomes an empty one; a null doc_id is one document, before all others."""
    return line_dedup.reduced(docs)


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that near-copies connect the one with the least doc_id stays, null before all others; rows that repeat it stay with it, documents without words all stay."""
    return jaccard_join.keep_one(docs)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, edited or not, go. Null and blank texts and items match nothing."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it. A null source is a source of its own, a null or empty text has size 0; repeated rows are taken alike."""
    return mix_sources.emitted(docs)


STAGES = [("quality classifier", keep_good), ("line dedup", drop_lines), ("n-gram Jaccard join", keep_one), ("benchmark decontamination", no_benchmark), ("mixing sources", mix)]
#: SQL cannot learn the classifier.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, f"stage-{i}")
    return docs

"""From raw documents to packed training sequences, in five stages.

    run(spark, sf_dir)    the pieces that the last stage packs

Each stage reads what the one before it kept, as Parquet in the shared folder that
``spark.checkpoint.dir`` names; a lost executor costs the tasks it ran, not a stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.llm import packing, stages
from quire.session import drop_scratch, scratch_dir


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", "toxic")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal quality classifier does not reject."""
    return stages.good_quality(docs, _labels(spark, sf_dir))


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return stages.one_of_each(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that an earlier document has."""
    return stages.without_repeats(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target weight takes them."""
    return stages.mixed(docs, _labels(spark, sf_dir))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 1024 tokens."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("MinHash near-dedup", minhash_near_dedup),
    ("substring dedup", substring_dedup),
    ("mixing sources to target weights", mixing),
    ("packing", packing_stage),
]

#: The fit, the sampling and the tokeniser have no SQL form; tests/llm compares each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for n, (_, stage) in enumerate(STAGES):
        out = scratch_dir(spark, f"pipeline-{n}")
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
        if before:                                # what the stage has read is not needed any more
            drop_scratch(spark, before)
        before = out
    return docs

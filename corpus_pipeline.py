"""A training-data pipeline of five stages over ``documents``: quality, near-dedup, passages, mix, packing.

Each stage takes the whole output of the one before it, as a written table, and returns a DataFrame. All but the last
keep the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from framescore.llm import hostrules, minhash, mixing, packing, passages
from framescore.llm.scratch import Scratch, release
from framescore.session import new_shared_path, ship_package


def _begin(spark: SparkSession, tag: str) -> Scratch:
    """Scratch tables for a stage. Those of earlier stages, whose results are written by now, are deleted."""
    ship_package(spark)
    release(spark)
    return Scratch(spark, tag)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return hostrules.keep(docs, _begin(spark, "quality"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    return minhash.keep_one(docs, _begin(spark, "near-dedup"))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that an earlier document holds."""
    scratch = _begin(spark, "substring-dedup")
    found = scratch.write(passages.passages(docs, scratch), "passages")
    return passages.cut_passages(docs, found)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated, or taken in part, to the sources' target weights."""
    scratch = _begin(spark, "mix")
    rows = scratch.write(mixing.sized(docs), "sizes")
    targets = scratch.write(mixing.source_targets(rows), "targets")
    return mixing.materialise(docs, scratch.write(mixing.take(rows, targets), "taken"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences: one row per piece of a document, with its place and its token ids."""
    _begin(spark, "pack")
    return packing.pack(packing.cut_pieces(docs, with_ids=True))


STAGES = [("quality_rules", quality), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("source_mix", mix), ("packing", pack)]

# Near-duplicate search, chaining and tokens are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result but the last is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = new_shared_path(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

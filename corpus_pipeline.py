"""A corpus pipeline out of the training-data operators (part of the subpackage ``llm``).

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and read again as the next stage's ``docs``.
All stages but the last return the columns of ``documents``, whatever other columns there are, under their names and unchanged.

Defined cases, for every stage: no rows give no rows; null columns are allowed; very long texts are taken whole; repeated rows are
judged like any others.  What a null or empty text means is stated at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexloom.llm import decontaminate, mixing, ngram_join, quality_model, token_shards
from lexloom.llm.shared import Workspace


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject; a null or empty text gets the score of a text without words."""
    return quality_model.keep_good(docs, quality_model.fit(docs, _table(spark, sf_dir, "labels")))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, repeated rows included; every document without words stays."""
    return ngram_join.drop_near_duplicates(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage; null and empty texts hold none."""
    return decontaminate.drop_contaminated(docs, _table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that all sources weigh the same, in a shuffled order; a null source is one of its own, a source without characters goes."""
    return mixing.mix_sources(docs, mixing.source_rates(docs)).select(*docs.columns)


def token_index(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shards' index: the place, documents and checksum of every sequence; a null or empty text is its end mark only."""
    return token_shards.shard_index(docs)


STAGES = [("quality", good_quality), ("near_duplicates", without_near_duplicates), ("decontamination", without_benchmark), ("mixing", mixed), ("token_shards", token_index)]

#: The classifier, the pruning and the permutation have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, work = _table(spark, sf_dir, "documents"), Workspace(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = work.table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

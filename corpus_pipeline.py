"""A training corpus in five stages: each works on all that the one before it wrote.

documents -> quality rules -> one document of each near-duplicate class -> no benchmark leaks -> sources mixed to
their targets (a document stands as often as it is taken) -> shard and slot of every row. All stages but the last
return the columns of documents. The mix solves a convex problem by Newton steps, which SQL cannot express, so there
is no statement to compare with; the tests compare the first three stages with brute-force versions,
the mix with its targets, and check that sharding keeps every row once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from edgetide.llm import bin_packing, entropy_mix, prob_minhash, quality_rules, template_leaks
from edgetide.llm.common import Scratch, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return prob_minhash.first_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return template_leaks.clean(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return entropy_mix.mixed(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bin_packing.shards_of(docs)


STAGES = [
    ("quality_rules", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs = Scratch(spark), table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return docs

"""From raw documents to sampled token sequences, stage by stage.

Each stage takes the documents its predecessor kept, reads what else it needs from
`sf_dir`, and returns documents with the same columns; the last one returns the
samples. Stages meet as Parquet tables in the session's shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fleetlens.llm import langid, mixing, quality_rules, sampling, simhash
from fleetlens.llm.text import table
from fleetlens.session import settle


def quality_rule_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.filter_documents(docs, table(spark, sf_dir, "labels"))


def language_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.filter_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.deduplicate(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(docs)


def segmentations(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sampling.sample_segmentations(docs)


STAGES = [
    ("quality_rules", quality_rule_filter),
    ("language_id", language_filter),
    ("simhash_dedup", near_duplicates),
    ("source_mix", source_mix),
    ("segmentations", segmentations),
]
#: Hashes, fitted models and sampled paths have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

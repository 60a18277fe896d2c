"""A training corpus from raw documents: five stages, each on all that the stage before it kept.

Toxic documents go, then those whose language can't be told; one document of each group of near copies stays; passages
of the benchmark are cut out; and sources are mixed to target weights. Each stage's result is written as Parquet in the
session's shared folder and reread, so that a lost executor repeats one stage's tasks at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from colloquy.llm import decontaminate, language, mixing, near_copies, toxicity
from colloquy.llm.common import read_table, written


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scoring below the threshold. Labels of the held-out third are left out here too."""
    labels = read_table(spark, sf_dir, "labels")
    return toxicity.without_toxic(docs, toxicity.learn(docs, labels.where(~toxicity.held_out())))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that can be told: not null, with letters, and one language likelier than all others."""
    return language.with_language(docs, language.learn(docs))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest doc_id of each group of texts whose five-word shingles have a similarity of 0.8 or more."""
    return near_copies.deduplicated(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words inside benchmark windows."""
    return decontaminate.decontaminated(docs, read_table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per repetition that the mix takes: the documents' columns, copy and n_words."""
    return mixing.mixture(docs)


STAGES = [("toxicity", toxicity_stage), ("language", language_stage), ("near_duplicates", near_duplicate_stage), ("decontamination", decontamination_stage), ("mixing", mixing_stage)]

#: The learned stages are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

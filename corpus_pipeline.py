"""Corpus pipeline: five stages that clean and mix the documents table.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage
before it kept; all but the last return the columns of documents. ``run`` writes
each stage's result as Parquet in the shared folder and reads it again.
"""

from __future__ import annotations

from gridpulse.llm import decontam, mixing, pii, simhash, toxicity
from gridpulse.llm.common import table, written
from gridpulse.llm.queries import PII_KEY, toxicity_model
from pyspark.sql import DataFrame, SparkSession


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go. Null and empty texts have the bias of the model."""
    return toxicity.without_toxic(docs, toxicity_model(docs, table(spark, sf_dir, "labels")), threshold=0.5)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays, that of the smallest id; texts of one id are told apart."""
    return simhash.one_of_each(docs, shingle=3, distance=3)


def contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window of ten words (or a shorter item) go. Empty texts stay."""
    return decontam.without_matches(docs, table(spark, sf_dir, "benchmark"), window=10)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; personal data in their texts get pseudonyms. Null texts stay null."""
    return pii.pseudonymised(docs, PII_KEY)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken): how often the mix takes each document."""
    return mixing.mix(docs.select("doc_id", "source", mixing.word_count("text").alias("size")))


STAGES = [
    ("toxicity", toxic),
    ("simhash near-dedup", near_duplicates),
    ("benchmark decontamination", contaminated),
    ("pii", private),
    ("mixing", mixed),
]

#: the classifier, the fingerprints and the draws aren't expressible in SQL; tests hold run() against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs, _ = written(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs

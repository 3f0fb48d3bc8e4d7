"""A training corpus from ``documents``: language ID, near-dedup, decontamination, secret scan, mixing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. All but the last return the columns
of ``documents``; the last also has the domain and how often the mix takes a document. Stages drop documents that they
reject, but for the secret scan, which keeps them and replaces the secrets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandlake.llm import decontam, langid, neardup, secrets
from strandlake.llm._shared import Scratch, table
from strandlake.llm.queries import VOCABULARY, mixer

#: SQL can express neither the sketches nor the models; tests hold every stage against brute force.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or in no language that the model knows well enough, go."""
    return langid.accepted(spark, docs, langid.train(docs, VOCABULARY))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: five-word shingles, a similarity of 0.8 or more."""
    return neardup.keep_one(spark, docs, width=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontam.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced; n_chars follows the text."""
    return secrets.redact_documents(spark, docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the target weights take, with their copies."""
    return mixer(spark).mixed(docs)


STAGES = [
    ("language ID", language_id),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("secret scans", secret_scan),
    ("mixing to target weights", mixing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = before = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir))
        if i:
            scratch.drop(before)
        before = docs
    return docs

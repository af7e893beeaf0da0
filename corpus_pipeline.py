"""The corpus pipeline: quality rules, near-duplicates, decontamination, secrets, packing.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is
written and read again as the next one's ``docs``. All but the last return the columns of ``documents``. An empty table
gives an empty table in each stage, and columns beyond those of ``documents`` are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillgraph.llm import decontam, nearcopies, packing, quality, secrets
from quillgraph.llm.common import on_path, settle, table

#: A document of which decontamination leaves fewer words goes.
LEAST_WORDS = 20


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; boilerplate lines go from the others. Null and empty texts go; repeated rows are judged each."""
    on_path(spark)
    return quality.apply_rules(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that of the least doc_id; five-word shingles, similarity of 0.8 or more. Null and empty
    texts are one group; of rows with one doc_id one stays; rows without a doc_id stay."""
    on_path(spark)
    return nearcopies.drop_near_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages go from the texts, and documents that were little else. Null and empty texts have none and stay, as do
    all documents where the benchmark is empty."""
    return decontam.remove_passages(docs, table(spark, sf_dir, "benchmark"), least_words=LEAST_WORDS)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; all documents stay, null and empty ones as they are."""
    on_path(spark)
    return secrets.mask(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sequences, with their ids. A null or empty text is the end id alone; rows that repeat a doc_id are packed each."""
    on_path(spark)
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scans", secret_scans),
    ("packing", pack),
]

#: Fingerprints, the tagger and the tokenizer can't be written in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, applied one after another to the whole table ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = settle(docs)
    return docs

"""A corpus from raw documents to token ids: five stages, each over all that the one before kept.

Each stage is written as Parquet in the shared folder and read again, so a lost executor never costs more
than the stage it runs. Stages treat null ids and texts as their operators state: a null or empty text
fails the quality rules; rows with a null id are kept unless a row with an id stands for their group; extra columns
go along to the last stage; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from boundwright.llm import bpe, decontaminate, quality_model, quality_rules, simhash
from boundwright.llm.common import released, table, written
from boundwright.sources.shared import WRITTEN


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the byte-level network takes for good ones; it learns from the labels of the documents at hand."""
    return quality_model.accepted(docs, quality_model.learned(docs, table(spark, sf_dir, "labels")))


def well_formed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the compression bands."""
    return quality_rules.kept(docs)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates."""
    return simhash.survivors(docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each document left."""
    return bpe.digests(docs)


STAGES = [
    ("quality classifier", good),
    ("quality rules", well_formed),
    ("near-duplicates", distinct),
    ("decontamination", uncontaminated),
    ("byte-level BPE", tokens),
]

#: SQL has neither the network nor zstandard nor the vocabulary's merges; tests/llm/test_pipeline.py takes the stages one document at a time.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to `documents`. What a stage wrote on the way is deleted once its result is written."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        before = len(WRITTEN)
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, name.replace(" ", "-"))
            released(spark, before, 1)
    return docs

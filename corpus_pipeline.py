"""Documents to packed sequences: classify, deduplicate, replace personal data, mix sources, pack.

Each stage is written as Parquet and read again as the next one's documents; all but the last return their columns.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from terravane.llm import mixing, packing, pii, quality, simhash
from terravane.llm.queries import PII_KEY, VOCABULARY, table
from terravane.operators.shared import remove, remove_at_exit, shared_root


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the labelled ones among them, predicts 1."""
    return quality.keep_quality(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of SimHash near-duplicates."""
    return simhash.keep_one(docs)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates in their texts."""
    return pii.replace_pii(docs, PII_KEY, entities=None)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources as whole documents, one row for each time that a document is taken."""
    return mixing.mix_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences of 2048 ids."""
    return packing.pack_documents(docs, public_tokenizers.path(VOCABULARY), capacity=2048, end_id=0)


STAGES = [("quality classifier", classify), ("simhash near-dedup", deduplicate), ("pii", replace_personal_data), ("mixing", mix), ("packing", pack)]

#: No stage's decisions can be written as SQL (learned rules, 64-bit fingerprints, keyed permutations, random draws).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents; one row per piece of a packed document.

    Each stage's table goes as soon as the next one is written, the last when the driver ends. Null texts count as empty
    and fail the classifier or not as an empty text does; null and repeated ids stay separate documents; sources may be
    null; extra columns go along up to packing; an empty table, or one of which the classifier keeps nothing, gives no row.
    """
    docs = table(spark, sf_dir, "documents")
    base, before = f"{shared_root(spark)}/terravane/pipeline-{uuid.uuid4().hex}", None
    remove_at_exit(spark, base)
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{i}")
        docs = spark.read.parquet(f"{base}/{i}")
        if before is not None:
            remove(spark, before)
        before = f"{base}/{i}"
    return docs

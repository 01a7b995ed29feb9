"""One query per operator, over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terravane.llm import fingerprints, licenses, mixing, packing, pii, quality, rules, simhash, tokens, urls

#: Parameters of the queries.
VOCABULARY = "word_bpe_49k.json"
PII_KEY = "terravane-surrogates-1"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), capacity=2048, end_id=0)


def op2_minhash_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_edits(table(spark, sf_dir, "documents"))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_by_document(*mixing.mix_sources(table(spark, sf_dir, "documents")))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.replace_pii(docs, PII_KEY).withColumn("n_entities", F.size("entities").cast("long"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality_rules(table(spark, sf_dir, "documents"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score_quality(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op9_wavelet_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards, _ = tokens.write_token_shards(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), 1)
    return tokens.read_token_shards(shards)


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf_dir, "pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [
        op1_best_fit_packing,
        op2_minhash_fingerprints,
        op3_source_mixing,
        op4_simhash_near_dedup,
        op5_pii_surrogates,
        op6_quality_rules,
        op7_license_scan,
        op8_quality_classifier,
        op9_wavelet_token_shards,
        op10_url_filters,
    ]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op6_quality_rules": rules.ORACLE_SQL, "op10_url_filters": urls.ORACLE_SQL}

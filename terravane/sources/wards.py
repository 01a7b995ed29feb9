"""The mapping of new wards to old ones: learnt from records that state both, kept, and how well it resolves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terravane.functions import address
from terravane.functions.text import UNKNOWN
from terravane.operators import modeling
from terravane.operators.shared import cut


def learn(records: DataFrame, old: str = "ward_name", new: str = "ward_name_v3", district: str = "area_name") -> DataFrame:
    """The most frequent old ward and district of each new ward, over records that state all three."""
    named = records.select(address.ward(F.col(new)).alias("new_ward"), address.ward(F.col(old)).alias("old_ward"), address.district(F.col(district)).alias("old_district"))
    known = named.filter(" AND ".join(f"{c} <> '{UNKNOWN}'" for c in named.columns))
    return modeling.majority_mapping(known, "new_ward", ["old_ward", "old_district"])


def save(mapping: DataFrame, path: str, force: bool = False) -> DataFrame:
    """Write a mapping; one that is there stays unless forced."""
    spark = mapping.sparkSession
    if not force:
        try:
            return load(spark, path)
        except FileNotFoundError:
            pass
    cut(mapping).write.mode("overwrite").parquet(path)
    return load(spark, path)


def load(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            raise FileNotFoundError(path) from e
        raise


def mapping(spark: SparkSession, records: DataFrame, path: str, force: bool = False) -> DataFrame:
    """The kept mapping; without one it is learnt from the records and kept."""
    try:
        if not force:
            return load(spark, path)
    except FileNotFoundError:
        pass
    return save(learn(records), path, True)


def quality(resolved: DataFrame) -> DataFrame:
    """One row: rows, the share without a ward, and rows by where their ward came from (old, mapped, mapped_weak, unmapped)."""
    frames = ("old", "mapped", "mapped_weak", "unmapped")
    counts = [F.count_if(F.col("ward_frame") == f).alias(f) for f in frames]
    rate = F.round(F.coalesce(F.try_divide(F.count_if(F.col("ward_frame") == "unmapped"), F.count("*")), F.lit(0.0)), 4)
    return resolved.agg(F.count("*").alias("rows"), rate.alias("unmapped_rate"), *counts)


def weak(mapping: DataFrame, share: float = modeling.WEAK_SHARE) -> DataFrame:
    """New wards whose majority is thin, the thinnest first."""
    return mapping.filter(F.col("majority_share") < share).select("new_ward", "majority_share").orderBy("majority_share", "new_ward")

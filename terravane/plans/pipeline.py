"""The preprocessing plan of listing tables, its funnel, gate and reports."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Sequence
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terravane.functions import money
from terravane.functions.text import deaccent
from terravane.operators import cleaning, dedup, shared

#: The gate's checks as (metric, threshold, whether it is a ceiling).
GATE = [("rows", 8000, False), ("long_share", 0.90, False), ("price_share", 0.80, False), ("place_share", 0.70, False), ("target_rows", 3000, False), ("phones", 0, True), ("phones_independent", 0, True)]


def funnel(steps: Sequence[tuple[str, DataFrame]], source: str = "source") -> DataFrame:
    """Rows of each step by source, and the change to the step before (per source)."""
    counts = None
    for i, (name, df) in enumerate(steps):
        own = df.groupBy(F.col(source).alias("source")).agg(F.count("*").alias("n")).select(F.lit(i).alias("step"), F.lit(name).alias("name"), "source", "n")
        counts = own if counts is None else counts.unionByName(own)
    order = Window.partitionBy("source").orderBy("step")
    return counts.withColumn("change", F.col("n") - F.lag("n").over(order))


def funnel_totals(steps: Sequence[tuple[str, DataFrame]], source: str, sources: Sequence[str]) -> DataFrame:
    """One row per step: total, change and a column per source."""
    by = funnel(steps, source)
    totals = by.groupBy("step", "name").agg(F.sum("n").alias("total"), *(F.sum(F.when(F.col("source") == s, F.col("n")).otherwise(0)).alias(s) for s in sources))
    return totals.withColumn("change", F.col("total") - F.lag("total").over(Window.orderBy("step")))  # one row per step


def gate(stats: DataFrame, checks: Sequence[tuple[str, float, bool]] = GATE) -> DataFrame:
    """One row of metrics against thresholds: (metric, value, threshold, passed)."""
    rows = [F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"), F.lit(float(t)).alias("threshold"), (F.col(m) <= t if ceiling else F.col(m) >= t).alias("passed")) for m, t, ceiling in checks]
    return stats.select(F.explode(F.array(*rows)).alias("c")).select("c.*")


def prepare(listings: DataFrame) -> tuple[DataFrame, list[tuple[str, DataFrame]]]:
    """Unified listings to the processed table, and the steps for the funnel: labels, domain rules, near-duplicates, missing
    indicators, text without money (before and after tokens), unit price."""
    labelled = cleaning.drop_missing(listings, ["total_price_vnd", "area_m2"])
    ruled = cleaning.apply_rules(labelled, cleaning.hard_rules()).filter("reason IS NULL").drop("reason")
    ruled = shared.cut(ruled.repartition("listing_id"))  # read four times, by all cores however few files there are
    text = F.concat_ws(" ", "title", "description")
    pairs = dedup.duplicate_links(ruled, "listing_id", text, [F.col("district"), F.col("ward"), dedup.area_bucket(F.col("area_m2"))], F.col("total_price_vnd"))
    one = dedup.survivors(ruled, dedup.groups_of(pairs), "listing_id", F.col("published_at"), F.length(F.coalesce("description", F.lit(""))))
    numeric = [c for c in ("bedrooms", "bathrooms", "floors", "frontage_m", "alley_width_m") if c in one.columns]
    marked = cleaning.mark_missing(one, numeric, ["legal_status", "direction", "position"])
    clean = marked.withColumn("description_clean", money.strip_money(F.concat_ws(" ", "title", "description")))
    tokens = money.pretokenize(F.col("description_clean"))
    out = clean.withColumn("description_tokens", money.strip_money(tokens)).withColumn("price_per_m2", F.col("total_price_vnd") / F.col("area_m2"))
    return out, [("read", listings), ("labels", labelled), ("rules", ruled), ("duplicates", one)]


def features(df: DataFrame) -> DataFrame:
    """Calendar, length and flag columns."""
    at, text = F.col("published_at"), F.concat_ws(" ", "title", "description")
    quarter = (F.year(at) - 2025) * 4 + F.quarter(at) - 1
    return df.withColumns({"year": F.year(at), "month": F.month(at), "quarter_index": quarter, "description_length": F.length(F.coalesce("description", F.lit("")))} | money.flags(text))


def leaders(results: DataFrame, metric: str, spread: str) -> DataFrame:
    """Models within one deviation of the best."""
    best = results.orderBy(metric).limit(1).select((F.col(metric) + F.col(spread)).alias("limit"))
    return results.join(F.broadcast(best)).filter(F.col(metric) <= F.col("limit")).drop("limit")  # one row


def formatted(c: Column, digits: int = 0) -> Column:
    """Thousands by dots, decimals after a comma; not finite is overflow."""
    text = F.translate(F.format_number(c, digits), ",.", ".,")
    return F.when(F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")), F.lit("tràn số")).otherwise(text)


def formatted_number(value: float | None, digits: int = 0) -> str:
    """The same of one number."""
    if value is None or value != value or value in (float("inf"), float("-inf")):
        return "tràn số"
    return f"{value:,.{digits}f}".translate(str.maketrans(",.", ".,"))


def normal_key(c: Column) -> Column:
    """Accent-free key of a name."""
    return F.regexp_replace(deaccent(c), "[^a-z0-9]+", "_")


class RunManifest:
    """Parameters, counts, notes, duration and status of a run, written as one JSON text through Spark's file systems."""

    def __init__(self, spark: SparkSession, step: str, root: str, **params: object) -> None:
        self.spark, self.root = spark, root
        self.data: dict = {"step": step, "run_id": uuid.uuid4().hex, "params": params, "counts": {}, "notes": [], "status": "running"}

    def count(self, key: str, value: int) -> None:
        self.data["counts"][key] = value

    def note(self, message: str) -> None:
        self.data["notes"].append(message)

    @property
    def path(self) -> str:
        return f"{self.root}/{self.data['step']}-{self.data['run_id']}"

    def __enter__(self) -> RunManifest:
        self.began = time.time()
        self.data["started_at"] = datetime.now(timezone.utc).isoformat(timespec="seconds")
        return self

    def __exit__(self, kind, error, _) -> None:
        self.data |= {"status": "failed" if kind else "ok", "seconds": round(time.time() - self.began, 3)}
        if error:
            self.note(f"{kind.__name__}: {error}")
        self.spark.createDataFrame([(json.dumps(self.data, ensure_ascii=False, default=str),)], "value string").coalesce(1).write.text(self.path)

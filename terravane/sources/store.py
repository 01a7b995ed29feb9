"""Raw records: JSON-lines scans, an append-only store that knows its ids, paged sources, profiles."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from terravane.operators.shared import placed, remove


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Records of JSON lines under a schema; blank and malformed lines are left out, absent keys are null."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").option("recursiveFileLookup", "true").json(path)


def listing_id(url: Column) -> Column:
    """Digits after ``-id`` at the end of a listing's address."""
    return F.nullif(F.regexp_extract(url, r"-id(\d+)(?:$|[/?#])", 1), F.lit(""))


def new_records(records: DataFrame, seen: DataFrame, id_: str) -> DataFrame:
    """Records whose id (as text) is not in the store; of equal ids one stays. A null id is an error."""
    checked = records.withColumn(id_, F.coalesce(F.col(id_).cast("string"), F.raise_error("record without id").cast("string")))
    return checked.join(seen.select(F.col(id_).cast("string").alias(id_)), id_, "left_anti").dropDuplicates([id_]).select(*records.columns)


def append(records: DataFrame, path: str, id_: str, source: str, url: Column | None = None, scrub: Callable[[DataFrame], DataFrame] = lambda d: d) -> int:
    """Append new records to the store at ``path`` (by source and day), redacted by ``scrub``; running it again adds nothing.
    Returns how many were new."""
    spark = records.sparkSession
    try:
        seen = spark.read.parquet(path).filter(F.col("_source") == source).select(id_)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        seen = records.select(id_).limit(0)
    fresh = scrub(new_records(records, seen, id_)).withColumns(
        {"_source": F.lit(source), "_source_url": F.lit("") if url is None else url, "_collected_at": F.date_trunc("second", F.current_timestamp()), "crawl_day": F.current_date()}
    )
    from pyspark.sql import Observation

    seen_rows = Observation("appended")
    fresh.observe(seen_rows, F.count("*").alias("n")).write.mode("append").partitionBy("_source", "crawl_day").parquet(path)
    return int(seen_rows.get["n"])


class Checkpoint:
    """A small state by name, as one JSON text in a folder that Spark can write. What can't be read counts as empty."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        self.data = self._load()

    def _load(self) -> dict:
        try:
            found = json.loads("".join(r["value"] for r in self.spark.read.text(self.path).collect()))
        except Exception:  # absent, cut off or no JSON: the crawl starts anew, and known ids keep it from writing twice
            return {}
        return found if isinstance(found, dict) else {}

    def get(self, key: str, default: object = None) -> object:
        return self.data.get(key, default)

    def save(self, **values: object) -> None:
        self.data |= values
        self.spark.createDataFrame([(json.dumps(self.data, ensure_ascii=False),)], "value string").coalesce(1).write.mode("overwrite").text(self.path)

    def reset(self) -> None:
        self.data = {}
        remove(self.spark, self.path)


def stop_after_known(rows: DataFrame, seen: DataFrame, id_: str, order: str, limit: int = 120) -> DataFrame:
    """Rows of a listing in its order up to the point where ``limit`` consecutive ones are known; only the new ones.

    A known row's place among all rows less its place among known ones is the number of new rows before it: rows of one run
    of known ones share it. So runs are counted by partial sums, and no window orders the whole listing in one task.
    """
    own = seen.select(F.col(id_).alias("_seen")).distinct()
    by = [F.col(order).asc(), F.col(id_).asc()]
    marked = placed(rows.join(own, F.col(id_) == F.col("_seen"), "left"), [], by, "_place", "_rows")
    known = placed(marked.filter("_seen IS NOT NULL").select("_place"), [], [F.col("_place").asc()], "_known", "_rows")
    runs = known.groupBy((F.col("_place") - F.col("_known")).alias("run")).agg(F.count("*").alias("n"), F.min("_place").alias("start"))
    stop = runs.filter(F.col("n") >= limit).agg(F.min("start").alias("_stop"))
    return marked.join(F.broadcast(stop)).filter("_seen IS NULL AND (_stop IS NULL OR _place < _stop)").select(*rows.columns)  # one row


class _Page(InputPartition):
    def __init__(self, partition: str, offset: int) -> None:
        self.partition, self.offset = partition, offset


class PagedSource(DataSource):
    """A paged gateway as a Spark source: each (partition, offset) is one input partition, fetched by the function ``fetch`` that a
    subclass defines: (partition, offset, limit) -> list of row tuples. Options: partitions (comma-separated), total, page_size."""

    fetch: Callable[[str, int, int], list[tuple]]

    @classmethod
    def name(cls) -> str:
        return "paged"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _PagedReader(self)


class _PagedReader(DataSourceReader):
    def __init__(self, source: PagedSource) -> None:
        self.options, self.fetch = dict(source.options), type(source).fetch

    def partitions(self) -> Sequence[InputPartition]:
        size, total = int(self.options.get("page_size", 20)), int(self.options.get("total", 0))
        return [_Page(p, o) for p in self.options.get("partitions", "").split(",") for o in range(0, total, size)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield from self.fetch(partition.partition, partition.offset, int(self.options.get("page_size", 20)))


def first_seen(records: DataFrame, id_: str, at: Column) -> DataFrame:
    """(id, first): when each id came first. A partial minimum, so ids of many records meet in no task."""
    return records.groupBy(F.col(id_).alias("id")).agg(F.min(at).alias("first"))


def profile(df: DataFrame) -> DataFrame:
    """Per column: type, share of non-null rows and an example (40 characters, the smallest), in one pass."""
    aggs = [x for i, c in enumerate(df.columns) for x in (F.count(F.col(c)).alias(f"n{i}"), F.substring(F.min(F.col(c).cast("string")), 1, 40).alias(f"e{i}"))]
    one = df.agg(F.count("*").alias("rows"), *aggs)
    rows = [F.struct(F.lit(c).alias("column"), F.lit(kind).alias("type"), F.try_divide(f"n{i}", "rows").alias("non_null_share"), F.col(f"e{i}").alias("example")) for i, (c, kind) in enumerate(df.dtypes)]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")

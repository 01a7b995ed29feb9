"""Incremental ingest as a stream: new files of a raw folder, each id once, appended idempotently."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def stream_table(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """A folder of Parquet files as a stream under the schema that its files have now."""
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


#: Fixed value: the provider that keeps state on disk, so that ids need not fit in memory.
STATE_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def ingest(stream: DataFrame, path: str, checkpoint: str, id_: str) -> StreamingQuery:
    """Append each id once to ``path``. The ids are the query's state, dealt by hash: a batch meets only its own ids there, and the
    store is never read again. One run takes all that is there and ends; the checkpoint remembers files and ids, and a batch that
    is tried again adds nothing, as the files of a sink count once. ``path`` belongs to this query alone."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_PROVIDER)
    out = stream.dropDuplicates([id_]).writeStream.format("parquet").option("path", path)
    return out.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def deduplicated(stream: DataFrame, id_: str, time: str, lateness: str = "1 day") -> DataFrame:
    """Each id once while the watermark remembers it: state is bounded by ``lateness``."""
    return stream.withWatermark(time, lateness).dropDuplicatesWithinWatermark([id_])


def windowed(stream: DataFrame, time: str, value: Column, by: Column, width: str = "1 day", lateness: str = "1 day") -> DataFrame:
    """Count and approximate median by window and group."""
    rows = stream.withWatermark(time, lateness).groupBy(F.window(time, width), by.alias("grp"))
    return rows.agg(F.count("*").alias("n"), F.percentile_approx(value, 0.5).alias("median"))

"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from terravane.operators.shared import remove, remove_at_exit, shared_root

__all__ = ["files_for", "remove", "shared_root", "written"]


#: Rows of a file of a table whose number of rows is known, and the fewest files that such a table is cut into.
FILE_ROWS, FILES = 1 << 18, 8


def files_for(rows: int) -> int:
    return max(FILES, -(-rows // FILE_ROWS))


def written(df: DataFrame, name: str, codec: str = "zstd", files: int | None = None) -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet into the shared folder and read it back: lineage is cut, lost executors cost nothing. ``files``: at most
    so many, for a table that may be small in many partitions.

    Returns the table and its path; pass the path to :func:`remove` as soon as no plan needs it. What is left goes when the
    driver exits.
    """
    spark = df.sparkSession
    path = f"{shared_root(spark)}/terravane/{name}-{uuid.uuid4().hex}"
    (df if files is None else df.coalesce(files)).write.option("compression", codec).parquet(path)
    remove_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path), path

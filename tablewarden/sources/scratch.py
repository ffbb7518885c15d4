"""Intermediate tables below ``spark.checkpoint.dir``.

A written table cuts lineage like ``checkpoint()`` but is compressed and read by
column, so a wide and a narrow reader of one costly step share its work. The tables
that one session has written are dropped by :func:`drop_written` (jobs do, when their
output is written)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tablewarden.session import checkpoint_dir

_written: dict[str, list[str]] = {}


def new_folder(spark: SparkSession, name: str) -> str:
    """The path of a new folder for tables that :func:`drop_written` shall drop."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/written-{uuid.uuid4().hex}-{name}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` computed once: written now and read back."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(spark: SparkSession, keep: int = 0) -> int:
    """Drop the tables that this session has written, but for the first ``keep``; gives
    how many. DataFrames that read them can not be read any more."""
    paths = _written.get(spark.sparkContext.applicationId, [])
    gone = paths[keep:]
    for path in gone:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    del paths[keep:]
    return len(gone)


def written_tables(spark: SparkSession) -> int:
    return len(_written.get(spark.sparkContext.applicationId, []))

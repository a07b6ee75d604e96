"""Reading the corpus tables, and sizes that steer partition counts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

BYTES_PER_TASK = 32 << 20
UNKNOWN = 1 << 60


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spelled(*ids: str | Column) -> list[Column]:
    """Ids on their way into Python, as text: a NULL beside numbers would turn them into floats."""
    return [(F.col(i) if isinstance(i, str) else i).cast("long").cast("string") for i in ids]


def numbered(df: DataFrame, *ids: str) -> DataFrame:
    """Ids that came back from Python as text."""
    return df.withColumns({i: F.col(i).cast("long") for i in ids})


def tasks_for(df: DataFrame, bytes_per_task: int = BYTES_PER_TASK, least: int = 8) -> int:
    """A partition count that follows the input: the files' bytes over ``bytes_per_task``.

    Sizes come from Spark's own statistics, so any file system Spark reads will do. Where it knows
    none, the input's own partitions stand for 64 MB each.
    """
    stats = df._jdf.queryExecution().optimizedPlan().stats()
    size = int(str(stats.sizeInBytes()))
    if size > UNKNOWN:
        size = df.rdd.getNumPartitions() << 26
    return max(least, math.ceil(size / bytes_per_task))

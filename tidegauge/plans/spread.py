"""Parallelism for costly work on few input splits."""

from __future__ import annotations

from pyspark.sql import DataFrame

TASKS_PER_SPLIT = 8


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows dealt evenly over tasks, whose number follows the input's and that of the cores.

    For work that costs far more per row than moving the row. Splits of an input say nothing about
    its rows: of a file's splits only as many have rows as the file has row groups.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    splits = df.rdd.getNumPartitions()
    return df.repartition(cores if splits < cores else TASKS_PER_SPLIT * splits, key)

"""Ordered work inside a key, without putting the whole key into one task.

A window over a key runs in one task, which is too much when one key holds a large share of the
rows. The functions here cut each key along its order into segments (say, days), run the window
per (key, segment), and carry over only one summary row per (key, segment). The summaries of a
key, a number bounded by its time span and not by its rows, are what the per-key window sees.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

SEGMENT = "_segment"


def before(window):
    """All earlier segments of the key."""
    return window.rowsBetween(Window.unboundedPreceding, -1)


def local_window(keys: Sequence[str], order: Sequence):
    return Window.partitionBy(*keys, SEGMENT).orderBy(*order)


def carry(df: DataFrame, keys: Sequence[str], summary: dict[str, Column],
          carried: dict[str, Callable]) -> DataFrame:
    """Join to each row what the earlier segments of its key amount to.

    ``summary`` maps names to aggregates per (key, segment); ``carried`` maps new columns to
    functions of the window over the key's segments, in order, that read those names.
    """
    per_segment = df.groupBy(*keys, SEGMENT).agg(*[c.alias(n) for n, c in summary.items()])
    over = Window.partitionBy(*keys).orderBy(SEGMENT)
    offsets = per_segment.select(*keys, SEGMENT,
                                 *[f(over).alias(n) for n, f in carried.items()])
    # Each row meets at most one summary; a plan that drops the carried columns drops the join too.
    return df.join(offsets, [*keys, SEGMENT], "left")


def _order(order) -> list:
    return [order] if isinstance(order, (str, Column)) else list(order)


def lag_across(df: DataFrame, keys: Sequence[str], segment: Column, order, value: str,
               out: str) -> DataFrame:
    """``value`` (never NULL) of the previous row of the key."""
    order = _order(order)
    cut = df.withColumn(SEGMENT, segment)
    position = order[0] if len(order) == 1 else F.struct(*order)
    last = F.max_by(F.col(value), position)
    joined = carry(cut, keys, {"_last": last},
                   {"_carried": lambda w: F.lag("_last").over(w)})
    w = local_window(keys, order)
    return (joined.withColumn(out, F.coalesce(F.lag(value).over(w), F.col("_carried")))
            .drop(SEGMENT, "_carried"))


def running_sum(df: DataFrame, keys: Sequence[str], segment: Column, order, value: Column,
                out: str) -> DataFrame:
    """Sum of ``value`` over the key's rows up to and including this one."""
    order = _order(order)
    cut = df.withColumn(SEGMENT, segment).withColumn("_value", value)
    joined = carry(cut, keys, {"_total": F.sum("_value")},
                   {"_earlier": lambda w: F.sum("_total").over(before(w))})
    w = local_window(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("_value").over(w) + F.coalesce(F.col("_earlier"), F.lit(0))
    return joined.withColumn(out, total).drop(SEGMENT, "_value", "_earlier")


def running_max(df: DataFrame, keys: Sequence[str], segment: Column, order, value: Column,
                out: str) -> DataFrame:
    """Largest ``value`` (NULLs aside) over the key's rows up to and including this one."""
    order = _order(order)
    cut = df.withColumn(SEGMENT, segment).withColumn("_value", value)
    joined = carry(cut, keys, {"_top": F.max("_value")},
                   {"_earlier": lambda w: F.max("_top").over(before(w))})
    w = local_window(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    top = F.greatest(F.max("_value").over(w), F.col("_earlier"))
    return joined.withColumn(out, top).drop(SEGMENT, "_value", "_earlier")


def rank_across(df: DataFrame, keys: Sequence[str], segment: Column, order, out: str) -> DataFrame:
    """Row number of the key's rows; segments sort ascending, then ``order`` inside them."""
    order = _order(order)
    cut = df.withColumn(SEGMENT, segment)
    joined = carry(cut, keys, {"_rows": F.count("*")},
                   {"_earlier": lambda w: F.sum("_rows").over(before(w))})
    number = F.row_number().over(local_window(keys, order)) + F.coalesce(F.col("_earlier"), F.lit(0))
    return joined.withColumn(out, number.cast("bigint")).drop(SEGMENT, "_earlier")


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence, limit: int, spread: Column,
                out: str, buckets: int = 64) -> DataFrame:
    """The first ``limit`` rows of each key, exactly, numbered from 1.

    A first cut per (key, bucket) keeps at most ``limit`` rows in each bucket, so the final
    per-key window sees at most ``limit * buckets`` rows however large the key is.
    """
    bucket = F.pmod(F.xxhash64(spread), F.lit(buckets))
    first = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    cut = (df.withColumn("_bucket", bucket).withColumn("_n", F.row_number().over(first))
           .filter(F.col("_n") <= limit).drop("_n", "_bucket"))
    final = Window.partitionBy(*keys).orderBy(*order)
    return cut.withColumn(out, F.row_number().over(final)).filter(F.col(out) <= limit)

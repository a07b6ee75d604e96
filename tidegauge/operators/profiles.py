"""Reports on top of the device message table: statistics, profiles, payload values, outliers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidegauge.plans.segments import SEGMENT


def device_stats(messages: DataFrame, width_ms: int = 3_600_000) -> DataFrame:
    """Messages, bytes and time range per device and window of ``width_ms``, also of late instants."""
    start = F.col("timestamp_ms") - F.pmod("timestamp_ms", F.lit(width_ms))
    return messages.groupBy("mac_addr", start.alias("window_ms")).agg(
        F.count("*").alias("messages"), F.sum(F.octet_length("payload")).alias("bytes"),
        F.min("timestamp_ms").alias("first_ms"), F.max("timestamp_ms").alias("last_ms"))


def device_profile(messages: DataFrame) -> DataFrame:
    """First and last message, their number and the mean gap between them.

    The gaps add up to the time between first and last message, so no ordering is needed.
    """
    sums = messages.groupBy("mac_addr").agg(
        F.min("timestamp_ms").alias("first_ms"), F.max("timestamp_ms").alias("last_ms"),
        F.count("*").alias("messages"))
    gap = (F.col("last_ms") - F.col("first_ms")) / F.when(F.col("messages") > 1, F.col("messages") - 1)
    return sums.withColumn("mean_gap_ms", gap)


def payload_metric(payload: Column, path: str) -> Column:
    """Number at a JSON path of a payload, NULL when it has none."""
    return F.try_variant_get(F.try_parse_json(payload.cast("string")), path, "double")


def anomalies(values: DataFrame, key: str, ms: str, seq: str, value: str, z: float = 3.0,
              history: int = 20, segment_ms: int = 7 * 86_400_000) -> DataFrame:
    """Rows more than ``z`` standard deviations from the mean of the ``history`` rows before.

    Each key is cut into time segments; a segment is preceded by the last ``history`` rows of the
    ones before it, so every row sees its whole history.
    """
    cut = values.withColumn(SEGMENT, F.expr(f"{ms} DIV {segment_ms}"))
    tail_window = Window.partitionBy(key, SEGMENT).orderBy(F.desc(ms), F.desc(seq))
    row = F.struct(F.col(ms).alias("m"), F.col(seq).alias("s"), F.col(value).alias("v"))
    tails = (cut.withColumn("_n", F.row_number().over(tail_window)).filter(F.col("_n") <= history)
             .groupBy(key, SEGMENT).agg(F.collect_list(row).alias("_rows")))
    # Rows of the segments before, of which the last ``history`` may be needed; a segment has at
    # least one row, so ``history`` segments are enough.
    w = Window.partitionBy(key).orderBy(SEGMENT).rowsBetween(-history, -1)
    flat = F.flatten(F.collect_list("_rows").over(w))
    earlier = (tails.withColumn("_rows", F.slice(F.reverse(F.sort_array(flat)), 1, history))
               .select(key, SEGMENT, F.inline("_rows")))
    own = cut.select(key, SEGMENT, F.col(ms).alias("m"), F.col(seq).alias("s"),
                     F.col(value).alias("v"), F.lit(True).alias("_own"))
    both = own.unionByName(earlier.withColumn("_own", F.lit(False)))
    before = Window.partitionBy(key, SEGMENT).orderBy("m", "s").rowsBetween(-history, -1)
    scored = both.withColumn("mean", F.avg("v").over(before)).withColumn(
        "deviation", F.stddev_samp("v").over(before)).withColumn("_n", F.count("v").over(before))
    return (scored.filter(F.col("_own") & (F.col("_n") == history) & (F.col("deviation") > 0)
                          & (F.abs(F.col("v") - F.col("mean")) > z * F.col("deviation")))
            .select(key, F.col("m").alias(ms), F.col("s").alias(seq), F.col("v").alias(value),
                    "mean", "deviation"))

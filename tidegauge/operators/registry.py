"""Device registry: the last arrival of each device, kept as an upserted table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidegauge import schema as S


def arrival_order(partition: str = "partition", offset: str = "offset") -> Column:
    """Position in the topic as one number, so that aggregates keep a fixed-width buffer.

    A device's messages share a topic partition; the partition breaks ties where they do not.
    """
    return (F.col(partition).cast("decimal(38,0)") * F.lit("10000000000000000000").cast("decimal(20,0)")
            + F.col(offset)).cast("decimal(38,0)")


def seen_order(ms: str = "arrival_ms") -> Column:
    """Arrival time and then position in the topic as one number, rising over all partitions."""
    return (F.col(ms).cast("decimal(38,0)") * F.lit("1" + "0" * 24).cast("decimal(25,0)")
            + arrival_order()).cast("decimal(38,0)")


def latest_per_device(df: DataFrame, order: str = "arrival", mac: str = "mac_addr",
                      timestamp: str = "timestamp") -> DataFrame:
    """One row per device: the time of its last message, the positions of first and last, and when
    it was first seen.

    ``arrival`` takes the last message to arrive, whose time may be older than that of an earlier
    one; ``event_time`` takes the largest time. Rows are combined before they are shuffled.
    """
    position = arrival_order()
    value = F.col(timestamp)
    if order == "arrival":
        latest = F.max_by(value, position)
    elif order == "event_time":
        latest = F.max(value)
    else:
        raise ValueError(f"unknown order {order!r}")
    return df.groupBy(mac).agg(latest.alias("timestamp"), F.min(position).alias("first_position"),
                               F.max(position).alias("last_position"),
                               F.min(seen_order()).alias("first_seen"))


def latest_message(df: DataFrame, key: str, value: str) -> DataFrame:
    """The last text to arrive per device, one candidate per device leaving each map task."""
    return df.groupBy(key).agg(F.max_by(value, arrival_order()).alias(value))


def batch_stats(df: DataFrame, *by: str) -> DataFrame:
    """Rows and key plus value bytes, per micro-batch or topic partition."""
    size = F.octet_length("key") + F.octet_length("value")
    return df.groupBy(*by).agg(F.count("*").alias("rows"), F.sum(size).alias("bytes"))


def merge_registry(current: DataFrame | None, latest: DataFrame) -> DataFrame:
    """Registry after an upsert: known devices get the new time and keep their id.

    The id of a device is the arrival time and topic position of its first message, so ids rise in
    the order devices were first seen, over all partitions. ``current`` and ``latest`` hold at most one row per device.
    """
    fresh = latest.select("mac_addr", F.col("timestamp").alias("_new"),
                          F.col("first_seen").alias("_id"))
    if current is None:
        return fresh.select(F.col("_id").alias("id"), "mac_addr", F.col("_new").alias("timestamp"))
    joined = current.join(fresh, "mac_addr", "full_outer")
    return joined.select(F.coalesce("id", "_id").alias("id"), "mac_addr",
                         F.coalesce("_new", "timestamp").alias("timestamp"))


def newest_devices(registry: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` devices with the highest ids, as a bounded top-n."""
    return registry.orderBy(F.desc("id")).limit(n)

"""The device registry and the devices' state as state of Spark's own store.

Both are aggregations of a stream: rows combine before they are shuffled, the merged row of each key
lies in the state store (RocksDB, by ``session.prepare``) below the query's checkpoint, and the
``statestore`` source reads it back as a table. The number of store partitions is that of shuffle
partitions when a query first starts.

A device's state is a session that every write renews: the watermark drops it from the store once
its time to live has passed without a write. Without a watermark nothing leaves the store, which then
holds one row per entry, expired or not.
"""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidegauge import schema as S
from tidegauge.operators.presence import state_entries
from tidegauge.operators.registry import arrival_order, seen_order

FOREVER_DAYS = 36_500  # longer than any stream: a time to live of 0 never ends

# The store names its columns after the aggregates' buffers, in the order of the aggregates; no two
# aggregates of a query may be of one kind, or their names would be the same.
_REGISTRY = ("mac_addr", "timestamp", "_position", "id")
_STATE = ("key", "_start", "_key", "_window", "written_ms", "e", "_order")
_ENTRIES = ("key", "written_ms", "e", "_order")  # without watermark


def registry_rows_of(connections: DataFrame) -> DataFrame:
    """One row per device over all of a stream: the last time to arrive, and the first arrival as id."""
    return connections.groupBy("mac_addr").agg(
        F.max_by("timestamp", arrival_order()).alias("timestamp"), F.min(seen_order()).alias("id"))


def state_sessions(messages: DataFrame, delay: str | None, key: str = "mac_hex", value: str = "value",
                   ms: str = "arrival_ms", state_ttl_ms: int = S.DEVICE_ONLINE_TTL_MS,
                   latest_ttl_ms: int = S.DEVICE_LATEST_TTL_MS) -> DataFrame:
    """Sessions of the ``state`` and ``latest`` entries of each device, as a stream aggregation.

    ``delay`` is how late a message may be behind the newest. What leaves the aggregation, in append
    mode, are the entries that have expired. With a delay of None no message is late and no entry ever
    leaves: the last write of each, however messages are ordered, to be run in update mode.
    """
    rows = messages.select(F.inline(state_entries(F.col(key), F.col(value), state_ttl_ms, latest_ttl_ms)),
                           F.col(ms).alias("written_ms"), arrival_order().alias("position"))
    last = [F.max("written_ms").alias("written_ms"),
            F.max_by(F.struct("value", "ttl_ms"), "position").alias("entry")]
    if delay is None:
        return rows.groupBy("key").agg(*last)
    gap = F.when(F.col("ttl_ms") > 0, F.concat(F.col("ttl_ms").cast("string"), F.lit(" milliseconds"))
                 ).otherwise(f"{FOREVER_DAYS} days")
    timed = rows.withColumn("_at", F.timestamp_millis("written_ms")).withWatermark("_at", delay)
    return timed.groupBy("key", F.session_window("_at", gap)).agg(*last)


def _store(spark: SparkSession, checkpoint: str, version: int | None) -> DataFrame | None:
    reader = spark.read.format("statestore")
    if version is not None:
        reader = reader.option("batchId", version)
    try:
        return reader.load(checkpoint)
    except PySparkException as missing:
        if "STDS" in (missing.getCondition() or ""):  # no micro-batch has been committed
            return None
        raise


def read_registry(spark: SparkSession, checkpoint: str, version: int | None = None) -> DataFrame | None:
    """``id, mac_addr, timestamp`` after the last micro-batch (or one of the last), None before the
    first. The id is the earliest arrival of the device: a rerun gives the same ids."""
    rows = _store(spark, checkpoint, version)
    if rows is None:
        return None
    return rows.select("key.*", "value.*").toDF(*_REGISTRY).select("id", "mac_addr", "timestamp")


def registry_rows(registry: DataFrame) -> DataFrame:
    return registry.select(F.col("id").cast("string").alias("id"), "mac_addr", "timestamp")


def read_state(spark: SparkSession, checkpoint: str, version: int | None = None) -> DataFrame | None:
    """``key, value, expires_at_ms`` of the entries in the store, None before the first micro-batch.

    An entry that ended and began again within the watermark's delay is there twice until the
    watermark has passed; the later one counts.
    """
    rows = _store(spark, checkpoint, version)
    if rows is None:
        return None
    held = rows.select("key.*", "value.*")
    names = _STATE if len(held.columns) == len(_STATE) else _ENTRIES
    rows = held.toDF(*names).groupBy("key").agg(
        F.max_by(F.struct("e.*", "written_ms"), F.struct("written_ms", "_order")).alias("e"))
    return rows.select("key", "e.value", F.when(
        F.col("e.ttl_ms") > 0, F.col("e.written_ms") + F.col("e.ttl_ms")).alias("expires_at_ms"))

"""Topic connector: options for reading and writing, independent of whether it is installed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidegauge import schema as S

# The fetch limits consumers run with.
FETCH_MAX_BYTES = 10_485_760
FETCH_MAX_WAIT_MS = 1_000


def read_options(brokers: str, topic: str = S.ENVELOPE_TOPIC, group: str | None = None,
                 start: str = "earliest", flush_rows: int = S.FLUSH_MAX_ROWS,
                 idle_seconds: int = S.FLUSH_IDLE_SECONDS, max_rows: int | None = None,
                 min_bytes: int = 1, max_bytes: int = FETCH_MAX_BYTES,
                 max_wait_ms: int = FETCH_MAX_WAIT_MS) -> dict[str, str]:
    """Source options. The stream's checkpoint keeps the position; ``group`` only names the
    consumer to the brokers.

    A micro-batch starts as soon as ``flush_rows`` wait, or ``idle_seconds`` after the last one; the
    next follows at once while rows wait. ``max_rows`` bounds a micro-batch: set it by what the
    cluster processes in a few minutes, no bound takes all there is.
    """
    if start not in ("earliest", "latest"):
        raise ValueError("start must be earliest or latest")
    options = {
        "kafka.bootstrap.servers": brokers,
        "subscribe": topic,
        "startingOffsets": start,
        "failOnDataLoss": "true",
        "minOffsetsPerTrigger": str(flush_rows),
        "maxTriggerDelay": f"{idle_seconds}s",
        "kafka.fetch.min.bytes": str(min_bytes),
        "kafka.fetch.max.bytes": str(max_bytes),
        "kafka.fetch.max.wait.ms": str(max_wait_ms),
    }
    if group:
        options["groupIdPrefix"] = group
    if max_rows:
        options["maxOffsetsPerTrigger"] = str(max_rows)
    return options


def read_kafka(spark: SparkSession, brokers: str, **kwargs) -> DataFrame:
    """Stream of a topic in the columns of the landing files."""
    raw = spark.readStream.format("kafka").options(**read_options(brokers, **kwargs)).load()
    return raw.select(
        "partition", "offset", F.col("key").cast("string").alias("key"),
        F.col("value").cast("string").alias("value"),
        F.unix_millis("timestamp").alias("arrival_ms"))


def write_options(brokers: str, topic: str = S.ENVELOPE_TOPIC) -> dict[str, str]:
    return {"kafka.bootstrap.servers": brokers, "topic": topic, "kafka.acks": "all"}


def write_kafka(rows: DataFrame, brokers: str, checkpoint: str, topic: str = S.ENVELOPE_TOPIC):
    """Stream rows of (key, value) to a topic; a delivery that fails stops the query."""
    return (rows.select("key", "value").writeStream.format("kafka")
            .options(**write_options(brokers, topic))
            .option("checkpointLocation", checkpoint).start())

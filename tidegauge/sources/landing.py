"""Topic rows kept as files, as batch or stream, and MQTT messages chosen by topic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidegauge import schema as S
from tidegauge.functions.mac import topic_matches


def read_landing(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(S.LANDING).parquet(path)


def stream_landing(spark: SparkSession, path: str, schema=S.LANDING,
                   max_files: int | None = None, max_bytes: int | None = None) -> DataFrame:
    """Stream of files; either bound limits what one micro-batch takes in."""
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if max_bytes:
        reader = reader.option("maxBytesPerTrigger", max_bytes)
    return reader.parquet(path)


def read_mqtt_messages(messages: DataFrame, topic_filter: str = S.MQTT_TOPIC_FILTER) -> DataFrame:
    return messages.filter(topic_matches(F.col("topic"), topic_filter))

"""Queries over the device registry."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge import fixtures as X
from tidegauge.operators import envelopes as E
from tidegauge.operators import registry as R
from tidegauge.queries.catalog import register

# Position of a message in the topic: partition, then offset.
POSITION = """(CAST("partition" AS DECIMAL(38,0)) * 10000000000000000000 + "offset")"""
# When it arrived, then its position.
SEEN = f"""(CAST(arrival_ms AS DECIMAL(38,0)) * 1000000000000000000000000::DECIMAL(38,0) + {POSITION})"""
LATEST = f"""SELECT mac_addr, arg_max("timestamp", {POSITION}) AS "timestamp",
    min({POSITION}) AS first_position, max({POSITION}) AS last_position,
    min({SEEN}) AS first_seen
    FROM registry WHERE mac_addr IS NOT NULL GROUP BY mac_addr"""


def connections(spark, d):
    return E.connections(E.parse_connections(X.envelopes(spark, d))).filter("error IS NULL")


@register(f"""SELECT mac_addr, "timestamp", CAST(first_position AS VARCHAR) AS first_position,
              CAST(last_position AS VARCHAR) AS last_position FROM ({LATEST})""")
def latest_per_device(spark, d):
    return R.latest_per_device(connections(spark, d)).select(
        "mac_addr", "timestamp", F.col("first_position").cast("string").alias("first_position"),
        F.col("last_position").cast("string").alias("last_position"))


@register("""SELECT mac_addr, max("timestamp") AS "timestamp" FROM registry
             WHERE mac_addr IS NOT NULL GROUP BY mac_addr""")
def latest_per_device_event_time(spark, d):
    return R.latest_per_device(connections(spark, d), order="event_time").select(
        "mac_addr", "timestamp")


@register(f"""SELECT mac_hex, arg_max(value, {POSITION}) AS value FROM relay WHERE accepted
              GROUP BY mac_hex""")
def latest_message(spark, d):
    parsed = E.parse_edge_json(X.envelopes(spark, d)).filter("accepted")
    return R.latest_message(parsed, "mac_hex", "value")


@register("""SELECT "partition", count(*) AS "rows",
             CAST(sum(octet_length(encode(key)) + octet_length(encode(value))) AS BIGINT) AS bytes
             FROM fx_envelopes GROUP BY "partition" """)
def batch_stats(spark, d):
    return R.batch_stats(X.envelopes(spark, d), "partition")


def halves(spark, d):
    """Connections in two batches, split at the middle of the topic's offsets."""
    rows = connections(spark, d)
    middle = X.table(spark, d, "events").agg(F.expr("max(event_id) DIV 2")).scalar()
    return rows.filter(F.col("offset") < middle), rows.filter(F.col("offset") >= middle)


REGISTRY_SQL = f"""SELECT CAST(first_seen AS VARCHAR) AS id, mac_addr, "timestamp" FROM (
    SELECT mac_addr, arg_max("timestamp", {POSITION}) AS "timestamp",
      arg_min({SEEN}, ("offset" >= middle, {SEEN})) AS first_seen
    FROM registry, (SELECT max(event_id) // 2 AS middle FROM events)
    WHERE mac_addr IS NOT NULL GROUP BY mac_addr)"""


@register(REGISTRY_SQL)
def upsert_registry(spark, d):
    """Two batches, one after the other, into an empty registry."""
    first, second = halves(spark, d)
    registry = R.merge_registry(None, R.latest_per_device(first))
    merged = R.merge_registry(registry, R.latest_per_device(second))
    return merged.select(F.col("id").cast("string").alias("id"), "mac_addr", "timestamp")


@register(f"""SELECT CAST(first_seen AS VARCHAR) AS id, mac_addr, "timestamp" FROM ({LATEST})
              ORDER BY arrival DESC, "partition" DESC, "offset" DESC LIMIT 5""".replace(
    LATEST, LATEST.replace("FROM registry", """, min_by(arrival_ms, ("arrival_ms", "partition", "offset"))
      AS arrival, min_by("partition", ("arrival_ms", "partition", "offset")) AS "partition",
      min_by("offset", ("arrival_ms", "partition", "offset")) AS "offset" FROM registry""")))
def newest_devices(spark, d):
    registry = R.merge_registry(None, R.latest_per_device(connections(spark, d)))
    return R.newest_devices(registry, 5).select(
        F.col("id").cast("string").alias("id"), "mac_addr", "timestamp")

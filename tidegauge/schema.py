"""Schemas and fixed values shared by every job.

The constants below are wire and policy values: messages, tables and logs written by other
components carry exactly these, so they are stated here as plain values.
"""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values: envelope ---------------------------------------------------------------
ENVELOPE_SCHEMA_ID = "iota.edge.raw.v1"
ENVELOPE_TOPIC = "iota.edge.raw.v1"
MQTT_TOPIC_FILTER = "iota/+/devices/+/telemetry"
INGRESS_PROTOCOL_MQTT = "mqtt"

# --- fixed values: binary frames ----------------------------------------------------------
EDGE_HEADER_BYTES = 18
EDGE_MAX_PAYLOAD_BYTES = 1 << 20
TUNNEL_MAGIC = "49505450"
TUNNEL_VERSION = 1
TUNNEL_HEADER_BYTES = 20
TUNNEL_TYPES = {
    1: "open",
    2: "data",
    3: "close",
    4: "control",
    5: "finish",
    6: "replicate",
    7: "kafka_broadcast",
}
GOSSIP_MAGIC = "49504742"
GOSSIP_VERSION = 1
GOSSIP_HEADER_BYTES = 76

# --- fixed values: time to live, limits ---------------------------------------------------
DEVICE_ONLINE_TTL_MS = 60_000
DEVICE_LATEST_TTL_MS = 86_400_000
SEEN_TTL_MS = 600_000
FLUSH_MAX_ROWS = 50_000
FLUSH_IDLE_SECONDS = 60
TARGET_FILE_BYTES = 128 << 20
MAX_STREAMS = 4096
MAX_LINKS = 512
GOSSIP_TTL = 4
GOSSIP_FANOUT = 32

# --- fixed values: route health -----------------------------------------------------------
MAX_ROUTES = 4096
RESPONSE_MAX_ROUTES = 2500
RESPONSE_PERCENT = 23
MAX_ROUTE_HOPS = 8
RETRY_BACKOFF_MS = 60_000
ROUTE_STALE_MS = 30 * 86_400_000
ROUTE_FUTURE_SKEW_MS = 600_000
RECENT_TRY_MS = 600_000
SUCCESS_STALE_MS = 7 * 86_400_000
GIVE_UP_ATTEMPTS = 3
BAD_FAILURES = 10
CAPABILITY_STALE_MS = 120_000
HELLO_SKEW_MS = 600_000

# --- fixed values: packet rules -----------------------------------------------------------
CHAINS = {0: "INPUT", 1: "OUTPUT", 2: "FORWARD"}
ACTIONS = {0: "DROP", 1: "ACCEPT", 2: "STOLEN", 3: "QUEUE", 4: "REPEAT", 5: "STOP"}
PROTOCOLS = {6: "tcp", 17: "udp", 1: "icmp", 2: "igmp"}
LOG_UTC_OFFSET_HOURS = 8

# --- fixed values: field names of tables and documents --------------------------------------
DEVICE_MESSAGE = T.StructType(
    [
        T.StructField("mac_addr", T.StringType(), False),
        T.StructField("timestamp_ms", T.LongType(), False),
        T.StructField("event_time", T.TimestampNTZType(), False),
        T.StructField("payload", T.BinaryType(), False),
        T.StructField("created_at", T.TimestampNTZType(), False),
    ]
)

LANDING = T.StructType(
    [
        T.StructField("partition", T.IntegerType()),
        T.StructField("offset", T.LongType()),
        T.StructField("key", T.StringType()),
        T.StructField("value", T.StringType()),
        T.StructField("arrival_ms", T.LongType()),
    ]
)

REGISTRY = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("mac_addr", T.StringType(), False),
        T.StructField("timestamp", T.LongType(), False),
    ]
)

# Counters are unsigned 64-bit numbers, the time is a signed one.
U64 = T.DecimalType(20, 0)
CAPABILITY = T.StructType(
    [
        T.StructField("accepting_ingress", T.BooleanType()),
        T.StructField("max_kcp_links", U64),
        T.StructField("current_kcp_links", U64),
        T.StructField("max_ingress_streams", U64),
        T.StructField("current_ingress_streams", U64),
        T.StructField("max_ingress_bytes_per_second", U64),
        T.StructField("current_ingress_bytes_per_second", U64),
        T.StructField("updated_at_ms", T.LongType()),
    ]
)

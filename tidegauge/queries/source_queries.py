"""Queries over sources and sinks: tables written and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge import fixtures as X
from tidegauge import schema as S
from tidegauge.functions.payload import epoch_us
from tidegauge.operators import envelopes as E
from tidegauge.queries.catalog import register
from tidegauge.queries.registry_queries import LATEST
from tidegauge.session import scratch
from tidegauge.sources import landing as L
from tidegauge.sources import tables as T
from tidegauge.streaming import pipelines as P
from tidegauge.streaming import stores

MESSAGES = """SELECT mac_addr, timestamp_ms, event_us, lower(hex(payload)) AS payload_hex,
    created_at FROM storage WHERE error IS NULL"""


def shown(messages):
    return messages.select("mac_addr", "timestamp_ms", epoch_us(F.col("event_time")).alias("event_us"),
                           F.lower(F.hex("payload")).alias("payload_hex"), "created_at")


def landing(spark, d) -> str:
    """Topic rows written as files."""
    path = scratch(spark, "landing")
    X.envelopes(spark, d).write.parquet(path)
    return path


@register("""SELECT "partition", "offset", key, value, arrival_ms FROM fx_envelopes""")
def read_landing(spark, d):
    return L.read_landing(spark, landing(spark, d))


@register("""SELECT topic, clientid, username, qos, "timestamp", id, lower(hex(payload)) AS payload_hex
    FROM fx_mqtt WHERE regexp_full_match(topic, 'iota/[^/]*/devices/[^/]*/telemetry')""")
def read_mqtt_messages(spark, d):
    chosen = L.read_mqtt_messages(X.mqtt_messages(spark, d))
    return chosen.select("topic", "clientid", "username", "qos", "timestamp", "id",
                         F.lower(F.hex("payload")).alias("payload_hex"))


@register(MESSAGES)
def append_device_messages(spark, d):
    """Two micro-batches appended, the second one written twice."""
    path = scratch(spark, "device-message")
    middle = X.table(spark, d, "events").agg(F.expr("max(event_id) DIV 2")).scalar()
    rows = X.envelopes(spark, d)
    # Parsed once: a batch that is written again is the same rows.
    second = T.round_trip(E.device_messages(E.parse_envelopes(rows.filter(F.col("offset") >= middle))),
                          "device-message-batch")
    T.append_batch(E.device_messages(E.parse_envelopes(rows.filter(F.col("offset") < middle))), path, 0)
    T.append_batch(second, path, 1)
    T.append_batch(second, path, 1)
    return shown(T.read_device_messages(spark, path))


@register(MESSAGES)
def read_device_messages(spark, d):
    """The table created in the catalog, filled and read by name."""
    location = scratch(spark, "warehouse")
    name = "device_message_" + location.rsplit("-", 1)[1]
    T.ensure_table(spark, name, location=location)
    T.append_table(E.device_messages(E.parse_envelopes(X.envelopes(spark, d))), name)
    T.ensure_table(spark, name, location=location)
    return shown(spark.table(name))


@register("""SELECT 'mac_addr' AS col_name, 'string' AS data_type, count(*) AS messages FROM good
    UNION ALL SELECT 'timestamp_ms', 'bigint', count(*) FROM good
    UNION ALL SELECT 'event_time', 'timestamp_ntz', count(*) FROM good
    UNION ALL SELECT 'payload', 'binary', count(*) FROM good
    UNION ALL SELECT 'created_at', 'timestamp_ntz', count(*) FROM good""",
          extra={"good": "SELECT * FROM storage WHERE error IS NULL"})
def ensure_table(spark, d):
    """Columns of the created table, and for each the messages that have a value."""
    location = scratch(spark, "warehouse")
    name = "device_message_" + location.rsplit("-", 1)[1]
    T.ensure_table(spark, name, location=location)
    T.append_table(E.device_messages(E.parse_envelopes(X.envelopes(spark, d))), name)
    rows = spark.table(name)
    counts = rows.agg(*[F.count(c).alias(c) for c in rows.columns])
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return counts.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("col_name"), F.lit(kinds[c]).alias("data_type"),
                 F.col(c).alias("messages")) for c in rows.columns])))


@register("""SELECT mac_addr, timestamp_ms FROM storage WHERE error IS NULL""")
def sized_write(spark, d):
    path = scratch(spark, "sized")
    messages = E.device_messages(E.parse_envelopes(X.envelopes(spark, d)))
    T.sized_write(messages, path, max_rows=S.FLUSH_MAX_ROWS)
    return T.read_device_messages(spark, path).select("mac_addr", "timestamp_ms")


@register("""SELECT "partition", "offset", key, error FROM storage WHERE error IS NOT NULL""")
def quarantine(spark, d):
    path = scratch(spark, "quarantine")
    bad = E.apply_bad_message_policy(E.parse_envelopes(X.envelopes(spark, d)), "quarantine")
    bad.select(*S.LANDING.fieldNames(), "error").write.parquet(path)
    return spark.read.parquet(path).select("partition", "offset", "key", "error")


@register(f"""SELECT CAST(first_seen AS VARCHAR) AS id, mac_addr, "timestamp" FROM ({LATEST})""")
def read_registry(spark, d):
    """The registry of a stream that stops, finds more rows when it starts again, and then none."""
    path, checkpoint = scratch(spark, "landing"), scratch(spark, "registry-checkpoint")
    rows = X.envelopes(spark, d)
    middle = X.table(spark, d, "events").agg(F.expr("max(event_id) DIV 2")).scalar()
    for part in (rows.filter(F.col("offset") < middle), rows.filter(F.col("offset") >= middle), None):
        if part is not None:
            part.write.mode("append").parquet(path)
        P.registry_stream(L.stream_landing(spark, path), checkpoint).awaitTermination()
    return stores.registry_rows(stores.read_registry(spark, checkpoint))

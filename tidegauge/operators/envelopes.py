"""Envelope parsing under the three consumer policies, and the messages made from envelopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidegauge import schema as S
from tidegauge.functions import jsonfields as J
from tidegauge.functions import mac as M
from tidegauge.functions import payload as P

STORAGE_STRINGS = ("schema", "mac_hex", "mac_addr", "topic", "payload_base64")
REGISTRY_STRINGS = STORAGE_STRINGS + (
    "ingress_protocol", "clientid", "username", "origin", "message_id", "mqtt_message_id")
TIMES = ("timestamp_ms", "timestamp")


def schema_ok(schema: Column) -> Column:
    """No schema id, or the supported one."""
    return schema.isNull() | (schema == "") | (schema == S.ENVELOPE_SCHEMA_ID)


def resolve_mac(policy: str, mac_addr: Column, mac_hex: Column, topic: Column) -> Column:
    """The device a message belongs to, NULL when it names none."""
    if policy == "storage":
        return M.first_nonempty(M.mac_lenient(mac_addr), M.mac_lenient(mac_hex),
                                M.mac_lenient(M.mac_from_topic(topic)))
    if policy == "registry":
        return M.first_nonempty(mac_addr, mac_hex, M.mac_from_topic(topic))
    if policy == "relay":
        return M.first_nonempty(M.mac_compact(mac_hex), M.mac_compact(mac_addr),
                                M.mac_compact(M.mac_from_topic_prefix(topic)))
    raise ValueError(f"unknown policy {policy!r}")


def _any(*flags: Column) -> Column:
    out = flags[0]
    for flag in flags[1:]:
        out = out | flag
    return out


def _now_ms() -> Column:
    return F.unix_millis(F.current_timestamp())


def parse_envelopes(df: DataFrame, created_ms: str | None = "arrival_ms") -> DataFrame:
    """Storage policy: one device message per row of ``value``, or the first failing check.

    All input columns stay; ``error`` is NULL for good rows, whose message columns are then all
    set. ``created_ms`` names the column with the receive time (default: the current time).
    """
    keep = [F.col(c) for c in df.columns]
    now = F.col(created_ms) if created_ms else _now_ms()
    typed = J.parse_fields(df, "value", STORAGE_STRINGS, TIMES, ("payload_len",)).select(
        *keep,
        (~F.col("_object") | _any(*[J.str_wrong(f) for f in STORAGE_STRINGS],
                                  *[J.u64_wrong(f) for f in TIMES],
                                  J.int_wrong("payload_len"))).alias("_bad_json"),
        *[J.str_value(f).alias(f"_{f}") for f in STORAGE_STRINGS],
        P.coalesce_nonzero_ts(J.u64_value("timestamp_ms"), J.u64_value("timestamp"),
                              now.cast("decimal(20,0)")).alias("_ts"),
        J.int_value("payload_len").alias("_payload_len"),
    )
    resolved = typed.select(
        *keep, "_bad_json", "_schema", "_ts", "_payload_len",
        M.mac_lenient(F.col("_mac_addr")).alias("_from_addr"),
        M.mac_lenient(F.col("_mac_hex")).alias("_from_hex"),
        M.mac_lenient(M.mac_from_topic(F.col("_topic"))).alias("_from_topic"),
        P.decode_payload(F.col("_payload_base64")).alias("payload"),
        F.when(P.fits_int64(F.col("_ts")), F.col("_ts")).cast("bigint").alias("timestamp_ms"),
    ).withColumn("mac_addr", M.first_nonempty(F.col("_from_addr"), F.col("_from_hex"),
                                              F.col("_from_topic")))
    error = (
        F.when(F.col("_bad_json"), "bad_json")
        .when(~schema_ok(F.col("_schema")), "bad_schema")
        .when(F.col("timestamp_ms").isNull(), "timestamp_overflow")
        .when(F.col("mac_addr").isNull(), "missing_mac")
        .when(F.col("payload").isNull(), "bad_payload")
        .when(F.col("_payload_len") < 0, "negative_payload_len")
        .when(~P.payload_len_ok(F.col("_payload_len"), F.col("payload")), "payload_len_mismatch")
    )
    return J.evaluated_once(resolved.select(
        *keep, "mac_addr", "timestamp_ms", P.event_time(F.col("timestamp_ms")).alias("event_time"), "payload",
        P.created_at_or_now(F.col(created_ms) if created_ms else None).alias("created_at"),
        error.alias("error"),
    ))


def device_messages(parsed: DataFrame) -> DataFrame:
    """The rows of the device message table: the good rows, in table column order."""
    return parsed.filter("error IS NULL").select(*S.DEVICE_MESSAGE.fieldNames())


def parse_connections(df: DataFrame, now_ms: str | None = "arrival_ms") -> DataFrame:
    """Registry policy: raw device name and time; the payload plays no part."""
    keep = [F.col(c) for c in df.columns]
    numbers = TIMES + ("stream_id",)
    ints = ("payload_len", "qos", "received_at_ms")
    now = F.col(now_ms) if now_ms else _now_ms()
    typed = J.parse_fields(df, "value", REGISTRY_STRINGS, numbers, ints).select(
        *keep,
        (~F.col("_object") | _any(*[J.str_wrong(f) for f in REGISTRY_STRINGS],
                                  *[J.u64_wrong(f) for f in numbers],
                                  *[J.int_wrong(f) for f in ints])).alias("_bad_json"),
        J.str_value("schema").alias("_schema"),
        P.coalesce_nonzero_ts(J.u64_value("timestamp_ms"), J.u64_value("timestamp"),
                              now.cast("decimal(20,0)")).alias("_ts"),
        resolve_mac("registry", J.str_value("mac_addr"), J.str_value("mac_hex"),
                    J.str_value("topic")).alias("device"),
    )
    return J.evaluated_once(typed.select(
        *keep, "device",
        F.when(P.fits_int64(F.col("_ts")), F.col("_ts")).cast("bigint").alias("timestamp"),
        F.when(F.col("_bad_json"), "bad_json")
        .when(~schema_ok(F.col("_schema")), "bad_schema")
        .when(~P.fits_int64(F.col("_ts")), "timestamp_overflow")
        .when(F.col("device").isNull(), "missing_mac").alias("error"),
    ))


def connections(parsed: DataFrame) -> DataFrame:
    """Registry rows: the device name must be a MAC, otherwise ``error`` is ``invalid_mac``."""
    named = F.coalesce(M.is_mac(F.col("device")), F.lit(False))
    error = F.coalesce(F.col("error"), F.when(~named, "invalid_mac"))
    # The check stands apart from the form: a filter on the error repeats it without making the form.
    mac = F.when(F.col("error").isNull(), M.mac_strict(F.col("device")))
    return parsed.withColumns({"mac_addr": mac, "error": error})


def parse_edge_json(df: DataFrame, received_ms: str | None = "arrival_ms",
                    meta_origin: Column | None = None,
                    meta_message_id: Column | None = None) -> DataFrame:
    """Relay policy: tolerant reading into the canonical edge message.

    Values of a wrong type count as absent. ``accepted`` is false for rows that are no JSON
    object, carry a foreign schema id or name no device. Origin and message id fall back to the
    transport's metadata when that is given.
    """
    keep = [F.col(c) for c in df.columns]
    strings = ("schema", "mac_hex", "mac_addr", "topic", "payload_base64", "origin",
               "message_id", "mqtt_message_id")
    numbers = TIMES + ("stream_id", "payload_len")
    typed = J.parse_fields(df, "value", strings, numbers).select(
        *keep, "_object",
        *[J.str_value(f).alias(f"_{f}") for f in strings],
        *[J.u64_value(f).alias(f"_{f}") for f in numbers],
    )
    named = typed.select(
        "*", M.mac_compact(F.col("_mac_hex")).alias("_from_hex"),
        M.mac_compact(F.col("_mac_addr")).alias("_from_addr"),
        M.mac_compact(M.mac_from_topic_prefix(F.col("_topic"))).alias("_from_topic"),
    ).withColumn("mac_hex", M.first_nonempty(F.col("_from_hex"), F.col("_from_addr"),
                                             F.col("_from_topic")))
    zero = F.lit(0).cast("decimal(20,0)")
    origin = [F.col("_origin")] + ([meta_origin] if meta_origin is not None else [])
    ids = [F.col("_message_id"), F.col("_mqtt_message_id")] + (
        [meta_message_id] if meta_message_id is not None else [])
    return J.evaluated_once(named.select(
        *keep,
        (F.col("_object") & schema_ok(F.col("_schema"))
         & F.col("mac_hex").isNotNull()).alias("accepted"),
        "mac_hex", M.colon_form(F.col("mac_hex")).alias("mac_addr"),
        F.coalesce(P.coalesce_nonzero_ts(F.col("_timestamp_ms"), F.col("_timestamp")),
                   zero).alias("timestamp_ms"),
        F.col("_stream_id").alias("stream_id"),
        F.col("_payload_base64").alias("payload_base64"),
        F.col("_payload_len").alias("payload_len"),
        F.coalesce(M.first_nonempty(*origin), F.lit("")).alias("origin"),
        F.coalesce(M.first_nonempty(*ids), F.lit("")).alias("message_id"),
        (F.col(received_ms) if received_ms else _now_ms()).alias("received_at_ms"),
    ))


# The canonical envelope has these keys, in alphabetical order.
CANONICAL_KEYS = ("mac_addr", "mac_hex", "message_id", "origin", "payload_base64", "payload_len",
                  "received_at_ms", "schema", "stream_id", "timestamp_ms")


def to_envelope_json(schema_column: Column | None = None) -> Column:
    """Canonical envelope text of the canonical message columns."""
    schema = schema_column if schema_column is not None else F.lit(S.ENVELOPE_SCHEMA_ID)
    parts = [schema.alias("schema") if k == "schema" else F.col(k) for k in CANONICAL_KEYS]
    return F.to_json(F.struct(*parts))


def bridge_mqtt(df: DataFrame, topic_filter: str = S.MQTT_TOPIC_FILTER) -> DataFrame:
    """MQTT messages to topic rows: the key is the MQTT topic, the value the bridge envelope."""
    chosen = df.filter(M.topic_matches(F.col("topic"), topic_filter))
    body = F.struct(
        F.lit(S.ENVELOPE_SCHEMA_ID).alias("schema"),
        F.lit(S.INGRESS_PROTOCOL_MQTT).alias("ingress_protocol"),
        "topic", "clientid", "username", "qos", "timestamp",
        F.col("id").alias("mqtt_message_id"),
        P.encode_payload(F.col("payload")).alias("payload_base64"),
    )
    return chosen.select(F.col("topic").alias("key"), F.to_json(body).alias("value"),
                         F.col("timestamp").alias("record_ms"))


def union_ingest(bridge_rows: DataFrame, frame_rows: DataFrame) -> DataFrame:
    """Rows of both ingress paths as one topic; columns one path lacks are NULL."""
    return bridge_rows.unionByName(frame_rows, allowMissingColumns=True)


def apply_bad_message_policy(parsed: DataFrame, on_error: str) -> DataFrame:
    """What a consumer does with rows whose ``error`` is set.

    skip: drop them; quarantine: keep only them; fail: stop the job at the first one.
    """
    if on_error == "skip":
        return parsed.filter("error IS NULL")
    if on_error == "quarantine":
        return parsed.filter("error IS NOT NULL")
    if on_error == "fail":
        stop = F.when(F.col("error").isNotNull(),
                      F.raise_error(F.concat(F.lit("bad message: "), F.col("error"))).cast("string"))
        return parsed.withColumn("error", stop)
    raise ValueError(f"unknown policy {on_error!r}")

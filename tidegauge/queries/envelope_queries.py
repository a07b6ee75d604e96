"""Queries over envelopes: the three parse policies and the expressions they are made of."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge import fixtures as X
from tidegauge.functions import jsonfields as J
from tidegauge.functions import mac as M
from tidegauge.functions import payload as P
from tidegauge.operators import envelopes as E
from tidegauge.queries import oracle_inputs as O
from tidegauge.queries.catalog import register

POSITION = ["partition", "offset"]


@register("""SELECT "partition", "offset", mac_addr, timestamp_ms, event_us,
             lower(hex(payload)) AS payload_hex, created_at, error FROM storage""")
def parse_envelopes(spark, d):
    parsed = E.parse_envelopes(X.envelopes(spark, d))
    return parsed.select(*POSITION, "mac_addr", "timestamp_ms",
                         P.epoch_us(F.col("event_time")).alias("event_us"),
                         F.lower(F.hex("payload")).alias("payload_hex"), "created_at", "error")


@register("""SELECT "partition", "offset", device, "timestamp", mac_addr,
             coalesce(error1, CASE WHEN mac_addr IS NULL THEN 'invalid_mac' END) AS error
             FROM registry""")
def parse_connections(spark, d):
    parsed = E.connections(E.parse_connections(X.envelopes(spark, d)))
    return parsed.select(*POSITION, "device", "timestamp", "mac_addr", "error")


@register(f"""SELECT "partition", "offset", accepted, mac_hex, {O.colon('mac_hex')} AS mac_addr,
              CAST(timestamp_ms AS VARCHAR) AS timestamp_ms, CAST(stream_id AS BIGINT) AS stream_id,
              payload_base64, CAST(payload_len AS BIGINT) AS payload_len, origin, message_id
              FROM relay""")
def parse_edge_json(spark, d):
    parsed = E.parse_edge_json(X.envelopes(spark, d))
    return parsed.select(
        *POSITION, "accepted", "mac_hex", "mac_addr",
        F.col("timestamp_ms").cast("string").alias("timestamp_ms"),
        F.col("stream_id").cast("bigint").alias("stream_id"), "payload_base64",
        F.col("payload_len").cast("bigint").alias("payload_len"), "origin", "message_id")


def _fields(spark, d, strings=(), numbers=(), ints=()):
    return J.parse_fields(X.envelopes(spark, d).select(*POSITION, "arrival_ms", "value"),
                          "value", strings, numbers, ints)


@register("""SELECT "partition", "offset", j_schema IN ('', 'iota.edge.raw.v1') AS schema_ok
             FROM fields""")
def schema_ok(spark, d):
    return _fields(spark, d, ["schema"]).select(
        *POSITION, E.schema_ok(J.str_value("schema")).alias("schema_ok"))


@register("""SELECT "partition", "offset", CAST(coalesce(nullif(j_timestamp_ms, 0),
             nullif(j_timestamp, 0), arrival_ms) AS VARCHAR) AS ts FROM fields""")
def coalesce_nonzero_ts(spark, d):
    ts = P.coalesce_nonzero_ts(J.u64_value("timestamp_ms"), J.u64_value("timestamp"),
                               F.col("arrival_ms").cast("decimal(20,0)"))
    return _fields(spark, d, numbers=["timestamp_ms", "timestamp"]).select(
        *POSITION, ts.cast("string").alias("ts"))


@register("""SELECT "partition", "offset", j_timestamp_ms <= 9223372036854775807 AS fits
             FROM fields""")
def u64_to_i64_guard(spark, d):
    return _fields(spark, d, numbers=["timestamp_ms"]).select(
        *POSITION, P.fits_int64(J.u64_value("timestamp_ms")).alias("fits"))


@register(f"SELECT event_id, mac, {O.lenient('mac')} AS normalized FROM fx_names")
def mac_lenient(spark, d):
    return X.device_names(spark, d).select(
        "event_id", "mac", M.mac_lenient(F.col("mac")).alias("normalized"))


STRICT = "replace(replace(replace(lower(mac), ':', ''), '-', ''), '.', '')"


@register(f"""SELECT event_id, mac, CASE WHEN regexp_full_match({STRICT}, '[0-9a-f]{{12}}')
              THEN {O.colon(STRICT)} END AS normalized FROM fx_names""")
def mac_strict(spark, d):
    return X.device_names(spark, d).select(
        "event_id", "mac", M.mac_strict(F.col("mac")).alias("normalized"))


@register(f"SELECT event_id, mac, {O.compact('mac')} AS normalized FROM fx_names")
def mac_compact(spark, d):
    return X.device_names(spark, d).select(
        "event_id", "mac", M.mac_compact(F.col("mac")).alias("normalized"))


@register(f"SELECT event_id, {O.colon('mac12')} AS mac_addr FROM fx_names")
def mac_hex_to_addr(spark, d):
    return X.device_names(spark, d).select(
        "event_id", M.colon_form(F.col("mac12")).alias("mac_addr"))


@register(f"SELECT event_id, topic, {O.TOPIC_MAC_OF.format('topic')} AS mac FROM fx_names")
def mac_from_topic(spark, d):
    return X.device_names(spark, d).select(
        "event_id", "topic", M.mac_from_topic(F.col("topic")).alias("mac"))


@register(f"SELECT event_id, topic, {O.topic_prefix_mac('topic')} AS mac FROM fx_names")
def mac_from_topic_prefix(spark, d):
    return X.device_names(spark, d).select(
        "event_id", "topic", M.mac_from_topic_prefix(F.col("topic")).alias("mac"))


@register("""SELECT s."partition", s."offset", s.mac_addr AS storage_mac, g.device AS registry_mac,
             r.mac_hex AS relay_mac
             FROM storage_raw s JOIN registry g USING ("partition", "offset")
             JOIN relay r USING ("partition", "offset")""")
def resolve_mac(spark, d):
    fields = _fields(spark, d, ["mac_addr", "mac_hex", "topic"]).select(
        *POSITION, *[J.str_value(f).alias(f) for f in ("mac_addr", "mac_hex", "topic")])
    args = (F.col("mac_addr"), F.col("mac_hex"), F.col("topic"))
    return fields.select(*POSITION, *[E.resolve_mac(p, *args).alias(f"{p}_mac")
                                      for p in ("storage", "registry", "relay")])


@register("""SELECT "partition", "offset", lower(hex(payload)) AS payload_hex FROM storage_raw""")
def decode_payload(spark, d):
    decoded = P.decode_payload(J.str_value("payload_base64"))
    return _fields(spark, d, ["payload_base64"]).select(
        *POSITION, F.lower(F.hex(decoded)).alias("payload_hex"))


@register("""SELECT "partition", "offset", j_payload_len AS declared,
             j_payload_len IS NULL OR (j_payload_len >= 0 AND j_payload_len = octet_length(payload))
             AS len_ok FROM storage_raw WHERE payload IS NOT NULL""")
def payload_len_ok(spark, d):
    fields = _fields(spark, d, ["payload_base64"], ints=["payload_len"]).select(
        *POSITION, J.int_value("payload_len").alias("declared"),
        P.decode_payload(J.str_value("payload_base64")).alias("payload"))
    return fields.filter("payload IS NOT NULL").select(
        *POSITION, "declared",
        P.payload_len_ok(F.col("declared"), F.col("payload")).alias("len_ok"))


@register("""SELECT "offset", make_timestamp(arrival_ms * 1000) AS event_time FROM fx_envelopes""")
def event_time(spark, d):
    return X.envelopes(spark, d).select("offset", P.event_time(F.col("arrival_ms")).alias("event_time"))


@register("""SELECT "offset", make_timestamp(arrival_ms * 1000) AS created_at FROM fx_envelopes""")
def created_at_or_now(spark, d):
    return X.envelopes(spark, d).select(
        "offset", P.created_at_or_now(F.col("arrival_ms")).alias("created_at"))


@register("SELECT event_id, base64(encode(repeat(props, 20))) AS encoded FROM events")
def encode_payload(spark, d):
    text = F.repeat("props", 20)
    return X.table(spark, d, "events").select(
        "event_id", P.encode_payload(F.encode(text, "UTF-8")).alias("encoded"))


@register(f"""SELECT "partition", "offset", to_json({{
    'mac_addr': {O.colon('mac_hex')}, 'mac_hex': mac_hex, 'message_id': message_id,
    'origin': origin, 'payload_base64': payload_base64, 'payload_len': payload_len,
    'received_at_ms': arrival_ms, 'schema': 'iota.edge.raw.v1', 'stream_id': stream_id,
    'timestamp_ms': timestamp_ms}})::VARCHAR AS json FROM relay WHERE accepted""")
def to_envelope_json(spark, d):
    parsed = E.parse_edge_json(X.envelopes(spark, d)).filter("accepted")
    return parsed.select(*POSITION, E.to_envelope_json().alias("json"))


@register("""SELECT "partition", "offset",
    coalesce(nullif(j_message_id, ''), nullif(j_mqtt_message_id, ''), 'meta-' || key) AS message_id,
    coalesce(nullif(j_origin, ''), 'node-' || "partition") AS origin FROM fields""")
def resolve_message_id(spark, d):
    parsed = E.parse_edge_json(X.envelopes(spark, d),
                               meta_origin=F.concat(F.lit("node-"), "partition"),
                               meta_message_id=F.concat(F.lit("meta-"), "key"))
    return parsed.select(*POSITION, "message_id", "origin")


@register("""SELECT id, topic, regexp_full_match(topic, 'iota/[^/]*/devices/[^/]*/telemetry')
             AS matches FROM fx_mqtt""")
def topic_matches(spark, d):
    return X.mqtt_messages(spark, d).select(
        "id", "topic", M.topic_matches(F.col("topic"), "iota/+/devices/+/telemetry").alias("matches"))


BRIDGE = """SELECT topic AS key, '{"schema":"iota.edge.raw.v1","ingress_protocol":"mqtt","topic":"'
    || topic || '","clientid":"' || clientid || '","username":"' || username || '","qos":' || qos
    || ',"timestamp":' || "timestamp" || ',"mqtt_message_id":"' || id || '","payload_base64":"'
    || base64(payload) || '"}' AS value, "timestamp" AS record_ms
    FROM fx_mqtt WHERE regexp_full_match(topic, 'iota/[^/]*/devices/[^/]*/telemetry')"""


@register(BRIDGE)
def bridge_mqtt(spark, d):
    return E.bridge_mqtt(X.mqtt_messages(spark, d))


@register("""SELECT "partition", "offset",
    CASE json_type(value, '$.timestamp_ms') WHEN 'UBIGINT' THEN 'integer'
      WHEN 'VARCHAR' THEN 'string' END AS kind,
    CASE WHEN json_type(value, '$.mac_hex') = 'VARCHAR'
      THEN json_extract_string(value, '$.mac_hex') ELSE '' END AS mac_hex,
    CAST(j_timestamp_ms AS VARCHAR) AS timestamp_ms, j_payload_len AS payload_len,
    coalesce(json_type(value, '$.timestamp_ms') <> 'UBIGINT', false) AS timestamp_wrong
    FROM fields""")
def typed_json_fields(spark, d):
    kind = F.col("_t_timestamp_ms")
    return _fields(spark, d, ["mac_hex"], ["timestamp_ms"], ["payload_len"]).select(
        *POSITION,
        F.when(kind == "STRING", "string").when(kind.isNotNull(), "integer").alias("kind"),
        J.str_value("mac_hex").alias("mac_hex"),
        J.u64_value("timestamp_ms").cast("string").alias("timestamp_ms"),
        J.int_value("payload_len").alias("payload_len"),
        J.u64_wrong("timestamp_ms").alias("timestamp_wrong"))


@register("""SELECT "partition", "offset", error FROM storage WHERE error IS NOT NULL""")
def bad_message_quarantine(spark, d):
    parsed = E.parse_envelopes(X.envelopes(spark, d))
    return E.apply_bad_message_policy(parsed, "quarantine").select(*POSITION, "error")


@register("""SELECT "partition", "offset", mac_addr, timestamp_ms FROM storage
             WHERE error IS NULL""")
def bad_message_skip(spark, d):
    parsed = E.parse_envelopes(X.envelopes(spark, d))
    return E.apply_bad_message_policy(parsed, "skip").select(*POSITION, "mac_addr", "timestamp_ms")


@register(f"""SELECT key, value, record_ms, origin FROM (
    SELECT *, NULL AS origin FROM ({BRIDGE})
    UNION ALL
    SELECT f.mac_hex AS key, to_json({{'mac_addr': {O.colon('f.mac_hex')}, 'mac_hex': f.mac_hex,
      'message_id': '', 'origin': '', 'payload_base64': base64(f.payload),
      'payload_len': octet_length(f.payload), 'received_at_ms': f.ts_ms, 'schema': 'iota.edge.raw.v1',
      'stream_id': f.stream_id, 'timestamp_ms': f.ts_ms}})::VARCHAR AS value,
      f.ts_ms AS record_ms, '' AS origin
    FROM (SELECT mac12 AS mac_hex, encode(props) AS payload, ts_ms,
            {O.STREAM_ID} AS stream_id
          FROM ev WHERE event_id % 11 <> 0 AND event_id % 13 <> 0) f)""")
def union_ingest(spark, d):
    from tidegauge.operators.frames import frames_to_messages

    messages = frames_to_messages(X.frames(spark, d), F.lit(0).cast("bigint"))
    messages = messages.withColumn("received_at_ms", F.col("timestamp_ms").cast("bigint"))
    framed = messages.select(F.col("mac_hex").alias("key"), E.to_envelope_json().alias("value"),
                             F.col("received_at_ms").alias("record_ms"), "origin")
    return E.union_ingest(E.bridge_mqtt(X.mqtt_messages(spark, d)), framed)

"""Queries over binary frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge import fixtures as X
from tidegauge.functions.payload import hex_id as hex_id_of
from tidegauge.operators import frames as R
from tidegauge.operators import long_streams as LS
from tidegauge.queries import oracle_inputs as O
from tidegauge.queries.catalog import register

VALID = "event_id % 11 <> 0 AND event_id % 13 <> 0"


def num(h: str) -> str:
    return f"CAST(('0x' || {h}) AS BIGINT)"


@register(f"""SELECT event_id, valid, CASE WHEN valid THEN substr(h, 1, 12) END AS mac_hex,
    CASE WHEN valid THEN {num("substr(h, 13, 16)")} END AS timestamp_ms,
    CASE WHEN valid THEN substr(h, 37) END AS payload_hex
    FROM (SELECT *, length(h) >= 36 AND {num("substr(h || repeat('0', 40), 29, 8)")}
                    = length(h) // 2 - 18 AS valid
          FROM (SELECT event_id, lower(hex(frame)) AS h FROM fx_frames))""")
def decode_edge_frames(spark, d):
    return R.decode_edge_frames(X.frames(spark, d)).select(
        "event_id", "valid", "mac_hex", F.col("timestamp_ms").cast("bigint").alias("timestamp_ms"),
        F.lower(F.hex("payload")).alias("payload_hex"))


@register(f"""SELECT event_id, mac12 AS mac_hex, {O.colon('mac12')} AS mac_addr, ts_ms AS timestamp_ms,
    {O.STREAM_ID} AS stream_id, base64(encode(props)) AS payload_base64,
    octet_length(encode(props)) AS payload_len, 'n1' AS origin, 'f' || event_id AS message_id,
    {O.A} AS received_at_ms FROM ev WHERE {VALID}""")
def frames_to_messages(spark, d):
    messages = R.frames_to_messages(
        X.frames(spark, d), F.lit(O.A), F.lit("n1"), F.concat(F.lit("f"), "event_id"))
    for name in ("timestamp_ms", "stream_id", "payload_len"):
        messages = messages.withColumn(name, F.col(name).cast("bigint"))
    return messages


@register("""SELECT id, valid, CASE WHEN valid THEN ['open', 'data', 'close', 'control', 'finish',
      'replicate', 'kafka_broadcast'][1 + id % 8] END AS type,
    CASE WHEN valid THEN CASE WHEN id % 19 = 0 THEN 0 ELSE user_id + 1 END END AS stream_id,
    CASE WHEN valid THEN lower(hex(encode(props))) END AS payload_hex
    FROM (SELECT *, event_id AS id, event_id % 8 < 7 AND event_id % 17 <> 0
            AND (event_id % 19 <> 0 OR event_id % 8 = 3) AS valid FROM ev)""")
def decode_tunnel_frames(spark, d):
    return R.decode_tunnel_frames(X.tunnel_packets(spark, d)).select(
        "id", "valid", "type", F.col("stream_id").cast("bigint").alias("stream_id"),
        F.lower(F.hex("payload")).alias("payload_hex"))


@register(f"""SELECT id, status, CASE WHEN status = 'envelope' THEN CAST(id % 6 AS INTEGER) END AS ttl,
    CASE WHEN status = 'envelope' THEN lower({O.hexn('user_id + 1', 64)}) END AS origin,
    CASE WHEN status = 'envelope' THEN lower({O.hexn('id // 4 + 1', 64)}) END AS message_id,
    CASE WHEN status <> 'invalid' THEN props END AS body
    FROM (SELECT *, event_id AS id, CASE WHEN event_id % 3 = 0 THEN 'plain'
            WHEN event_id % 29 = 0 THEN 'invalid' ELSE 'envelope' END AS status FROM ev)""")
def decode_gossip(spark, d):
    return R.decode_gossip(X.gossip_payloads(spark, d)).select(
        "id", "status", "ttl", "origin", "message_id", F.col("body").cast("string").alias("body"))


@register(f"""SELECT stream_id, event_id, stream_id // 4294967296 AS node_id,
    stream_id % 4294967296 AS local_id FROM fx_frames""")
def split_stream_id(spark, d):
    return X.frames(spark, d).select("stream_id", "event_id", *R.split_stream_id(F.col("stream_id")))


REASSEMBLED = f"""SELECT stream_id, row_number() OVER (PARTITION BY stream_id ORDER BY event_id) - 1
    AS frame_no, lower(hex(frame)) AS frame_hex
    FROM (SELECT f.* FROM fx_frames f JOIN ev USING (event_id)
          WHERE {VALID} AND user_id % 25 <> 24)"""


@register(REASSEMBLED)
def reassemble_frames(spark, d):
    return R.reassemble_frames(X.chunks(spark, d)).select(
        "stream_id", "frame_no", F.lower(F.hex("frame")).alias("frame_hex"))


@register(f"""SELECT event_id, CASE WHEN event_id % 4 < 2 THEN lower(lpad(to_hex(event_id), 64, '0'))
              END AS id FROM events""")
def hex_id(spark, d):
    text = F.expr("""CASE event_id % 4 WHEN 0 THEN concat('0x', lpad(hex(event_id), 64, '0'))
        WHEN 1 THEN lower(lpad(hex(event_id), 64, '0')) WHEN 2 THEN concat('xyz', event_id)
        ELSE lower(lpad(hex(event_id), 62, '0')) END""")
    return X.table(spark, d, "events").select("event_id", hex_id_of(text).alias("id"))


@register(REASSEMBLED)
def reassemble_long_streams(spark, d):
    """The same frames, every stream cut in ranges of 512 bytes."""
    return LS.reassemble(X.chunks(spark, d), long_bytes=1, range_bytes=512).select(
        "stream_id", "frame_no", F.lower(F.hex("frame")).alias("frame_hex"))

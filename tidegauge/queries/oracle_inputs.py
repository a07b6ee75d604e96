"""The job inputs of ``tidegauge.fixtures`` in SQL, as bodies of common table expressions."""

from __future__ import annotations

import re

from tidegauge.fixtures import AS_OF_MS, RULES

A = AS_OF_MS


def colon(x: str, sep: str = ":") -> str:
    return "(" + f" || '{sep}' || ".join(f"substr({x}, {1 + 2 * i}, 2)" for i in range(6)) + ")"


def hexn(x: str, n: int) -> str:
    return f"lpad(to_hex({x}), {n}, '0')"


def node(k: str) -> str:
    return (f"{{'host': 'h' || ({k}), 'port': 9000 + ({k}) % 1000, "
            f"'id': lower({hexn(k, 64)})}}")


EV = """SELECT event_id, user_id, event_type, value, props, printf('%012x', user_id) AS mac12,
               epoch_us(ts) // 1000 AS ts_ms FROM events"""

READINGS = """SELECT mac12, ts_ms, event_id,
  CASE WHEN event_id % 61 <> 0 AND event_id % 50 <> 0 THEN CAST(round(value * 100) AS BIGINT) END AS load,
  CASE WHEN event_id % 61 <> 0 THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k FROM ev"""

TOPIC = f"('iota/node-' || (user_id % 4) || '/devices/' || {colon('mac12', '-')} || '/telemetry')"

ENVELOPES = f"""
SELECT CAST(user_id % 3 AS INTEGER) AS "partition", event_id AS "offset", mac12 AS key,
  '{{' || concat_ws(',',
    CASE WHEN c = 4 THEN '"schema":"iota.edge.raw.v0"' ELSE '"schema":"iota.edge.raw.v1"' END,
    CASE WHEN c = 1 THEN '"mac_addr":" ' || upper({colon('mac12')}) || ' "'
         WHEN c >= 11 THEN '"mac_hex":"' || mac12 || '","mac_addr":"' || {colon('mac12')} || '"'
         WHEN c IN (0, 2, 10) THEN NULL
         ELSE '"mac_hex":"' || mac12 || '"' END,
    CASE WHEN c = 0 OR c >= 11 THEN '"topic":"' || {TOPIC} || '"'
         WHEN c = 10 THEN '"topic":"' || {TOPIC} || '/extra"' END,
    CASE WHEN c = 5 THEN NULL
         WHEN c = 0 THEN '"timestamp":' || ts_ms
         WHEN c = 8 THEN '"timestamp_ms":"' || ts_ms || '"'
         WHEN c = 9 THEN '"timestamp_ms":9223372036854775808'
         WHEN event_id % 40 = 12 THEN '"timestamp_ms":' || ts_ms * 1000
         WHEN event_id % 400 = 13 THEN '"timestamp_ms":9223372036854775807'
         ELSE '"timestamp_ms":' || ts_ms END,
    CASE WHEN c = 6 THEN '"payload_base64":""'
         WHEN c = 7 THEN '"payload_base64":"%%%"'
         ELSE '"payload_base64":"' || base64(encode(props)) || '"' END,
    CASE WHEN c = 3 THEN '"payload_len":' || (octet_length(encode(props)) + 1)
         WHEN c IN (0, 6, 7) THEN NULL
         ELSE '"payload_len":' || octet_length(encode(props)) END,
    CASE WHEN c = 6 THEN NULL
         WHEN c = 0 THEN '"mqtt_message_id":"m' || (event_id // 4) || '"'
         ELSE '"message_id":"m' || (event_id // 4) || '"' END,
    CASE WHEN c = 0 THEN '"ingress_protocol":"mqtt","clientid":"c' || user_id
                         || '","username":"u' || (user_id % 7) || '","qos":1'
         WHEN c >= 11 THEN '"stream_id":' || (user_id + 1) || ',"origin":"'
                         || lower({hexn('user_id + 1', 64)}) || '"' END
  ) || '}}' AS value, ts_ms + 250 AS arrival_ms
FROM (SELECT *, event_id % 20 AS c FROM ev)"""

# The fields of each envelope, with json_type telling numbers and strings apart.
_FIELDS = ("schema mac_hex mac_addr topic payload_base64 timestamp_ms timestamp payload_len "
           "stream_id origin message_id mqtt_message_id ingress_protocol clientid username "
           "qos received_at_ms").split()


def _text(f):
    return f"CASE WHEN json_type(value, '$.{f}') = 'VARCHAR' THEN json_extract_string(value, '$.{f}') ELSE '' END AS j_{f}"


def _num(f):
    return (f"CASE WHEN json_type(value, '$.{f}') = 'UBIGINT' THEN "
            f"CAST(json_extract_string(value, '$.{f}') AS HUGEINT) ELSE 0 END AS j_{f}")


_STRINGS = ("schema mac_hex mac_addr topic payload_base64 origin message_id mqtt_message_id "
            "ingress_protocol clientid username").split()
_NUMBERS = "timestamp_ms timestamp stream_id".split()


def _wrong(strings, numbers, ints):
    parts = [f"coalesce(json_type(value, '$.{f}') NOT IN ('VARCHAR', 'NULL'), false)" for f in strings]
    parts += [f"coalesce(json_type(value, '$.{f}') NOT IN ('UBIGINT', 'NULL'), false)" for f in numbers]
    parts += [f"coalesce(json_type(value, '$.{f}') NOT IN ('UBIGINT', 'BIGINT', 'NULL'), false)"
              for f in ints]
    return "(" + " OR ".join(parts) + ")"


FIELDS = (
    "SELECT *, " + ", ".join([_text(f) for f in _STRINGS] + [_num(f) for f in _NUMBERS])
    + ", CASE WHEN json_type(value, '$.payload_len') IN ('UBIGINT', 'BIGINT') THEN "
      "CAST(json_extract_string(value, '$.payload_len') AS BIGINT) END AS j_payload_len, "
    + _wrong(_STRINGS[:5], _NUMBERS[:2], ["payload_len"]) + " AS storage_wrong, "
    + _wrong(_STRINGS, _NUMBERS, ["payload_len", "qos", "received_at_ms"])
    + " AS registry_wrong FROM fx_envelopes")


def lenient(x):
    t = f"lower(trim({x}))"
    c = f"replace(replace({t}, ':', ''), '-', '')"
    return f"CASE WHEN regexp_full_match({c}, '[0-9a-f]{{12}}') THEN {colon(c)} ELSE {t} END"


def compact(x):
    c = f"lower(regexp_replace({x}, '[:\\-\\s]', '', 'g'))"
    return f"CASE WHEN regexp_full_match({c}, '[0-9a-f]{{12}}') THEN {c} ELSE '' END"


TOPIC_MAC_OF = "regexp_extract({0}, '(?:^|/)devices/([^/]+)/telemetry$', 1)"
_TOPIC_MAC = "regexp_extract(j_topic, '(?:^|/)devices/([^/]+)/telemetry$', 1)"


def topic_prefix_mac(topic):
    after = f"substr({topic}, strpos({topic}, '/devices/') + 9)"
    return (f"CASE WHEN strpos({topic}, '/devices/') > 0 AND strpos({after}, '/') > 0 AND "
            f"starts_with(substr({after}, strpos({after}, '/')), '/telemetry') "
            f"THEN split_part({after}, '/', 1) ELSE '' END")


_TOPIC_PREFIX_MAC = topic_prefix_mac("j_topic")

STORAGE = f"""
SELECT "partition", "offset", key, value, arrival_ms, storage_wrong, j_schema, j_payload_len,
  coalesce(nullif(j_timestamp_ms, 0), nullif(j_timestamp, 0), arrival_ms) AS raw_ts,
  coalesce(nullif({lenient('j_mac_addr')}, ''), nullif({lenient('j_mac_hex')}, ''),
           nullif({lenient(_TOPIC_MAC)}, '')) AS mac_addr,
  CASE WHEN regexp_full_match(trim(j_payload_base64), '[A-Za-z0-9+/]*={{0,2}}')
            AND length(trim(j_payload_base64)) % 4 = 0
       THEN TRY(from_base64(trim(j_payload_base64))) END AS payload
FROM fields"""

STORAGE_CHECKED = """
SELECT "partition", "offset", key, value, arrival_ms, mac_addr, payload,
  CASE WHEN raw_ts <= 9223372036854775807 THEN CAST(raw_ts AS BIGINT) END AS timestamp_ms,
  CASE WHEN raw_ts <= 9223372036854775807
       THEN CAST(least(raw_ts, 9223372036854775) AS BIGINT) * 1000 END AS event_us,
  make_timestamp(arrival_ms * 1000) AS created_at,
  CASE WHEN storage_wrong THEN 'bad_json'
       WHEN j_schema NOT IN ('', 'iota.edge.raw.v1') THEN 'bad_schema'
       WHEN raw_ts > 9223372036854775807 THEN 'timestamp_overflow'
       WHEN mac_addr IS NULL THEN 'missing_mac'
       WHEN payload IS NULL THEN 'bad_payload'
       WHEN j_payload_len < 0 THEN 'negative_payload_len'
       WHEN j_payload_len <> octet_length(payload) THEN 'payload_len_mismatch' END AS error
FROM storage_raw"""

REGISTRY = f"""
SELECT *, CASE WHEN error1 IS NULL AND regexp_full_match(compact, '[0-9a-f]{{12}}')
               THEN {colon('compact')} END AS mac_addr
FROM (
  SELECT *, replace(replace(replace(lower(device), ':', ''), '-', ''), '.', '') AS compact,
    CASE WHEN registry_wrong THEN 'bad_json'
         WHEN j_schema NOT IN ('', 'iota.edge.raw.v1') THEN 'bad_schema'
         WHEN raw_ts > 9223372036854775807 THEN 'timestamp_overflow'
         WHEN device IS NULL THEN 'missing_mac' END AS error1,
    CASE WHEN raw_ts <= 9223372036854775807 THEN CAST(raw_ts AS BIGINT) END AS "timestamp"
  FROM (
    SELECT "partition", "offset", key, arrival_ms, registry_wrong, j_schema,
      coalesce(nullif(j_timestamp_ms, 0), nullif(j_timestamp, 0), arrival_ms) AS raw_ts,
      coalesce(nullif(j_mac_addr, ''), nullif(j_mac_hex, ''), nullif({_TOPIC_MAC}, '')) AS device
    FROM fields))"""

RELAY = f"""
SELECT *, j_schema IN ('', 'iota.edge.raw.v1') AND mac_hex IS NOT NULL AS accepted
FROM (
  SELECT "partition", "offset", key, value, arrival_ms, j_schema,
    coalesce(nullif({compact('j_mac_hex')}, ''), nullif({compact('j_mac_addr')}, ''),
             nullif({compact(_TOPIC_PREFIX_MAC)}, '')) AS mac_hex,
    coalesce(nullif(j_timestamp_ms, 0), nullif(j_timestamp, 0), 0) AS timestamp_ms,
    j_stream_id AS stream_id, j_payload_base64 AS payload_base64,
    greatest(coalesce(j_payload_len, 0), 0) AS payload_len, j_origin AS origin,
    coalesce(nullif(j_message_id, ''), nullif(j_mqtt_message_id, ''), '') AS message_id
  FROM fields)"""

PRESENCE = "SELECT mac12, ts_ms, event_id FROM ev"

STREAM_ID = "((user_id % 10) + 1) * 4294967296 + user_id + 1"

FRAMES = f"""
SELECT {STREAM_ID} AS stream_id, event_id,
  unhex(substr(mac12 || {hexn('ts_ms', 16)}
    || {hexn("octet_length(encode(props)) + CASE WHEN event_id % 11 = 0 THEN 1 ELSE 0 END", 8)}
    || hex(encode(props)), 1, CASE WHEN event_id % 13 = 0 THEN 20 ELSE 2147483647 END)) AS frame
FROM ev"""

TUNNEL = f"""
SELECT event_id AS id, unhex('4950545001' || {hexn('1 + event_id % 8', 2)}
    || CASE WHEN event_id % 17 = 0 THEN '0001' ELSE '0000' END
    || {hexn('CASE WHEN event_id % 19 = 0 THEN 0 ELSE user_id + 1 END', 16)}
    || {hexn('octet_length(encode(props))', 8)} || hex(encode(props))) AS packet
FROM ev"""

GOSSIP = f"""
SELECT event_id AS id, CASE WHEN event_id % 3 = 0 THEN encode(props) ELSE
  unhex('4950474201' || {hexn('event_id % 6', 2)} || '0000'
    || {hexn('CASE WHEN event_id % 29 = 0 THEN 0 ELSE user_id + 1 END', 64)}
    || {hexn('event_id // 4 + 1', 64)} || {hexn('octet_length(encode(props))', 8)}
    || hex(encode(props))) END AS payload
FROM ev"""

ARRIVALS = f"""
SELECT CASE event_id % 3 WHEN 0 THEN 'control' WHEN 1 THEN 'replicate' ELSE 'kafka_broadcast' END
    AS type, user_id % 2 + 1 AS stream_id, lower({hexn('user_id % 5 + 1', 64)}) AS origin,
  lower({hexn('user_id // 10 + 1', 64)}) AS message_id, CAST(event_id % 6 AS INTEGER) AS ttl,
  ts_ms, event_id AS seq
FROM ev"""

MQTT = f"""
SELECT 'iota/node-' || (user_id % 4) || CASE WHEN event_id % 7 = 0 THEN '/extra' ELSE '' END
    || '/devices/' || {colon('mac12', '-')}
    || CASE WHEN event_id % 9 = 0 THEN '/status' ELSE '/telemetry' END AS topic,
  'c' || user_id AS clientid, 'u' || (user_id % 7) AS username,
  CAST(event_id % 3 AS INTEGER) AS qos, ts_ms AS "timestamp", 'q' || event_id AS id,
  encode(props) AS payload
FROM ev"""

PACKETS = """
SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT),
    CAST(round(l_extendedprice * 100) AS BIGINT), strftime(l_shipdate, '%Y%m%d')) AS packet_id,
  l_linenumber % 3 AS chain, '10.0.0.' || (l_suppkey % 8) AS src,
  '10.1.0.' || (l_partkey % 8) AS dst, CAST(1024 + l_partkey % 5 AS INTEGER) AS sport,
  [22, 80, 443, 53][l_suppkey % 4 + 1] AS dport, [6, 17, 1, 2, 50][l_partkey % 5 + 1] AS protocol,
  CAST(CAST(l_quantity AS BIGINT) % 2 AS INTEGER) AS syn,
  CAST((CAST(l_quantity AS BIGINT) // 2) % 2 AS INTEGER) AS ack, 0 AS fin, 0 AS rst,
  CASE WHEN l_linenumber % 2 = 0 THEN 8 ELSE 0 END AS type, 0 AS code,
  'eth' || (l_suppkey % 2) AS in_if, 'eth' || (l_partkey % 2) AS out_if,
  CASE WHEN l_partkey % 97 = 0 THEN 4 ELSE 5 END AS hdr_words, l_shipdate AS ts
FROM lineitem"""


def _literal(v):
    if isinstance(v, bool):
        return "true" if v else "false"
    return f"'{v}'" if isinstance(v, str) else str(v)


RULES_SQL = ("SELECT * FROM (VALUES "
             + ", ".join("(" + ", ".join(_literal(v) for v in r) + ")" for r in RULES)
             + ") AS r(chain, rule_no, action, src, dst, sport, dport, protocol, ifname, extra, "
               "syn, ack, fin, rst, type, code)")

ROUTES = f"""
SELECT owner, k, {node('k')} AS node,
  CASE WHEN prev_k IS NULL THEN NULL ELSE {node('prev_k')} END AS source,
  CASE WHEN k % 5 = 0 THEN NULL ELSE {{
    'accepting_ingress': k % 11 <> 0, 'max_kcp_links': 512::BIGINT,
    'current_kcp_links': (k * 3) % 520,
    'max_ingress_streams': CASE WHEN k % 9 = 0 THEN 0::UBIGINT
      WHEN k % 13 = 0 THEN 18446744073709551615::UBIGINT ELSE 4096::UBIGINT END,
    'current_ingress_streams': (k * 17) % 4200,
    'max_ingress_bytes_per_second': CASE WHEN k % 4 = 1 THEN 0::BIGINT ELSE 1048576::BIGINT END,
    'current_ingress_bytes_per_second': (k * 997) % 1100000,
    'updated_at_ms': {A} - (k % 240) * 1000}} END AS capability,
  CASE WHEN k % 7 = 3 THEN 'bad' WHEN k % 7 < 3 THEN 'new' ELSE 'tried' END AS state,
  CAST(k % 12 AS INTEGER) AS attempts, CAST((k * 5) % 14 AS INTEGER) AS failures,
  CAST(k % 10 AS INTEGER) AS hop_count,
  CASE WHEN k % 53 = 0 THEN {A} + 1200000 ELSE {A} - (k * 7919 % 4000000) * 1000 END
    AS last_seen_ms,
  CASE WHEN k % 3 = 0 THEN 0 ELSE {A} - (k * 131 % 2000) * 1000 END AS last_try_ms,
  CASE WHEN k % 4 = 0 THEN 0 ELSE {A} - (k * 6007 % 1500000) * 1000 END AS last_success_ms,
  k % 6 = 0 AS kcp_connected
FROM (SELECT c_custkey AS k, 'n' || c_nationkey AS owner,
        lag(c_custkey) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS prev_k
      FROM customer)"""

ADVERTS = f"""
SELECT 'n' || (user_id % 25) AS owner, {node('user_id + 1')} AS node,
  CASE WHEN event_id % 4 = 0 THEN NULL ELSE {node('event_id % 50 + 1')} END AS source,
  CAST(event_id % 10 AS INTEGER) AS advertised_hops,
  CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_id % 4096 END AS current_streams,
  event_id % 7 = 0 AS connected, ts_ms, event_id AS seq
FROM ev"""

ROUTE_EVENTS = """
SELECT 'n' || (user_id % 25) AS owner, user_id AS node,
  CASE event_type WHEN 'signup' THEN 'advert' WHEN 'click' THEN 'attempt'
    WHEN 'view' THEN 'success' WHEN 'error' THEN 'failure' ELSE 'disconnect' END AS kind,
  event_type = 'view' AND event_id % 2 = 0 AS connected, ts_ms, event_id AS seq
FROM ev"""

FLEET_LOG = """
SELECT a.*, a.node.id AS node_id, CASE WHEN event_id % 3 = 0 OR event_type = 'signup' THEN 'advert'
    WHEN event_type = 'click' THEN 'attempt' WHEN event_type = 'view' THEN 'success'
    WHEN event_type = 'error' THEN 'failure' ELSE 'disconnect' END AS kind,
  CAST(CASE WHEN connected THEN 1 WHEN source IS NULL THEN advertised_hops ELSE advertised_hops + 1 END
    AS INTEGER) AS hops
FROM fx_adverts a JOIN ev ON event_id = seq"""

INGRESS = f"""
SELECT user_id % 10 AS node, (user_id % 10) * 4294967296 + user_id + 1 AS stream_id,
  CASE event_type WHEN 'signup' THEN 'Connected' WHEN 'purchase' THEN 'Closed' ELSE 'Data' END
    AS kind,
  CAST(round(value * 20) AS INTEGER) AS bytes, (ts_ms - {A}) // 10000 AS t_ms, event_id AS seq
FROM ev"""

LINKS = """
SELECT DISTINCT s AS a, b FROM (
  SELECT s, (7 * s + 3) % n AS b FROM (SELECT s_suppkey AS s, count(*) OVER () AS n FROM supplier)
  UNION ALL
  SELECT s, (11 * s + 5) % n AS b FROM (SELECT s_suppkey AS s, count(*) OVER () AS n FROM supplier))
WHERE s <> b"""

ORIGINS = "SELECT s_suppkey AS origin FROM supplier"

PEERS = f"""
SELECT lower({hexn('s_suppkey + 1', 64)}) AS peer_id,
  '10.2.' || (s_suppkey % 256) || '.' || s_nationkey AS addr,
  CAST(9000 + s_suppkey % 1000 AS INTEGER) AS port
FROM supplier"""

HELLOS = f"""
SELECT c_custkey AS k, CASE WHEN c_custkey % 10 = 1 THEN 'bye' ELSE 'hello' END AS type,
  CASE WHEN c_custkey % 10 = 2 THEN 2 ELSE 1 END AS version,
  CASE WHEN c_custkey % 10 = 3 THEN 'other' ELSE 'self' END AS target,
  CASE WHEN c_custkey % 17 = 0 THEN '' ELSE 'h' || c_custkey END AS host,
  c_custkey % 70000 AS port, lower({hexn('c_custkey', 64)}) AS id,
  {A} + (c_custkey % 25 - 12) * 60000 AS ts_ms,
  repeat('ab', CASE WHEN c_custkey % 10 = 4 THEN 30 ELSE 32 END) AS nonce,
  repeat('cd', 64) AS signature, {A} AS now_ms
FROM customer"""

NAMES = f"""
SELECT event_id, mac12,
  CASE event_id % 7 WHEN 0 THEN '  ' || upper({colon('mac12')}) || ' '
    WHEN 1 THEN {colon('mac12', '-')} WHEN 2 THEN mac12
    WHEN 3 THEN substr(mac12, 1, 4) || '.' || substr(mac12, 5, 4) || '.' || substr(mac12, 9)
    WHEN 4 THEN 'Device-' || user_id WHEN 5 THEN ''
    ELSE substr(mac12, 1, 6) || ' ' || substr(mac12, 7) END AS mac,
  CASE event_id % 5 WHEN 0 THEN {TOPIC} WHEN 1 THEN {TOPIC} || '/extra'
    WHEN 2 THEN 'devices/' || mac12 || '/telemetry'
    WHEN 3 THEN '/devices/a/b/devices/' || mac12 || '/telemetry' ELSE '' END AS topic
FROM ev"""

CTES = {
    "fx_names": NAMES,
    "ev": EV, "fx_envelopes": ENVELOPES, "fields": FIELDS, "storage_raw": STORAGE,
    "storage": STORAGE_CHECKED, "registry": REGISTRY, "relay": RELAY, "fx_presence": PRESENCE,
    "fx_frames": FRAMES, "fx_tunnel": TUNNEL, "fx_gossip": GOSSIP, "fx_arrivals": ARRIVALS,
    "fx_mqtt": MQTT, "fx_packets": PACKETS, "fx_rules": RULES_SQL, "fx_routes": ROUTES,
    "fx_adverts": ADVERTS, "fx_route_events": ROUTE_EVENTS, "fx_fleet_log": FLEET_LOG, "fx_ingress": INGRESS,
    "fx_readings": READINGS, "fx_links": LINKS, "fx_origins": ORIGINS, "fx_peers": PEERS, "fx_hellos": HELLOS,
}


def with_inputs(sql: str, recursive: bool = False, extra: dict[str, str] | None = None) -> str:
    """Prefix ``sql`` with the common table expressions it names, and those they name."""
    known = {**CTES, **(extra or {})}

    def named(text):
        return [n for n in known if re.search(rf"\b{n}\b", text)]

    needed: list[str] = []

    def visit(name):
        if name in needed:
            return
        for other in named(known[name]):
            if other != name:
                visit(other)
        needed.append(name)

    for name in named(sql):
        visit(name)
    if not needed:
        return sql
    body = ",\n".join(f"{n} AS MATERIALIZED ({known[n]})" if n == "fx_envelopes"
                      else f"{n} AS ({known[n]})" for n in needed)
    return f"WITH {'RECURSIVE ' if recursive else ''}{body}\n{sql}"

"""Queries over presence, idle sessions, duplicates and keyed state."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge import fixtures as X
from tidegauge import schema as S
from tidegauge.operators import envelopes as E
from tidegauge.operators import gossip as G
from tidegauge.operators import presence as P
from tidegauge.queries.catalog import register
from tidegauge.queries.registry_queries import POSITION
from tidegauge.sources.tables import round_trip

TTL = X.PRESENCE_TTL_MS


def sessions_sql(keys: str, ms: str, source: str, ttl: int) -> str:
    return f"""SELECT {keys}, min({ms}) AS start_ms, max({ms}) AS last_ms, count(*) AS events,
        max({ms}) + {ttl} AS end_ms
      FROM (SELECT *, sum(fresh) OVER (PARTITION BY {keys} ORDER BY {ms}
                                       RANGE UNBOUNDED PRECEDING) AS session
            FROM (SELECT *, CASE WHEN {ms} - lag({ms}) OVER (PARTITION BY {keys} ORDER BY {ms})
                                      < {ttl} THEN 0 ELSE 1 END AS fresh FROM {source}))
      GROUP BY {keys}, session"""


@register(sessions_sql("mac12", "ts_ms", "fx_presence", TTL))
def presence_sessions(spark, d):
    return P.presence_sessions(X.presence(spark, d), "mac12", "ts_ms", TTL)


IDLE_KEYS = "peer_ip, peer_port, conv"
IDLE = f"""SELECT '10.3.0.' || (user_id % 250) AS peer_ip, CAST(9000 + user_id % 7 AS INTEGER)
             AS peer_port, user_id AS conv, ts_ms FROM ev"""


def peer_traffic(spark, d):
    return X._events(spark, d).select(
        F.expr("concat('10.3.0.', user_id % 250)").alias("peer_ip"),
        F.expr("cast(9000 + user_id % 7 AS int)").alias("peer_port"),
        F.col("user_id").alias("conv"), "ts_ms")


@register(sessions_sql(IDLE_KEYS, "ts_ms", "fx_idle", 6 * 3600 * 1000), extra={"fx_idle": IDLE})
def idle_sessions(spark, d):
    return P.idle_sessions(peer_traffic(spark, d), "ts_ms", 6 * 3600 * 1000)


@register(f"""SELECT {IDLE_KEYS}, min(ts_ms) AS start_ms, max(ts_ms) AS last_ms, count(*) AS events,
              CAST(NULL AS BIGINT) AS end_ms FROM fx_idle GROUP BY {IDLE_KEYS}""",
          extra={"fx_idle": IDLE})
def idle_sessions_never(spark, d):
    return P.idle_sessions(peer_traffic(spark, d), "ts_ms", 0)


GOSSIP_TTL_MS = 48 * 3600 * 1000


@register(f"""SELECT type, stream_id, origin, message_id, ttl, ts_ms, seq FROM (
    SELECT *, lag(ts_ms) OVER (PARTITION BY type, stream_id, origin, message_id ORDER BY ts_ms, seq)
      AS prev FROM fx_arrivals) WHERE prev IS NULL OR ts_ms - prev >= {GOSSIP_TTL_MS}""")
def dedupe_sliding(spark, d):
    return P.dedupe_sliding(X.gossip_arrivals(spark, d), list(G.GOSSIP_KEY), "ts_ms", "seq",
                            GOSSIP_TTL_MS)


def fixed_sql(source: str, key: str, ms: str, seq: str, ttl: int, columns: str) -> str:
    """A walk along each key's rows that remembers the last accepted time."""
    return f"""SELECT {columns} FROM (
      SELECT n.*, w.accepted FROM walk w JOIN numbered n ON n.{key} = w.k AND n.rn = w.rn)
      WHERE accepted UNION ALL SELECT {columns} FROM {source} WHERE coalesce({key}, '') = ''"""


def fixed_ctes(source: str, key: str, ms: str, seq: str, ttl: int) -> dict[str, str]:
    return {
        "numbered": f"""SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {ms}, {seq}) AS rn
                        FROM {source} WHERE {key} <> ''""",
        "walk": f"""SELECT {key} AS k, rn, {ms} AS accepted_ms, true AS accepted FROM numbered
                    WHERE rn = 1 UNION ALL
                    SELECT w.k, n.rn,
                      CASE WHEN n.{ms} >= w.accepted_ms + {ttl} THEN n.{ms} ELSE w.accepted_ms END,
                      n.{ms} >= w.accepted_ms + {ttl}
                    FROM walk w JOIN numbered n ON n.{key} = w.k AND n.rn = w.rn + 1""",
    }


RELAY_IDS = """SELECT message_id, arrival_ms, "partition", "offset", mac_hex FROM relay WHERE accepted"""
# Every third of the rows without an id has a NULL one.
IDS = """SELECT CASE WHEN message_id <> '' OR "offset" % 3 <> 0 THEN message_id END AS message_id,
    arrival_ms, "partition", "offset", mac_hex FROM relay WHERE accepted"""


def relay_ids(spark, d):
    parsed = E.parse_edge_json(X.envelopes(spark, d)).filter("accepted")
    message_id = F.when((F.col("message_id") != "") | (F.col("offset") % 3 != 0), F.col("message_id"))
    return parsed.select(message_id.alias("message_id"), "arrival_ms", "offset", "mac_hex")


@register(fixed_sql("ids", "message_id", "arrival_ms", '"offset"', S.SEEN_TTL_MS,
                    'message_id, arrival_ms, "offset", mac_hex'), recursive=True,
          extra={"ids": IDS,
                 **fixed_ctes("ids", "message_id", "arrival_ms", '"offset"', S.SEEN_TTL_MS)})
def dedupe_fixed(spark, d):
    # The rule reads its input several times: parse the envelopes once, into a table.
    ids = round_trip(relay_ids(spark, d), "relay-ids")
    return P.dedupe_fixed(ids, "message_id", "arrival_ms", "offset")


@register(fixed_sql("fx_presence", "mac12", "ts_ms", "event_id", TTL, "mac12, ts_ms, event_id"),
          recursive=True, extra=fixed_ctes("fx_presence", "mac12", "ts_ms", "event_id", TTL))
def dedupe_fixed_chains(spark, d):
    """Keys that repeat without a pause: every acceptance depends on the one before."""
    return P.dedupe_fixed(X.presence(spark, d), "mac12", "ts_ms", "event_id", TTL)


AS_OF = "(SELECT max(ts_ms) - 3600000 FROM fx_presence)"


@register(f"""SELECT mac12, max(ts_ms) AS last_seen_ms, max(ts_ms) > {AS_OF} - {TTL} AS online
              FROM fx_presence WHERE ts_ms <= {AS_OF} GROUP BY mac12""")
def device_online(spark, d):
    rows = X.presence(spark, d)
    as_of = rows.agg(F.max("ts_ms") - 3_600_000).scalar()
    return P.device_online(rows, "mac12", "ts_ms", as_of, TTL)


STATE = f"""SELECT 'device:' || mac_hex || ':state' AS key, 'online' AS value,
      max(arrival_ms) + 60000 AS expires_at_ms FROM relay WHERE accepted GROUP BY mac_hex
    UNION ALL
    SELECT 'device:' || mac_hex || ':latest', arg_max(value, {POSITION}),
      max(arrival_ms) + 86400000 FROM relay WHERE accepted GROUP BY mac_hex"""


def state_rows(spark, d):
    parsed = E.parse_edge_json(X.envelopes(spark, d)).filter("accepted")
    return P.device_state(parsed, "mac_hex", "value", "arrival_ms")


@register(STATE)
def write_device_state(spark, d):
    """Keyed state rows, written as a table and read back."""
    return round_trip(state_rows(spark, d), "device-state")


@register(f"""SELECT * FROM ({STATE})
              WHERE expires_at_ms > (SELECT max(arrival_ms) - 600000 FROM fx_envelopes)""")
def device_latest(spark, d):
    as_of = X.envelopes(spark, d).agg(F.max("arrival_ms") - 600_000).scalar()
    return P.alive(state_rows(spark, d), as_of)


MIDDLE = "(SELECT max(event_id) // 2 FROM events)"


@register(f"""SELECT message_id, arrival_ms, "offset", mac_hex FROM ids
    WHERE "offset" >= {MIDDLE} AND (coalesce(message_id, '') = '' OR NOT EXISTS (
      SELECT 1 FROM held s WHERE s.message_id = ids.message_id
        AND ids.arrival_ms < s.arrival_ms + {S.SEEN_TTL_MS}))""", recursive=True, extra={
    "ids": IDS, "earlier": f"""SELECT * FROM ids WHERE "offset" < {MIDDLE}""",
    **fixed_ctes("earlier", "message_id", "arrival_ms", '"offset"', S.SEEN_TTL_MS),
    "held": fixed_sql("earlier", "message_id", "arrival_ms", '"offset"', S.SEEN_TTL_MS,
                      "message_id, arrival_ms")})
def drop_seen(spark, d):
    """Messages of the topic's second half whose id the first half still holds are dropped. Repeats
    in the first half do not renew an id: only its accepted rows are held."""
    rows = round_trip(relay_ids(spark, d), "relay-ids")
    middle = X.table(spark, d, "events").agg(F.expr("max(event_id) DIV 2")).scalar()
    earlier = P.dedupe_fixed(rows.filter(F.col("offset") < middle), "message_id", "arrival_ms",
                             "offset")
    seen = earlier.select(
        "message_id", F.col("arrival_ms").alias("seen_ms"))
    return P.drop_seen(rows.filter(F.col("offset") >= middle), seen)

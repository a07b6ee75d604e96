"""Queries over messages passed on through the peer network."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge import fixtures as X
from tidegauge import schema as S
from tidegauge.operators import envelopes as E
from tidegauge.operators import gossip as G
from tidegauge.queries.catalog import register
from tidegauge.streaming import pipelines as L

LOCAL = "0" * 63 + "2"


@register("""SELECT type, stream_id, origin, message_id, count(*) AS arrivals FROM fx_arrivals
             GROUP BY ALL""")
def gossip_key(spark, d):
    keys = G.gossip_key(X.gossip_arrivals(spark, d))
    return keys.groupBy(*G.GOSSIP_KEY).agg(F.count("*").alias("arrivals"))


@register(f"""SELECT type, stream_id, origin, message_id, ttl - 1 AS ttl, ts_ms, seq FROM fx_arrivals
              WHERE origin <> '{LOCAL}' AND type IN ('control', 'replicate') AND ttl > 1""")
def relay_step(spark, d):
    return G.relay_step(X.gossip_arrivals(spark, d), LOCAL)


@register(f"""SELECT seq, CASE WHEN ttl = 0 THEN {S.GOSSIP_TTL} WHEN ttl > 1 THEN ttl - 1 END AS ttl
              FROM fx_arrivals WHERE type = 'kafka_broadcast'""")
def relay_kafka_ttl(spark, d):
    rows = X.gossip_arrivals(spark, d).filter("type = 'kafka_broadcast'")
    return rows.select("seq", G.relay_kafka_ttl(F.col("ttl")).alias("ttl"))


def number(text: str) -> str:
    return f"CAST(('0x' || substr(md5({text}), 1, 15)) AS BIGINT)"


def score_sql(message: str, peer: str) -> str:
    """The integer mix of two numbers."""
    x = f"xor({message}, {peer})"
    s = f"(({x} & {G.MIX['low']}) * {G.MIX['a']} + ({x} >> 30) * {G.MIX['b']} + {G.MIX['c']})"
    return f"(((xor({s}, {s} >> 29) & {G.MIX['high']}) * {G.MIX['d']}) >> 15)"


PEER = number("peer_id || addr || port")
K = S.GOSSIP_FANOUT


def fanout_ctes(messages: str) -> dict[str, str]:
    """``fanout (message_id, peer_id)``: first the groups each message takes, then their peers."""
    group = number("'group-' || grp")
    return {
        "dealt": f"""SELECT peer_id, peer_no, (row_number() OVER (ORDER BY peer_no, peer_id) - 1)
            % CAST(ceil(sqrt((SELECT count(*) FROM fx_peers))) AS BIGINT) AS grp
          FROM (SELECT peer_id, {PEER} AS peer_no FROM fx_peers)""",
        "peer_sets": f"""SELECT grp, count(*) AS size, {group} AS grp_no FROM dealt GROUP BY grp""",
        "ids_out": f"""SELECT DISTINCT message_id, {number('message_id')} AS message_no
          FROM ({messages})""",
        "taken": f"""SELECT message_id, message_no, grp FROM (
            SELECT *, sum(size) OVER (PARTITION BY message_id ORDER BY score, grp
              ROWS UNBOUNDED PRECEDING) - size AS before
            FROM (SELECT *, {score_sql('message_no', 'grp_no')} AS score FROM ids_out, peer_sets))
          WHERE before < {K}""",
        "fanout": f"""SELECT message_id, peer_id FROM (
            SELECT message_id, peer_id, row_number() OVER (PARTITION BY message_id
              ORDER BY {score_sql('message_no', 'peer_no')}, peer_id) AS place
            FROM taken JOIN dealt USING (grp))
          WHERE place <= {K} AND message_id <> '' AND (SELECT count(*) FROM fx_peers) > {K}
          UNION ALL SELECT message_id, peer_id FROM ids_out, fx_peers
          WHERE message_id = '' OR (SELECT count(*) FROM fx_peers) <= {K}""",
    }


FANOUT = "SELECT message_id, peer_id FROM fanout"


def whole_fanout_ctes(messages: str) -> dict[str, str]:
    """``fanout (message_id, peer_id)``: the lowest of all peers."""
    return {
        "ids_out": f"""SELECT DISTINCT message_id, {number('message_id')} AS message_no
          FROM ({messages})""",
        "fanout": f"""SELECT message_id, peer_id FROM (
            SELECT message_id, peer_id, row_number() OVER (PARTITION BY message_id
              ORDER BY {score_sql('message_no', 'peer_no')}, peer_id) AS place
            FROM ids_out, (SELECT peer_id, {PEER} AS peer_no FROM fx_peers))
          WHERE place <= {K} AND message_id <> '' AND (SELECT count(*) FROM fx_peers) > {K}
          UNION ALL SELECT message_id, peer_id FROM ids_out, fx_peers
          WHERE message_id = '' OR (SELECT count(*) FROM fx_peers) <= {K}""",
    }


def messages(spark, d):
    parsed = E.parse_edge_json(X.envelopes(spark, d)).filter("accepted")
    return parsed.select("message_id").distinct()


@register(FANOUT, extra=whole_fanout_ctes("SELECT message_id FROM relay WHERE accepted"))
def rendezvous_fanout(spark, d):
    """Every message is ranked against every peer."""
    return G.rendezvous_fanout(messages(spark, d), X.peers(spark, d), grouped=False)


def inbound_ctes(ttl_ms: int) -> dict[str, str]:
    heard = f"""SELECT seq, type, stream_id, ts_ms,
        CASE WHEN seq % 11 = 0 THEN '{LOCAL}' ELSE origin END AS origin,
        CASE WHEN seq % 11 = 0 THEN 'frame-' || seq ELSE message_id END AS message_id,
        CASE WHEN seq % 11 = 0 THEN 0 ELSE ttl END AS ttl FROM fx_arrivals
      WHERE CASE WHEN seq % 11 = 0 THEN type = 'kafka_broadcast'
                 ELSE seq % 13 <> 0 AND origin <> '{LOCAL}' END"""
    going = f"""SELECT seq, type, message_id, CAST(CASE WHEN type <> 'kafka_broadcast' AND ttl <= 1
          THEN NULL WHEN ttl = 0 THEN {S.GOSSIP_TTL} WHEN ttl > 1 THEN ttl - 1 END AS INTEGER) AS ttl
      FROM (SELECT *, lag(ts_ms) OVER (PARTITION BY type, stream_id, origin, message_id
              ORDER BY ts_ms, seq) AS prev FROM heard_frames)
      WHERE prev IS NULL OR ts_ms - prev >= {ttl_ms}"""
    return {"heard_frames": heard, "going": going,
            **fanout_ctes("SELECT message_id FROM going WHERE ttl IS NOT NULL")}


INBOUND_TTL_MS = 48 * 3600 * 1000
INBOUND = """SELECT seq, type, message_id, ttl, peer_id FROM going JOIN fanout USING (message_id)
    WHERE ttl IS NOT NULL"""


@register(INBOUND, extra=inbound_ctes(INBOUND_TTL_MS))
def gossip_inbound(spark, d):
    """Received frames, without own and repeated ones, to the peers they are passed on to."""
    return L.gossip_inbound(X.inbound_packets(spark, d), LOCAL, X.peers(spark, d), INBOUND_TTL_MS)


REACH = f"""SELECT origin, node, min(hops) AS hops FROM reach WHERE node <> origin GROUP BY ALL"""
REACH_CTE = f"""SELECT origin, origin AS node, 0 AS hops FROM fx_origins
    UNION SELECT r.origin, l.b, r.hops + 1 FROM reach r JOIN fx_links l ON l.a = r.node
    WHERE r.hops < {S.GOSSIP_TTL}"""


@register(REACH, recursive=True, extra={"reach": REACH_CTE})
def gossip_reach(spark, d):
    return G.gossip_reach(X.links(spark, d), X.origins(spark, d))


FRAME_BUDGET = 16_000
# Frames that are neither invalid nor our own nor seen before, in the order they arrive; then a walk
# along the byte budget, and one along the ids of the messages it admits.
INBOUND_TOPIC = {
    "arrived": f"""SELECT event_id AS seq, {X.AS_OF_MS} + (ts_ms - {X.AS_OF_MS}) // 100000 AS arrival_ms,
          event_id % 3 AS kind, event_id % 11 = 0 AS plain, (event_id // 6) % 2 + 1 AS stream_id,
          printf('%064x', (event_id // 6) % 5 + 1) AS origin,
          printf('%064x', CASE WHEN event_id % 4 = 0 THEN event_id + 1000000000 ELSE event_id // 6 + 1 END)
            AS gossip_id, event_id % 6 AS hops, r.accepted, r.message_id, r.mac_hex,
          CASE WHEN event_id % 3 <> 2 THEN octet_length(encode(props)) WHEN event_id % 37 = 0 THEN 0
            ELSE octet_length(encode(r.value)) END AS bytes
        FROM ev JOIN relay r ON r."offset" = event_id""",
    "heard_once": f"""SELECT * FROM (
        SELECT *, NOT plain AND lag(seq) OVER (PARTITION BY plain, kind, stream_id, origin, gossip_id
            ORDER BY arrival_ms, seq) IS NOT NULL AS again FROM arrived
        WHERE plain OR seq % 13 <> 0 AND origin <> '{LOCAL}') WHERE NOT again""",
    "asked_bytes": """SELECT *, row_number() OVER (ORDER BY arrival_ms, seq) AS rn FROM heard_once
        WHERE bytes > 0""",
    "spending": f"""SELECT seq, rn, arrival_ms, true AS ok, {FRAME_BUDGET}::DOUBLE - bytes AS tokens
          FROM asked_bytes WHERE rn = 1
        UNION ALL SELECT seq, rn, arrival_ms, have >= bytes,
          CASE WHEN have >= bytes THEN have - bytes ELSE have END
        FROM (SELECT a.*, least({FRAME_BUDGET}::DOUBLE, s.tokens
                + {FRAME_BUDGET}::DOUBLE * (a.arrival_ms - s.arrival_ms)::DOUBLE / 1000.0) AS have
              FROM spending s JOIN asked_bytes a ON a.rn = s.rn + 1)""",
    "topic_frames": """SELECT h.* FROM heard_once h LEFT JOIN spending s USING (seq)
        WHERE kind = 2 AND (bytes = 0 OR s.ok)""",
    "readable": """SELECT seq, arrival_ms, mac_hex, hops, plain, gossip_id,
          CASE WHEN message_id <> '' THEN message_id WHEN plain THEN '' ELSE gossip_id END AS message_id
        FROM topic_frames WHERE bytes > 0 AND accepted""",
}


@register(f"""SELECT seq, mac_hex, message_id, CASE WHEN plain THEN 'frame-' || seq ELSE gossip_id END
      AS frame_id, CAST(CASE WHEN plain OR hops = 0 THEN {S.GOSSIP_TTL} WHEN hops > 1 THEN hops - 1 END
      AS INTEGER) AS ttl FROM (
        SELECT *, min(seq) OVER (PARTITION BY message_id) AS first_seq FROM readable)
      WHERE message_id = '' OR seq = first_seq
    UNION ALL SELECT seq, NULL, '', CASE WHEN plain THEN 'frame-' || seq ELSE gossip_id END,
      CAST(CASE WHEN plain OR hops = 0 THEN {S.GOSSIP_TTL} WHEN hops > 1 THEN hops - 1 END AS INTEGER)
      FROM topic_frames WHERE bytes = 0""", recursive=True, extra=INBOUND_TOPIC)
def inbound_topic(spark, d):
    """Topic messages in frames, within the byte budget, readable and not seen before. The time to
    live is longer than the frames take, so that of each id only the first one counts."""
    found = L.inbound_topic(X.topic_packets(spark, d), LOCAL, INBOUND_TTL_MS, FRAME_BUDGET)
    return found.select("seq", "mac_hex", "message_id", "frame_id", "ttl")

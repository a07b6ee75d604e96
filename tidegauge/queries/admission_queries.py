"""Queries over admission: byte budgets, stream limits, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge import fixtures as X
from tidegauge.operators import admission as A
from tidegauge.operators import fleet as R
from tidegauge.queries.catalog import register
from tidegauge.sources.tables import round_trip

CAPACITY = 1000
MAX_STREAMS = 8
SEGMENT = 50_000

BUCKET = {
    "asked": """SELECT *, row_number() OVER (PARTITION BY node ORDER BY t_ms, seq) AS rn
                FROM fx_ingress WHERE kind = 'Data' AND bytes > 0""",
    "bucket": f"""SELECT node, seq, t_ms, bytes, rn, bytes <= {CAPACITY} AS accepted,
          CASE WHEN bytes <= {CAPACITY} THEN {CAPACITY}::DOUBLE - bytes ELSE {CAPACITY}::DOUBLE END
            AS tokens FROM asked WHERE rn = 1
        UNION ALL
        SELECT node, seq, t_ms, bytes, rn, have >= bytes,
          CASE WHEN have >= bytes THEN have - bytes ELSE have END
        FROM (SELECT a.node, a.seq, a.t_ms, a.bytes, a.rn, least({CAPACITY}::DOUBLE, b.tokens
                + {CAPACITY}::DOUBLE * (a.t_ms - b.t_ms)::DOUBLE / 1000.0) AS have
              FROM bucket b JOIN asked a ON a.node = b.node AND a.rn = b.rn + 1)""",
    "limited": """SELECT node, seq, t_ms, bytes, accepted FROM bucket
        UNION ALL SELECT node, seq, t_ms, bytes, true FROM fx_ingress
        WHERE kind = 'Data' AND bytes = 0""",
    "slots": """SELECT node, t_ms // 1000 AS second,
          CAST(sum(CASE WHEN accepted THEN bytes ELSE 0 END) AS BIGINT) AS bytes
        FROM limited WHERE bytes > 0 GROUP BY 1, 2""",
    "rates": """SELECT *, coalesce(lag(bytes) OVER (PARTITION BY node ORDER BY second), 0)
        AS previous FROM slots""",
}


def limited(spark, d):
    return A.rate_limit_ingress(X.ingress(spark, d), CAPACITY, segment_ms=SEGMENT)


@register("SELECT node, seq, accepted FROM limited", recursive=True, extra=BUCKET)
def rate_limit(spark, d):
    return limited(spark, d).select("node", "seq", "accepted")


@register("""SELECT node, second, bytes, previous, greatest(bytes, previous) AS reported
             FROM rates""", recursive=True, extra=BUCKET)
def bytes_per_second(spark, d):
    return A.bytes_per_second(limited(spark, d))


STEPS = {
    "steps": """SELECT *, CASE WHEN op = 1 AND coalesce(prev, -1) = -1 THEN 1
          WHEN op = -1 AND prev = 1 THEN -1 ELSE 0 END AS delta
        FROM (SELECT *, lag(op) OVER (PARTITION BY node, stream_id ORDER BY seq) AS prev
              FROM (SELECT *, CASE kind WHEN 'Connected' THEN 1 ELSE -1 END AS op
                    FROM fx_ingress WHERE kind <> 'Data'))""",
}


@register("""SELECT node, stream_id, kind, seq, t_ms, CAST(delta AS INTEGER) AS delta,
    CAST(sum(delta) OVER (PARTITION BY node ORDER BY seq) AS BIGINT) AS running FROM steps""",
          extra=STEPS)
def concurrent_streams(spark, d):
    return A.concurrent_streams(X.ingress(spark, d), F.expr(f"t_ms DIV {SEGMENT}"))


@register("""SELECT node, max(running) AS peak, count(*) FILTER (WHERE delta = 1) AS opened FROM (
    SELECT node, delta, CAST(sum(delta) OVER (PARTITION BY node ORDER BY seq) AS BIGINT) AS running
    FROM steps) GROUP BY node""", extra=STEPS)
def peak_streams(spark, d):
    return A.peak_streams(X.ingress(spark, d))


def admit_ctes(source: str) -> dict[str, str]:
    """A walk along each node's connects and closes that carries the list of open streams."""
    opened = "list_contains(w.open, c.stream_id)"
    room = f"len(w.open) < {MAX_STREAMS}"
    return {
        "changes": f"""SELECT *, row_number() OVER (PARTITION BY node ORDER BY seq) AS rn
                       FROM ({source})""",
        "walk": f"""SELECT node, 0::BIGINT AS rn, NULL::BIGINT AS stream_id, NULL::BIGINT AS seq,
              NULL::BIGINT AS t_ms, NULL::VARCHAR AS kind, true AS accepted, []::BIGINT[] AS open
            FROM (SELECT DISTINCT node FROM changes)
            UNION ALL
            SELECT c.node, c.rn, c.stream_id, c.seq, c.t_ms, c.kind,
              c.kind = 'Closed' OR {opened} OR {room},
              CASE WHEN c.kind = 'Closed' THEN list_filter(w.open, lambda x: x <> c.stream_id)
                   WHEN NOT {opened} AND {room} THEN list_append(w.open, c.stream_id)
                   ELSE w.open END
            FROM walk w JOIN changes c ON c.node = w.node AND c.rn = w.rn + 1""",
    }


CHANGES = "SELECT node, stream_id, seq, t_ms, kind FROM fx_ingress WHERE kind <> 'Data'"
REFUSED = CHANGES + """ UNION ALL SELECT i.node, i.stream_id, i.seq, i.t_ms, 'Closed'
    FROM fx_ingress i JOIN limited l USING (node, seq) WHERE NOT l.accepted"""


@register("SELECT node, stream_id, kind, seq, t_ms, accepted FROM walk WHERE rn > 0",
          recursive=True, extra=admit_ctes(CHANGES))
def admit_streams(spark, d):
    return A.admit_streams(X.ingress(spark, d), MAX_STREAMS, F.expr(f"t_ms DIV {SEGMENT}"))


@register("SELECT node, stream_id, kind, seq, t_ms, accepted FROM walk WHERE rn > 0",
          recursive=True, extra={**BUCKET, **admit_ctes(REFUSED)})
def admit_streams_with_budget(spark, d):
    """Data over the byte budget closes its stream."""
    events = X.ingress(spark, d)
    changes = A.close_refused(events, round_trip(limited(spark, d), "limited"))
    return A.admit_streams(changes, MAX_STREAMS, F.expr(f"t_ms DIV {SEGMENT}"))


@register(f"""SELECT l.node, s.streams < {MAX_STREAMS} AND r.links < 512 AS accepting_ingress,
    512::BIGINT AS max_links, r.links AS current_links, {MAX_STREAMS}::BIGINT AS max_streams,
    s.streams AS current_streams, {CAPACITY}::BIGINT AS max_bytes_per_second,
    greatest(l.bytes, l.previous) AS current_bytes_per_second
    FROM (SELECT node, CAST(len(arg_max(open, rn)) AS BIGINT) AS streams FROM walk GROUP BY node) s
    JOIN (SELECT *, max(second) OVER (PARTITION BY node) AS latest FROM rates) l
      ON l.node = s.node AND l.second = l.latest
    JOIN (SELECT owner, count(*) FILTER (WHERE kcp_connected) AS links FROM fx_routes
          WHERE node.id <> repeat('0', 64) GROUP BY owner) r ON r.owner = 'n' || s.node""",
          recursive=True, extra={**BUCKET, **admit_ctes(REFUSED)})
def capability_snapshot(spark, d):
    events, data = X.ingress(spark, d), round_trip(limited(spark, d), "limited")
    admitted = A.admit_streams(A.close_refused(events, data), MAX_STREAMS,
                               F.expr(f"t_ms DIV {SEGMENT}"))
    links = R.route_counts(X.routes(spark, d)).select(
        F.expr("cast(substr(owner, 2) AS bigint)").alias("node"), "links")
    return A.capability_snapshot(admitted, A.bytes_per_second(data), links, MAX_STREAMS,
                                 max_bytes=CAPACITY)

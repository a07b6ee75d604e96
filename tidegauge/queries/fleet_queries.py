"""Queries over route tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge import fixtures as X
from tidegauge import schema as S
from tidegauge.operators import bounded_routes as BR
from tidegauge.operators import fleet as R
from tidegauge.queries.catalog import register
from tidegauge.sources import routes as SR

A = X.AS_OF_MS
DAY = 86_400_000
ZERO = "0" * 64

HEALTH = f"""SELECT *, node.id AS node_id,
  CASE WHEN last_try_ms <> 0 AND last_try_ms >= {A} - 60000 THEN false
       WHEN last_seen_ms > {A} + 600000 THEN true
       WHEN last_seen_ms = 0 OR last_seen_ms < {A} - {30 * DAY} THEN true
       WHEN last_success_ms = 0 AND attempts >= 3 THEN true
       WHEN last_success_ms <> 0 AND last_success_ms < {A} - {7 * DAY} AND failures >= 10 THEN true
       ELSE false END AS terrible,
  last_try_ms <> 0 AND last_try_ms > {A} - 60000 AS backoff,
  (CASE WHEN last_try_ms <> 0 AND last_try_ms > {A} - 600000 THEN 0.01::DOUBLE ELSE 1.0::DOUBLE END)
    * pow(0.66::DOUBLE, least(attempts, 8)::DOUBLE)
    * (CASE state WHEN 'tried' THEN 1.25::DOUBLE WHEN 'bad' THEN 0.05::DOUBLE ELSE 1.0::DOUBLE END)
    AS chance,
  CASE WHEN capability IS NULL THEN 1.0::DOUBLE
       WHEN NOT capability.accepting_ingress THEN 0.0
       WHEN capability.updated_at_ms <> 0 AND capability.updated_at_ms < {A} - 120000 THEN 0.5
       WHEN capability.current_kcp_links >= capability.max_kcp_links
            AND capability.max_kcp_links <> 0 THEN 0.0
       WHEN capability.current_ingress_streams >= capability.max_ingress_streams
            AND capability.max_ingress_streams <> 0 THEN 0.0
       WHEN capability.current_ingress_bytes_per_second >= capability.max_ingress_bytes_per_second
            AND capability.max_ingress_bytes_per_second <> 0 THEN 0.0
       ELSE 0.1::DOUBLE + 0.9::DOUBLE * (1.0::DOUBLE - greatest(
         coalesce(capability.current_kcp_links::DOUBLE
                  / nullif(capability.max_kcp_links, 0)::DOUBLE, 0),
         coalesce(capability.current_ingress_streams::DOUBLE
                  / nullif(capability.max_ingress_streams, 0)::DOUBLE, 0),
         coalesce(capability.current_ingress_bytes_per_second::DOUBLE
                  / nullif(capability.max_ingress_bytes_per_second, 0)::DOUBLE, 0))) END AS cap_score
  FROM fx_routes"""
SCORED = f"""SELECT *, chance * cap_score / CASE WHEN hop_count > 1 THEN hop_count ELSE 1 END AS score
  FROM health"""
VALID = f"SELECT * FROM scored WHERE node_id <> '{ZERO}' AND node.host <> ''"
MORE = {"health": HEALTH, "scored": SCORED, "valid": VALID}


def routes(spark, d):
    return X.routes(spark, d)


def _expression(name, column, sql):
    """One derived column over all routes."""
    def query(spark, d):
        return routes(spark, d).select("owner", F.col("node.id").alias("node_id"),
                                       column().alias(name))

    query.__name__ = name
    return register(f"SELECT owner, node_id, {sql} AS {name} FROM scored", extra=MORE)(query)


is_terrible = _expression("is_terrible", lambda: R.is_terrible(A), "terrible")
in_retry_backoff = _expression("in_retry_backoff", lambda: R.in_retry_backoff(A), "backoff")
route_chance = _expression("route_chance", lambda: F.round(R.route_chance(A), 12),
                           "round(chance, 12)")
capability_score = _expression("capability_score", lambda: F.round(R.capability_score(A), 12),
                               "round(cap_score, 12)")
route_score = _expression("route_score", lambda: F.round(R.route_score(A), 12), "round(score, 12)")
route_state = _expression(
    "route_state",
    lambda: R.route_state(F.when(F.col("attempts") % 4 == 0, "odd").otherwise(F.col("state"))),
    "CASE WHEN attempts % 4 = 0 THEN 'new' ELSE state END")


@register("""SELECT owner, node.id AS node_id, seq, CAST(CASE WHEN seq % 6 = 0 THEN 1
    WHEN source IS NOT NULL THEN advertised_hops + 1 ELSE advertised_hops END AS INTEGER) AS hops
    FROM fx_adverts WHERE CASE WHEN seq % 6 = 0 THEN 1 WHEN source IS NOT NULL
      THEN advertised_hops + 1 ELSE advertised_hops END <= 8""")
def local_hops(spark, d):
    hops = R.local_hops(R.node_valid(F.col("source")), F.col("seq") % 6 == 0,
                        F.col("advertised_hops"))
    return X.adverts(spark, d).select("owner", F.col("node.id").alias("node_id"), "seq",
                                      hops.alias("hops")).filter(F.col("hops") <= S.MAX_ROUTE_HOPS)


CAP_FIELDS = [f.name for f in S.CAPABILITY.fields]


@register("""SELECT owner, node.id AS node_id, CASE WHEN capability IS NOT NULL
    THEN to_json(capability)::VARCHAR END AS json FROM fx_routes""")
def capability_json(spark, d):
    return routes(spark, d).select("owner", F.col("node.id").alias("node_id"),
                                   R.capability_json(F.col("capability")).alias("json"))


@register("""SELECT k, present, CASE WHEN present THEN accepting END AS accepting_ingress,
    CASE WHEN present THEN CASE WHEN k % 3 = 0 THEN 0 ELSE k END END::VARCHAR AS max_kcp_links,
    CASE WHEN present THEN CASE k % 5 WHEN 0 THEN '18446744073709551615' WHEN 1
      THEN '9223372036854775808' ELSE '0' END END AS current_kcp_links,
    CASE WHEN present THEN -k END AS updated_at_ms FROM (
      SELECT c_custkey AS k, c_custkey % 4 <> 0 AS present,
        CASE WHEN c_custkey % 2 = 0 THEN false ELSE true END AS accepting FROM customer)""")
def parse_capability(spark, d):
    """Reports that are absent, lack fields or hold negative, fractional, quoted or large numbers."""
    text = F.expr("""CASE WHEN k % 8 = 0 THEN '[]' WHEN k % 4 = 0 THEN NULL
        ELSE concat('{', if(k % 2 = 0, '"accepting_ingress":false,', ''),
                    '"max_kcp_links":', if(k % 3 = 0, -k, k), ',"updated_at_ms":', -k,
                    ',"current_kcp_links":', CASE k % 5 WHEN 0 THEN '18446744073709551615'
                      WHEN 1 THEN '9223372036854775808' WHEN 2 THEN '18446744073709551616'
                      WHEN 3 THEN '"7"' ELSE '1.5' END, '}') END""")
    rows = X.table(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    report = rows.withColumn("c", R.parse_capability(text))
    return report.select("k", F.col("c").isNotNull().alias("present"), "c.accepting_ingress",
                         F.col("c.max_kcp_links").cast("string").alias("max_kcp_links"),
                         F.col("c.current_kcp_links").cast("string").alias("current_kcp_links"),
                         "c.updated_at_ms")


def best_sql(where: str) -> str:
    return f"""SELECT owner, node_id, round(score, 12) AS score FROM (
      SELECT *, row_number() OVER (PARTITION BY owner ORDER BY score DESC, node_id) AS n
      FROM valid WHERE score > 0 AND {where}) WHERE n = 1"""


def _scored(df):
    return df.select("owner", F.col("node.id").alias("node_id"), F.round("score", 12).alias("score"))


@register(best_sql("NOT kcp_connected AND state <> 'bad' AND NOT terrible AND NOT backoff"), extra=MORE)
def pick_probe(spark, d):
    return _scored(R.pick_probe(routes(spark, d), A))


@register(best_sql("kcp_connected AND state <> 'bad'"), extra=MORE)
def pick_default_hop(spark, d):
    return _scored(R.pick_default_hop(routes(spark, d), A))


@register(f"""SELECT owner, node_id FROM (
    SELECT owner, node_id, count(*) OVER (PARTITION BY owner) AS n,
      row_number() OVER (PARTITION BY owner ORDER BY md5('s1' || node_id)) AS place
    FROM valid WHERE NOT terrible AND state <> 'bad')
    WHERE place <= greatest(1, least(2500, (n * 23 + 99) // 100))""", extra=MORE)
def sample_routes(spark, d):
    return R.sample_routes(routes(spark, d), A, salt="s1").select(
        "owner", F.col("node.id").alias("node_id"))


@register("""SELECT owner, node_id, row_number() OVER (PARTITION BY owner
    ORDER BY CASE state WHEN 'tried' THEN 0 ELSE 1 END, last_success_ms DESC, node_id) AS place
    FROM valid WHERE NOT kcp_connected AND state <> 'bad'""", extra=MORE)
def reconnect_order(spark, d):
    return R.reconnect_order(routes(spark, d)).select(
        "owner", F.col("node.id").alias("node_id"), "place")


TABLE_LIMIT = 50


@register(f"""SELECT owner, node_id FROM (
    SELECT *, row_number() OVER (PARTITION BY owner ORDER BY kcp_connected, weight, node_id) AS place,
      count(*) OVER (PARTITION BY owner) AS kept
    FROM (SELECT *, count(*) OVER (PARTITION BY owner) AS n,
            score * CASE state WHEN 'bad' THEN 0.01::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM valid)
    WHERE n < {TABLE_LIMIT} OR kcp_connected OR NOT terrible)
    WHERE n < {TABLE_LIMIT} OR kept < {TABLE_LIMIT} OR kcp_connected OR place > 1""", extra=MORE)
def trim_routes(spark, d):
    return R.trim_routes(routes(spark, d), A, TABLE_LIMIT).select(
        "owner", F.col("node.id").alias("node_id"))


@register("""SELECT owner, count(*) AS routes, count(*) FILTER (WHERE kcp_connected) AS links,
    count(*) FILTER (WHERE kcp_connected) < 512 AS can_add_link FROM valid GROUP BY owner""", extra=MORE)
def route_counts(spark, d):
    return R.route_counts(routes(spark, d))


@register("""SELECT t.owner, t.node_id AS target_id,
    CASE WHEN t.state = 'bad' THEN NULL WHEN t.kcp_connected THEN t.node_id ELSE s.node_id END
      AS next_hop_id,
    CASE WHEN t.state = 'bad' THEN NULL WHEN t.kcp_connected THEN true
      WHEN s.node_id IS NOT NULL THEN false END AS direct,
    CASE WHEN t.state = 'bad' THEN NULL WHEN t.kcp_connected THEN 1
      WHEN s.node_id IS NOT NULL THEN t.hop_count END AS hop_count
    FROM valid t LEFT JOIN valid s ON s.owner = t.owner AND s.node_id = t.source.id
      AND s.kcp_connected AND s.state <> 'bad'""", extra=MORE)
def resolve_next_hop(spark, d):
    return R.resolve_next_hop(routes(spark, d))


# A walk along the adverts of each (owner, node) that keeps the path and whether a link exists.
PATHS = {
    "heard": """SELECT *, row_number() OVER (PARTITION BY owner, node_id ORDER BY seq) AS rn FROM (
        SELECT *, node.id AS node_id, CAST(CASE WHEN connected THEN 1 WHEN source IS NULL
          THEN advertised_hops ELSE advertised_hops + 1 END AS INTEGER) AS hops FROM fx_adverts)
        WHERE hops <= 8""",
    "path": """SELECT owner, node_id, rn, hops AS hop_count, source.id AS source_id,
          connected AS linked FROM heard WHERE rn = 1
        UNION ALL
        SELECT p.owner, p.node_id, h.rn,
          CASE WHEN h.connected THEN 1
               WHEN h.source IS NOT NULL AND NOT p.linked
                    AND (p.hop_count = 0 OR h.hops < p.hop_count) THEN h.hops ELSE p.hop_count END,
          CASE WHEN h.connected THEN NULL
               WHEN h.source IS NOT NULL AND NOT p.linked
                    AND (p.hop_count = 0 OR h.hops < p.hop_count) THEN h.source.id
               ELSE p.source_id END,
          p.linked OR h.connected
        FROM path p JOIN heard h ON h.owner = p.owner AND h.node_id = p.node_id AND h.rn = p.rn + 1""",
}


@register("""SELECT l.owner, l.node_id, last.node.host AS host, last.node.port AS port,
    last.ts_ms AS last_seen_ms, current_streams, hop_count, source_id
    FROM (SELECT owner, node_id, max(rn) AS rn, arg_max({'node': node, 'ts_ms': ts_ms}, seq) AS last,
            arg_max(current_streams, seq) FILTER (WHERE current_streams IS NOT NULL)
              AS current_streams FROM heard GROUP BY owner, node_id) l
    JOIN path USING (owner, node_id, rn)""", recursive=True, extra=PATHS)
def merge_routes(spark, d):
    merged = R.merge_routes(X.adverts(spark, d))
    return merged.select("owner", "node_id", "node.host", "node.port", "last_seen_ms",
                         F.col("capability.current_ingress_streams").alias("current_streams"),
                         "hop_count", F.col("source.id").alias("source_id"))


FOLD = {
    "ordered": """SELECT *, row_number() OVER (PARTITION BY owner, node ORDER BY seq) AS rn
        FROM (SELECT *, min(seq) FILTER (WHERE kind = 'advert') OVER (PARTITION BY owner, node)
                AS born FROM fx_route_events) WHERE seq >= born""",
    "fold": """SELECT owner, node, rn, 'new' AS state, 0::BIGINT AS attempts, 0::BIGINT AS failures,
          false AS linked, ts_ms AS seen, 0::BIGINT AS tried_ms, 0::BIGINT AS success
        FROM ordered WHERE rn = 1
      UNION ALL
      SELECT f.owner, f.node, o.rn,
        CASE WHEN o.kind = 'success' THEN 'tried'
             WHEN o.kind = 'advert' AND f.state = 'bad' THEN 'new'
             WHEN o.kind = 'failure' AND f.failures + 1 >= 10 THEN 'bad'
             WHEN o.kind = 'failure' AND f.success = 0 THEN 'new' ELSE f.state END,
        CASE o.kind WHEN 'success' THEN 0 WHEN 'attempt' THEN f.attempts + 1 ELSE f.attempts END,
        CASE o.kind WHEN 'success' THEN 0 WHEN 'failure' THEN f.failures + 1 ELSE f.failures END,
        CASE WHEN o.kind IN ('failure', 'disconnect') THEN false
             WHEN o.kind = 'success' AND o.connected THEN true ELSE f.linked END,
        CASE WHEN o.kind IN ('advert', 'success') THEN o.ts_ms ELSE f.seen END,
        CASE WHEN o.kind IN ('attempt', 'success', 'failure') THEN o.ts_ms ELSE f.tried_ms END,
        CASE WHEN o.kind = 'success' THEN o.ts_ms ELSE f.success END
      FROM fold f JOIN ordered o ON o.owner = f.owner AND o.node = f.node AND o.rn = f.rn + 1""",
}


@register("""SELECT owner, node, state, attempts, failures, linked AS kcp_connected,
    seen AS last_seen_ms, tried_ms AS last_try_ms, success AS last_success_ms
    FROM (SELECT *, max(rn) OVER (PARTITION BY owner, node) AS last_rn FROM fold)
    WHERE rn = last_rn""", recursive=True, extra=FOLD)
def route_health(spark, d):
    return R.route_health(X.route_events(spark, d))


@register("""SELECT k, type = 'hello' AND version = 1 AND target = 'self'
    AND port BETWEEN 1 AND 65535 AND abs(ts_ms - now_ms) <= 600000 AND length(nonce) = 64
    AND length(signature) = 128 AS valid FROM fx_hellos""")
def hello_valid(spark, d):
    return X.hellos(spark, d).select("k", R.hello_valid().alias("valid"))


@register("""SELECT host, port, id, count(*) AS times FROM (
      SELECT node.host, node.port, node.id FROM fx_routes
      UNION ALL SELECT node.host, node.port, node.id FROM fx_adverts) GROUP BY ALL""")
def union_nodes(spark, d):
    first = routes(spark, d).select("node.*")
    second = X.adverts(spark, d).select("node.*")
    return R.union_nodes(first, second).groupBy("host", "port", "id").agg(
        F.count("*").alias("times"))


SNAPSHOT = f"""SELECT owner, node_id, node.host AS host, node.port AS port,
    CASE WHEN state = 'tried' AND last_success_ms = 0 THEN 'new' ELSE state END AS state,
    attempts, failures, CAST(least(hop_count, 8) AS INTEGER) AS hop_count,
    capability.accepting_ingress AS accepting_ingress,
    capability.max_kcp_links::VARCHAR AS max_kcp_links, capability.current_kcp_links::VARCHAR AS current_kcp_links,
    capability.max_ingress_streams::VARCHAR AS max_ingress_streams,
    capability.current_ingress_streams::VARCHAR AS current_ingress_streams,
    capability.max_ingress_bytes_per_second::VARCHAR AS max_ingress_bytes_per_second,
    capability.current_ingress_bytes_per_second::VARCHAR AS current_ingress_bytes_per_second,
    capability.updated_at_ms AS updated_at_ms,
    CASE WHEN source.id <> '{ZERO}' THEN source.id END AS source_id,
    CASE WHEN last_seen_ms = 0 THEN {A} ELSE last_seen_ms END AS last_seen_ms,
    last_try_ms, last_success_ms, false AS kcp_connected FROM valid"""


@register(SNAPSHOT, extra=MORE)
def read_route_snapshots(spark, d):
    path = SR.write_route_snapshots(routes(spark, d), SR.snapshot_folder(spark))
    read = SR.read_route_snapshots(spark, path, A)
    return read.select("owner", F.col("node.id").alias("node_id"), "node.host", "node.port",
                       "state", "attempts", "failures", "hop_count",
                       "capability.accepting_ingress", "capability.updated_at_ms",
                       *[F.col(f"capability.{f}").cast("string").alias(f) for f in CAP_FIELDS[1:-1]],
                       F.col("source.id").alias("source_id"), "last_seen_ms", "last_try_ms",
                       "last_success_ms", "kcp_connected")


@register(f"""SELECT owner, count(*) AS entries, count(capability) AS capabilities,
    count(*) FILTER (WHERE source.id <> '{ZERO}') AS sources FROM valid GROUP BY owner""", extra=MORE)
def write_route_snapshots(spark, d):
    """Entries, capability reports and sources per owner in the written text."""
    path = SR.write_route_snapshots(routes(spark, d), SR.snapshot_folder(spark))
    docs = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(
        F.try_parse_json("value").alias("doc"))
    entries = docs.select(
        F.try_variant_get("doc", "$.owner", "string").alias("owner"),
        F.explode(F.try_variant_get("doc", "$.entries", "array<variant>")).alias("e"))

    def present(field):
        return F.count_if(F.variant_get("e", f"$.{field}", "variant").isNotNull())

    return entries.groupBy("owner").agg(F.count("*").alias("entries"),
                                        present("capability").alias("capabilities"),
                                        present("source").alias("sources"))


# A walk along each route's events, adverts and others, from its first advert on.
TABLE_WALK = {
    "lived": """SELECT *, row_number() OVER (PARTITION BY owner, node_id ORDER BY seq) AS rn FROM (
        SELECT *, min(seq) FILTER (WHERE kind = 'advert') OVER (PARTITION BY owner, node_id) AS born
        FROM fx_fleet_log WHERE kind <> 'advert' OR hops <= 8) WHERE seq >= born""",
    "table_walk": """SELECT owner, node_id, rn, node, current_streams, hops AS hop_count,
          source.id AS source_id, CASE WHEN connected THEN 'tried' ELSE 'new' END AS state,
          0::BIGINT AS attempts, 0::BIGINT AS failures, connected AS linked, ts_ms AS seen,
          0::BIGINT AS tried, CASE WHEN connected THEN ts_ms ELSE 0 END AS success
        FROM lived WHERE rn = 1
      UNION ALL
      SELECT w.owner, w.node_id, e.rn, CASE WHEN e.kind = 'advert' THEN e.node ELSE w.node END,
        CASE WHEN e.kind = 'advert' THEN coalesce(e.current_streams, w.current_streams)
          ELSE w.current_streams END,
        CASE WHEN e.kind IN ('advert', 'success') AND e.connected THEN 1
          WHEN e.kind = 'advert' AND e.source IS NOT NULL AND NOT w.linked
            AND (w.hop_count = 0 OR e.hops < w.hop_count) THEN e.hops ELSE w.hop_count END,
        CASE WHEN e.kind IN ('advert', 'success') AND e.connected THEN NULL
          WHEN e.kind = 'advert' AND e.source IS NOT NULL AND NOT w.linked
            AND (w.hop_count = 0 OR e.hops < w.hop_count) THEN e.source.id ELSE w.source_id END,
        CASE WHEN e.kind = 'success' OR e.kind = 'advert' AND e.connected THEN 'tried'
          WHEN e.kind = 'advert' AND w.state = 'bad' THEN 'new'
          WHEN e.kind = 'failure' AND w.failures + 1 >= 10 THEN 'bad'
          WHEN e.kind = 'failure' AND w.success = 0 THEN 'new' ELSE w.state END,
        CASE e.kind WHEN 'success' THEN 0 WHEN 'attempt' THEN w.attempts + 1 ELSE w.attempts END,
        CASE WHEN e.kind = 'success' OR e.kind = 'advert' AND e.connected THEN 0
          WHEN e.kind = 'failure' THEN w.failures + 1 ELSE w.failures END,
        CASE WHEN e.kind IN ('failure', 'disconnect') THEN false
          WHEN e.kind IN ('advert', 'success') AND e.connected THEN true ELSE w.linked END,
        CASE WHEN e.kind IN ('advert', 'success') THEN e.ts_ms ELSE w.seen END,
        CASE WHEN e.kind IN ('attempt', 'success', 'failure') THEN e.ts_ms ELSE w.tried END,
        CASE WHEN e.kind = 'success' OR e.kind = 'advert' AND e.connected THEN e.ts_ms ELSE w.success END
      FROM table_walk w JOIN lived e ON e.owner = w.owner AND e.node_id = w.node_id AND e.rn = w.rn + 1""",
}
TABLE_SQL = """SELECT owner, node_id, node.host AS host, node.port AS port, current_streams, hop_count,
    source_id, state, attempts, failures, linked AS kcp_connected, seen AS last_seen_ms,
    tried AS last_try_ms, success AS last_success_ms
    FROM (SELECT *, max(rn) OVER (PARTITION BY owner, node_id) AS last_rn FROM table_walk)
    WHERE rn = last_rn"""


def shown_table(table):
    return table.select(
        "owner", "node_id", "node.host", "node.port",
        F.col("capability.current_ingress_streams").cast("bigint").alias("current_streams"), "hop_count",
        F.col("source.id").alias("source_id"), "state", F.col("attempts").cast("bigint").alias("attempts"),
        F.col("failures").cast("bigint").alias("failures"), "kcp_connected", "last_seen_ms",
        "last_try_ms", "last_success_ms")


@register(TABLE_SQL, recursive=True, extra=TABLE_WALK)
def route_table(spark, d):
    """Adverts and health events folded into one table."""
    return shown_table(R.route_table(X.fleet_log(spark, d)))


@register(TABLE_SQL, recursive=True, extra=TABLE_WALK)
def bounded_routes_room(spark, d):
    """Tables with room for all their nodes: no route is ever dropped."""
    return shown_table(BR.bounded_routes(X.fleet_log(spark, d)))


ROOM = 4


@register()
def bounded_routes(spark, d):
    """Tables that are full from their fifth node on."""
    return shown_table(BR.bounded_routes(X.fleet_log(spark, d), ROOM))

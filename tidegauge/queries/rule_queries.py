"""Queries over readings: rules, alerts and cleaned series."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge import fixtures as X
from tidegauge.operators import rules as R
from tidegauge.operators import series as Y
from tidegauge.queries.catalog import register
from tidegauge.queries.stream_queries import drained, same_sql_as, streamed
from tidegauge.streaming import rules as SR

HOUR = 3_600_000
DELAY, DELAY_MS = "1 hour", HOUR
AS_OF = f"(SELECT max(ts_ms) - {DELAY_MS} FROM fx_readings)"


def as_of(rows):
    return rows.agg(F.max("ts_ms") - DELAY_MS).scalar()


RULES_SQL = "VALUES " + ", ".join(
    f"({i}, '{p}', '{o}', {t}::DOUBLE, {h}::BIGINT)" for i, p, o, t, h in X.READING_RULES)
CHECKED = {
    "reading_rules": f"SELECT * FROM ({RULES_SQL}) t(rule_id, path, op, threshold, hold_ms)",
    "measured": """SELECT mac12, ts_ms, event_id, '$.load' AS path, load::DOUBLE AS v FROM fx_readings
        WHERE load IS NOT NULL UNION ALL
        SELECT mac12, ts_ms, event_id, '$.status.k', k::DOUBLE FROM fx_readings WHERE k IS NOT NULL""",
    "checked": """SELECT mac12, rule_id, hold_ms, ts_ms, event_id, CASE op WHEN '>' THEN v > threshold
          WHEN '>=' THEN v >= threshold WHEN '<' THEN v < threshold WHEN '<=' THEN v <= threshold
          WHEN '=' THEN v = threshold ELSE v <> threshold END AS holds
        FROM measured JOIN reading_rules USING (path)""",
    "islands": """SELECT *, count(*) FILTER (WHERE NOT holds) OVER (PARTITION BY mac12, rule_id
          ORDER BY ts_ms, event_id ROWS UNBOUNDED PRECEDING) AS island FROM checked""",
    "runs": """SELECT mac12, rule_id, hold_ms, island, min(ts_ms) FILTER (WHERE holds) AS since_ms,
          lead(min(ts_ms)) OVER (PARTITION BY mac12, rule_id ORDER BY island) AS end_ms,
          max(max(ts_ms)) OVER (PARTITION BY mac12, rule_id) AS last_ms
        FROM islands GROUP BY mac12, rule_id, hold_ms, island""",
}


@register(f"""SELECT mac12, rule_id, since_ms, since_ms + hold_ms AS hit_ms FROM runs
    WHERE since_ms + hold_ms <= coalesce(end_ms, greatest(last_ms, {AS_OF}))""", extra=CHECKED)
def rule_hits(spark, d):
    rows = X.readings(spark, d)
    return R.rule_hits(rows, X.reading_rules(spark), as_of(rows), "mac12", "ts_ms", "event_id")


@same_sql_as("rule_hits")
def rule_hits_stream(spark, d):
    rows = streamed(spark, X.readings(spark, d), "readings", "event_id")
    return drained(spark, SR.rule_hits_stream(rows, X.reading_rules(spark), DELAY, "mac12", "ts_ms",
                                              "event_id"), "hits")


RAISE, CLEAR, AGAIN = 9000.0, 2000.0, 8 * HOUR

# A walk along each device's readings that remembers since when the alert is raised.
ALERT_WALK = {
    "numbered": """SELECT *, row_number() OVER (PARTITION BY mac12 ORDER BY ts_ms, event_id) AS rn,
          max(ts_ms) OVER (PARTITION BY mac12) AS last_ms FROM fx_readings WHERE load IS NOT NULL""",
    "walk": f"""SELECT mac12, rn, ts_ms, CASE WHEN load >= {RAISE} THEN ts_ms END AS since,
          NULL::BIGINT AS cleared FROM numbered WHERE rn = 1
        UNION ALL
        SELECT n.mac12, n.rn, n.ts_ms,
          CASE WHEN w.since IS NULL AND n.load >= {RAISE} THEN n.ts_ms
               WHEN w.since IS NOT NULL AND n.load <= {CLEAR} THEN NULL ELSE w.since END,
          CASE WHEN w.since IS NOT NULL AND n.load <= {CLEAR} THEN w.since END
        FROM walk w JOIN numbered n ON n.mac12 = w.mac12 AND n.rn = w.rn + 1""",
    "raised": f"""SELECT mac12, cleared AS since, ts_ms AS end_ms, ts_ms - 1 AS upto FROM walk
          WHERE cleared IS NOT NULL
        UNION ALL
        SELECT w.mac12, w.since, NULL, greatest(n.last_ms, {AS_OF}) FROM walk w
        JOIN numbered n ON n.mac12 = w.mac12 AND n.rn = w.rn
        WHERE w.since IS NOT NULL AND n.rn = (SELECT max(rn) FROM numbered m WHERE m.mac12 = n.mac12)""",
    "counted": f"SELECT *, greatest((upto - since) // {AGAIN}, 0) AS times FROM raised",
}


@register(f"""SELECT mac12, since + n * {AGAIN} AS at_ms, CASE WHEN n = 0 THEN 'raise' ELSE 'repeat' END
      AS kind, n FROM (SELECT mac12, since, unnest(range(times + 1)) AS n FROM counted)
    UNION ALL SELECT mac12, end_ms, 'clear', times FROM counted WHERE end_ms IS NOT NULL""",
          recursive=True, extra=ALERT_WALK)
def alerts(spark, d):
    rows = X.readings(spark, d)
    return R.alerts(rows, as_of(rows), "mac12", "ts_ms", "event_id", "load", RAISE, CLEAR, AGAIN)


@same_sql_as("alerts")
def alerts_stream(spark, d):
    rows = streamed(spark, X.readings(spark, d), "readings", "event_id")
    return drained(spark, SR.alerts_stream(rows, DELAY, "mac12", "ts_ms", "event_id", "load", RAISE,
                                           CLEAR, AGAIN), "alerts")


STEP, GAP, LOW, HIGH = HOUR, 18 * HOUR, 100.0, 20_000.0
SERIES = {
    "good": f"""SELECT mac12, ts_ms, arg_max(load, event_id)::DOUBLE AS v FROM fx_readings
        WHERE load BETWEEN {LOW} AND {HIGH} GROUP BY mac12, ts_ms""",
    "points": f"""SELECT mac12, unnest(range((a + {STEP} - 1) // {STEP} * {STEP}, b + 1, {STEP})) AS g
        FROM (SELECT mac12, min(ts_ms) AS a, max(ts_ms) AS b FROM good GROUP BY mac12)""",
    "before": """SELECT p.mac12, p.g, r.ts_ms AS a_ms, r.v AS a FROM points p ASOF LEFT JOIN good r
        ON p.mac12 = r.mac12 AND p.g >= r.ts_ms""",
    "around": """SELECT p.*, r.ts_ms AS b_ms, r.v AS b FROM before p ASOF LEFT JOIN good r
        ON p.mac12 = r.mac12 AND p.g <= r.ts_ms""",
}


@register(f"""SELECT mac12, g AS ts_ms, round(CASE WHEN a_ms = g THEN a WHEN b_ms - a_ms <= {GAP}
      THEN a + (b - a) * ((g - a_ms) / (b_ms - a_ms)) END, 6) AS load,
    CASE WHEN a_ms = g THEN 'measured' WHEN b_ms - a_ms <= {GAP} THEN 'interpolated' ELSE 'gap' END
      AS kind FROM around""", extra=SERIES)
def clean_series(spark, d):
    out = Y.clean_series(X.readings(spark, d), "mac12", "ts_ms", "event_id", "load", STEP, GAP, LOW, HIGH)
    return out.withColumn("load", F.round("load", 6))

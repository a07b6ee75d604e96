"""Queries over the device message table: statistics, profiles, payload values, outliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge import fixtures as X
from tidegauge.operators import envelopes as E
from tidegauge.operators import profiles as Q
from tidegauge.queries.catalog import register

GOOD = "SELECT * FROM storage WHERE error IS NULL"


def messages(spark, d):
    return E.device_messages(E.parse_envelopes(X.envelopes(spark, d)))


@register("""SELECT mac_addr, timestamp_ms // 3600000 * 3600000 AS window_ms, count(*) AS messages,
             CAST(sum(octet_length(payload)) AS BIGINT) AS bytes, min(timestamp_ms) AS first_ms,
             max(timestamp_ms) AS last_ms FROM good GROUP BY 1, 2""", extra={"good": GOOD})
def device_stats(spark, d):
    return Q.device_stats(messages(spark, d))


@register("""SELECT mac_addr, min(timestamp_ms) AS first_ms, max(timestamp_ms) AS last_ms,
             count(*) AS messages, avg(gap) AS mean_gap_ms FROM (
               SELECT *, timestamp_ms - lag(timestamp_ms) OVER (PARTITION BY mac_addr
                 ORDER BY timestamp_ms) AS gap FROM good) GROUP BY mac_addr""",
          extra={"good": GOOD})
def device_profile(spark, d):
    return Q.device_profile(messages(spark, d))


@register("""SELECT mac_addr, timestamp_ms,
             CAST(json_extract(CAST(decode(payload) AS JSON), '$.k') AS DOUBLE) AS k
             FROM good WHERE octet_length(payload) > 0""", extra={"good": GOOD})
def payload_metric(spark, d):
    rows = messages(spark, d).filter(F.octet_length("payload") > 0)
    return rows.select("mac_addr", "timestamp_ms", Q.payload_metric(F.col("payload"), "$.k").alias("k"))


@register("""SELECT user_id, ts_ms, event_id, round(value, 2) AS value, round(mean, 6) AS mean,
             round(deviation, 6) AS deviation FROM (
    SELECT user_id, ts_ms, event_id, value, avg(value) OVER w AS mean,
      stddev_samp(value) OVER w AS deviation, count(*) OVER w AS n FROM ev
    WINDOW w AS (PARTITION BY user_id ORDER BY ts_ms, event_id
                 ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))
    WHERE n = 20 AND deviation > 0 AND abs(value - mean) > 3 * deviation""")
def anomalies(spark, d):
    rows = X._events(spark, d).select("user_id", "ts_ms", "event_id", "value")
    found = Q.anomalies(rows, "user_id", "ts_ms", "event_id", "value")
    return found.select("user_id", "ts_ms", "event_id", F.round("value", 2).alias("value"),
                        F.round("mean", 6).alias("mean"), F.round("deviation", 6).alias("deviation"))

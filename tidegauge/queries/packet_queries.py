"""Queries over packets, rules and the hit log."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge import fixtures as X
from tidegauge import schema as S
from tidegauge.operators import packets as K
from tidegauge.queries.catalog import register
from tidegauge.session import scratch

IFNAME = """(r.ifname = '' OR (p.chain = 0 AND r.ifname = p.in_if)
    OR (p.chain = 1 AND r.ifname = p.out_if)
    OR (p.chain = 2 AND (r.ifname = p.in_if OR r.ifname = p.out_if)))"""
IP = """((r.src = '' OR r.src = p.src) AND (r.dst = '' OR r.dst = p.dst)
    AND (r.protocol = 0 OR r.protocol = p.protocol))"""
PORTS = "((r.sport = 0 OR r.sport = p.sport) AND (r.dport = 0 OR r.dport = p.dport))"
TRANSPORT = f"""(CASE WHEN p.protocol = 6 THEN {PORTS} AND (NOT r.extra OR (r.syn = p.syn
      AND r.ack = p.ack AND r.fin = p.fin AND r.rst = p.rst))
    WHEN p.protocol = 17 THEN {PORTS}
    WHEN p.protocol IN (1, 2) THEN NOT r.extra OR (r.type = p.type AND r.code = p.code)
    ELSE false END)"""
HITS = f"""SELECT p.packet_id, min(r.rule_no) AS rule_no, arg_min(r.action, r.rule_no) AS rule_action
    FROM fx_packets p JOIN fx_rules r ON r.chain = p.chain AND p.hdr_words >= 5
      AND {IFNAME} AND {IP} AND {TRANSPORT} GROUP BY p.packet_id"""
APPLIED = """SELECT p.*, h.rule_no, coalesce(h.rule_action, 1) AS action, h.rule_no IS NOT NULL AS hit
    FROM fx_packets p LEFT JOIN hits h USING (packet_id)"""
MORE = {"hits": HITS, "applied": APPLIED}
NAMES_SQL = {
    "protocol": "CASE {0} WHEN 6 THEN 'tcp' WHEN 17 THEN 'udp' WHEN 1 THEN 'icmp' "
                "WHEN 2 THEN 'igmp' ELSE 'unknown' END",
    "action": "CASE {0} WHEN 0 THEN 'DROP' WHEN 1 THEN 'ACCEPT' WHEN 2 THEN 'STOLEN' "
              "WHEN 3 THEN 'QUEUE' WHEN 4 THEN 'REPEAT' WHEN 5 THEN 'STOP' ELSE 'UNKNOWN' END",
    "chain": "CASE {0} WHEN 0 THEN 'INPUT' WHEN 1 THEN 'OUTPUT' WHEN 2 THEN 'FORWARD' "
             "ELSE 'unknown' END",
}


def applied(spark, d):
    return K.apply_actions(K.classify_packets(X.packets(spark, d), X.rules(spark)))


@register("""SELECT p.packet_id, p.chain, h.rule_no, h.rule_action FROM fx_packets p
             LEFT JOIN hits h USING (packet_id)""", extra=MORE)
def classify_packets(spark, d):
    return K.classify_packets(X.packets(spark, d), X.rules(spark)).select(
        "packet_id", "chain", "rule_no", "rule_action")


@register("SELECT packet_id, action, hit FROM applied", extra=MORE)
def default_action(spark, d):
    return applied(spark, d).select("packet_id", "action", "hit")


@register("SELECT packet_id, 1 AS action, false AS hit FROM fx_packets")
def default_action_disabled(spark, d):
    classified = K.classify_packets(X.packets(spark, d), X.rules(spark))
    return K.apply_actions(classified, disabled=True).select("packet_id", "action", "hit")


@register("""SELECT packet_id, rule_no FROM (SELECT p.packet_id, r.rule_no,
               row_number() OVER (PARTITION BY p.packet_id ORDER BY r.rule_no) AS n
             FROM fx_packets p LEFT JOIN fx_rules r ON r.chain = p.chain AND p.hdr_words >= 5
               AND """ + f"{IFNAME} AND {IP} AND {TRANSPORT}) WHERE n = 1")
def first_match(spark, d):
    return K.first_match(X.packets(spark, d), X.rules(spark)).select("packet_id", "rule_no")


def _predicate(name, function, sql):
    """Matching rules per packet under one part of the match."""
    counted = f"""SELECT p.packet_id, CAST(count(r.rule_no) AS INTEGER) AS matching
        FROM fx_packets p LEFT JOIN fx_rules r ON r.chain = p.chain AND {sql}
        GROUP BY p.packet_id"""

    def query(spark, d):
        return K.count_matching(X.packets(spark, d), X.rules(spark), function).select(
            "packet_id", "matching")

    query.__name__ = name
    return register(counted)(query)


ifname_ok = _predicate("ifname_ok", K.ifname_ok, IFNAME)
ip_ok = _predicate("ip_ok", K.ip_ok, IP)
transport_ok = _predicate("transport_ok", K.transport_ok, TRANSPORT)


@register("SELECT packet_id, hdr_words >= 5 AS packet_ok FROM fx_packets")
def packet_ok(spark, d):
    return X.packets(spark, d).select("packet_id", K.packet_ok(F.col).alias("packet_ok"))


@register("""SELECT r.chain, r.rule_no, r.action, count(a.packet_id) AS hits
             FROM fx_rules r LEFT JOIN applied a ON a.hit AND a.chain = r.chain
               AND a.rule_no = r.rule_no GROUP BY r.chain, r.rule_no, r.action""", extra=MORE)
def rule_stats(spark, d):
    return K.rule_stats(applied(spark, d), X.rules(spark))


@register("""SELECT (SELECT count(*) FROM fx_rules) AS rules,
             (SELECT count(*) FROM applied WHERE hit) AS hits""", extra=MORE)
def rule_totals(spark, d):
    return K.totals(K.rule_stats(applied(spark, d), X.rules(spark)))


LINE = f"""'Time: ' || strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%d %H:%M:%S') || '  From ' || src
    || ' To ' || dst || ' ' || {NAMES_SQL['protocol'].format('protocol')}
    || ' PROTOCOL was ' || {NAMES_SQL['action'].format('action')}"""


@register(f"SELECT {LINE} AS value FROM applied WHERE hit", extra=MORE)
def write_hit_log(spark, d):
    path = scratch(spark, "hit-log")
    K.hit_log_lines(applied(spark, d)).write.text(path)
    return spark.read.text(path)


@register(f"""SELECT ts + INTERVAL 8 HOUR AS log_time, src, dst,
              {NAMES_SQL['protocol'].format('protocol')} AS protocol_name,
              {NAMES_SQL['action'].format('action')} AS action_name FROM applied WHERE hit""",
          extra=MORE)
def read_hit_log(spark, d):
    path = scratch(spark, "hit-log")
    K.hit_log_lines(applied(spark, d)).write.text(path)
    return K.parse_hit_log(spark.read.text(path))


@register(f"""SELECT {NAMES_SQL['chain'].format('r.chain')} AS chain_name, r.rule_no,
              {NAMES_SQL['action'].format('r.action')} AS action_name,
              CASE WHEN r.src = '' THEN '0.0.0.0' ELSE r.src END AS source, r.sport,
              CASE WHEN r.dst = '' THEN '0.0.0.0' ELSE r.dst END AS dest, r.dport, r.protocol,
              count(a.packet_id) AS hits
              FROM fx_rules r LEFT JOIN applied a ON a.hit AND a.chain = r.chain
                AND a.rule_no = r.rule_no
              GROUP BY ALL""", extra=MORE)
def list_rules(spark, d):
    """The rule list with the hits each rule had on the packets."""
    stats = K.rule_stats(applied(spark, d), X.rules(spark))
    hits = stats.select(K.code_name(F.col("chain"), S.CHAINS, "unknown").alias("chain_name"),
                        "rule_no", "hits")
    return K.list_rules(X.rules(spark)).join(hits, ["chain_name", "rule_no"])


@register("SELECT packet_id, ts + INTERVAL 8 HOUR AS log_time FROM fx_packets")
def log_time(spark, d):
    return X.packets(spark, d).select("packet_id", K.log_time(F.col("ts")).alias("log_time"))


@register("SELECT packet_id, " + ", ".join(
    f"{sql.format(col)} AS {out}" for col, out, sql in [
        ("chain", "chain_name", NAMES_SQL["chain"]),
        ("protocol", "protocol_name", NAMES_SQL["protocol"]),
        ("action", "action_name", NAMES_SQL["action"])])
    + ", chain AS chain_code FROM applied", extra=MORE)
def code_name(spark, d):
    named = applied(spark, d).select(
        "packet_id", K.code_name(F.col("chain"), S.CHAINS, "unknown").alias("chain_name"),
        K.code_name(F.col("protocol"), S.PROTOCOLS, "unknown").alias("protocol_name"),
        K.code_name(F.col("action"), S.ACTIONS, "UNKNOWN").alias("action_name"))
    return named.withColumn("chain_code", K.name_code(F.col("chain_name"), S.CHAINS))


MANY_RULES = """SELECT CAST(k % 3 AS INTEGER) AS chain, CAST(k AS INTEGER) AS rule_no,
    CAST(k % 6 AS INTEGER) AS action, CASE WHEN k % 11 = 0 THEN '' ELSE '10.0.0.' || (k % 8) END AS src,
    CASE WHEN k % 7 = 0 THEN '' ELSE '10.1.0.' || ((k // 8) % 8) END AS dst,
    CASE WHEN k % 5 = 0 THEN 0 ELSE 1024 + k % 5 END AS sport,
    CASE WHEN k % 4 = 0 THEN 0 ELSE [22, 80, 443, 53][CAST((k // 3) % 4 AS INTEGER) + 1] END AS dport,
    CASE WHEN k % 13 = 0 THEN 0 ELSE [6, 17, 1, 2, 50][CAST((k // 5) % 5 AS INTEGER) + 1] END AS protocol,
    CASE WHEN k % 10 = 1 THEN 'eth' || (k % 2) ELSE '' END AS ifname, k % 9 = 0 AS extra,
    CAST(k % 2 AS INTEGER) AS syn, CAST((k // 2) % 2 AS INTEGER) AS ack, 0 AS fin, 0 AS rst,
    CASE WHEN k % 4 = 1 THEN 8 ELSE 0 END AS type, 0 AS code
    FROM (SELECT c_custkey AS k FROM customer)"""


@register("""SELECT p.packet_id, p.chain, min(r.rule_no) AS rule_no, arg_min(r.action, r.rule_no) AS rule_action
    FROM fx_packets p LEFT JOIN many_rules r ON r.chain = p.chain AND p.hdr_words >= 5 AND """
          + f"{IFNAME} AND {IP} AND {TRANSPORT} GROUP BY p.packet_id, p.chain",
          extra={"many_rules": MANY_RULES})
def classify_packets_many(spark, d):
    """A rule table as long as that of the customers."""
    return K.classify_packets(X.packets(spark, d), X.many_rules(spark, d)).select(
        "packet_id", "chain", "rule_no", "rule_action")

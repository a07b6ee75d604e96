import random

import pytest

from tidegauge import fixtures as X
from tidegauge.operators import packets as K

PACKET = ("packet_id string, chain int, src string, dst string, sport int, dport int, "
          "protocol int, syn int, ack int, fin int, rst int, type int, code int, in_if string, "
          "out_if string, hdr_words int")


def random_packets(rnd, n):
    return [(str(i), rnd.randrange(3), rnd.choice("ab"), rnd.choice("cd"), rnd.choice([1, 2]),
             rnd.choice([3, 4]), rnd.choice([6, 17, 1, 2, 50]), rnd.randrange(2), rnd.randrange(2),
             0, 0, rnd.choice([0, 8]), 0, rnd.choice(["eth0", "eth1"]), rnd.choice(["eth0", "eth1"]),
             rnd.choice([4, 5, 5, 6])) for i in range(n)]


def random_rules(rnd, n):
    return [(rnd.randrange(3), i + 1, rnd.randrange(4), rnd.choice(["", "a", "b"]),
             rnd.choice(["", "c"]), rnd.choice([0, 1]), rnd.choice([0, 3]),
             rnd.choice([0, 6, 17, 1, 50]), rnd.choice(["", "eth0"]), rnd.random() < 0.5,
             rnd.randrange(2), rnd.randrange(2), 0, 0, rnd.choice([0, 8]), 0) for i in range(n)]


def first(p, rules):
    (_, chain, src, dst, sport, dport, proto, syn, ack, fin, rst, kind, code, i, o, words) = p
    if words < 5:
        return None
    for r in sorted(rules, key=lambda r: r[1]):
        (rc, no, action, rs, rd, rsp, rdp, rp, name, extra, rsyn, rack, rfin, rrst, rt, rcode) = r
        if rc != chain:
            continue
        if name and name not in {0: [i], 1: [o], 2: [i, o]}[chain]:
            continue
        if (rs and rs != src) or (rd and rd != dst) or (rp and rp != proto):
            continue
        ports = (not rsp or rsp == sport) and (not rdp or rdp == dport)
        if proto == 6:
            ok = ports and (not extra or (rsyn, rack, rfin, rrst) == (syn, ack, fin, rst))
        elif proto == 17:
            ok = ports
        elif proto in (1, 2):
            ok = not extra or (rt, rcode) == (kind, code)
        else:
            ok = False
        if ok:
            return no, action
    return None


@pytest.mark.parametrize("unrolled, per_block, n", [(64, 1024, 40), (0, 1024, 40), (0, 7, 40), (64, 1024, 0), (0, 1024, 400), (0, 50, 400)])
def test_first_match_equals_a_plain_search(spark, monkeypatch, unrolled, per_block, n):
    monkeypatch.setattr(K, "RULES_UNROLLED", unrolled)
    monkeypatch.setattr(K, "RULES_PER_BLOCK", per_block)
    rnd = random.Random(n)
    packets, rules = random_packets(rnd, 600), random_rules(rnd, n)
    pdf = spark.createDataFrame(packets, PACKET)
    rdf = spark.createDataFrame(rules, X.RULE_SCHEMA)
    want = {p[0]: first(p, rules) for p in packets}
    got = K.classify_packets(pdf, rdf).collect()
    assert {r.packet_id: r.rule_no and (r.rule_no, r.rule_action) for r in got} == want
    ranked = K.first_match(pdf, rdf).collect()
    assert {r.packet_id: r.rule_no for r in ranked} == {p: m and m[0] for p, m in want.items()}


def test_work_per_packet_follows_the_sets_of_fields(spark):
    """Ten thousand rules that ask for the same fields are one join."""
    rules = spark.range(10_000).selectExpr(
        "0 AS chain", "cast(id AS int) AS rule_no", "1 AS action", "concat('s', id) AS src", "'' AS dst",
        "0 AS sport", "0 AS dport", "17 AS protocol", "'' AS ifname", "false AS extra", "0 AS syn", "0 AS ack",
        "0 AS fin", "0 AS rst", "0 AS type", "0 AS code")
    packets = spark.createDataFrame([("p", 0, "s9999", "d", 1, 2, 17, 0, 0, 0, 0, 0, 0, "i", "o", 5)], PACKET)
    out = K.classify_packets(packets, rules)
    assert out.first().rule_no == 9999
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") == 1


def test_log_lines_round_trip(spark, tmp_path):
    rnd = random.Random(2)
    packets = spark.createDataFrame(random_packets(rnd, 50), PACKET).selectExpr(
        "*", "timestamp'2024-01-01 20:30:00' AS ts")
    applied = K.apply_actions(K.classify_packets(packets, spark.createDataFrame(
        random_rules(rnd, 9), X.RULE_SCHEMA)))
    lines = K.hit_log_lines(applied)
    assert lines.count() == applied.filter("hit").count() > 0
    assert lines.first().value.startswith("Time: 2024-01-02 04:30:00  From ")
    assert K.parse_hit_log(lines).count() == lines.count()
    assert K.hit_log_lines(applied, paused=True).count() == 0


def test_many_rules_of_few_values_are_broadcast(spark, monkeypatch):
    """The size of a set is that of its values, not of the rules that have them."""
    monkeypatch.setattr(K, "RULES_UNROLLED", 2)
    monkeypatch.setattr(K, "BROADCAST_RULES", 20)
    rnd = random.Random(5)
    rules = [(c, i + 1, a, s, "", 0, 0, 6, "", False, 0, 0, 0, 0, 0, 0)
             for i, (c, a, s) in enumerate((rnd.randrange(3), rnd.randrange(4), rnd.choice(["", "a", "b"]))
                                           for _ in range(400))]
    packets = random_packets(rnd, 300)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = K.classify_packets(spark.createDataFrame(packets, PACKET), spark.createDataFrame(rules, X.RULE_SCHEMA))
        plan = found._jdf.queryExecution().toString()
        got = {r.packet_id: (r.rule_no, r.rule_action) for r in found.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == {p[0]: first(p, rules) or (None, None) for p in packets}
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan

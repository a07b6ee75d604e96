"""Job inputs derived from the given tables, one row of input per row of the table.

Each function reads ``{sf_dir}/{table}.parquet`` and shapes it as the data a job consumes, so that
the work of every registered query grows with the tables. ``tidegauge.queries.oracle_inputs``
states the same rows in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidegauge import schema as S
from tidegauge.functions.payload import encode_payload
from tidegauge.plans.segments import lag_across
from tidegauge.plans.spread import spread

AS_OF_MS = 1704067200000          # 2024-01-01 00:00:00 UTC, the "now" of the route tables
PRESENCE_TTL_MS = 12 * 3600 * 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id", "user_id", "event_type", "value", "props",
        F.expr("lpad(lower(hex(user_id)), 12, '0')").alias("mac12"),
        F.expr("unix_millis(cast(ts AS timestamp))").alias("ts_ms"),
    )


_PAIRS = ", ".join(f"substr(mac12, {i}, 2)" for i in range(1, 12, 2))
COLON = f"concat_ws(':', {_PAIRS})"
DASHED = f"concat_ws('-', {_PAIRS})"
TOPIC = f"concat('iota/node-', user_id % 4, '/devices/', {DASHED}, '/telemetry')"


def envelopes(spark, sf_dir) -> DataFrame:
    """Topic rows; ``event_id % 20`` selects a well-formed or a faulty kind of envelope."""
    parts = [
        "if(c = 4, '\"schema\":\"iota.edge.raw.v0\"', '\"schema\":\"iota.edge.raw.v1\"')",
        f"""CASE WHEN c = 1 THEN concat('"mac_addr":" ', upper({COLON}), ' "')
                 WHEN c >= 11 THEN concat('"mac_hex":"', mac12, '","mac_addr":"', {COLON}, '"')
                 WHEN c IN (0, 2, 10) THEN NULL
                 ELSE concat('"mac_hex":"', mac12, '"') END""",
        f"""CASE WHEN c = 0 OR c >= 11 THEN concat('"topic":"', {TOPIC}, '"')
                 WHEN c = 10 THEN concat('"topic":"', {TOPIC}, '/extra"') END""",
        """CASE WHEN c = 5 THEN NULL
                WHEN c = 0 THEN concat('"timestamp":', ts_ms)
                WHEN c = 8 THEN concat('"timestamp_ms":"', ts_ms, '"')
                WHEN c = 9 THEN '"timestamp_ms":9223372036854775808'
                WHEN event_id % 40 = 12 THEN concat('"timestamp_ms":', ts_ms * 1000)
                WHEN event_id % 400 = 13 THEN '"timestamp_ms":9223372036854775807'
                ELSE concat('"timestamp_ms":', ts_ms) END""",
        """CASE WHEN c = 6 THEN '"payload_base64":""'
                WHEN c = 7 THEN '"payload_base64":"%%%"'
                ELSE concat('"payload_base64":"', b64, '"') END""",
        """CASE WHEN c = 3 THEN concat('"payload_len":', octet_length(props) + 1)
                WHEN c IN (0, 6, 7) THEN NULL
                ELSE concat('"payload_len":', octet_length(props)) END""",
        """CASE WHEN c = 6 THEN NULL
                WHEN c = 0 THEN concat('"mqtt_message_id":"m', event_id DIV 4, '"')
                ELSE concat('"message_id":"m', event_id DIV 4, '"') END""",
        """CASE WHEN c = 0 THEN concat('"ingress_protocol":"mqtt","clientid":"c', user_id,
                                      '","username":"u', user_id % 7, '","qos":1')
                WHEN c >= 11 THEN concat('"stream_id":', user_id + 1, ',"origin":"',
                                         lpad(lower(hex(user_id + 1)), 64, '0'), '"') END""",
    ]
    return (
        spread(_events(spark, sf_dir), "event_id")
        .withColumn("c", F.col("event_id") % 20)
        .withColumn("b64", encode_payload(F.encode("props", "UTF-8")))
        .select(
            (F.col("user_id") % 3).cast("int").alias("partition"),
            F.col("event_id").alias("offset"),
            F.col("mac12").alias("key"),
            F.expr("concat('{', concat_ws(',', " + ", ".join(parts) + "), '}')").alias("value"),
            (F.col("ts_ms") + 250).alias("arrival_ms"),
        )
    )


def presence(spark, sf_dir) -> DataFrame:
    return _events(spark, sf_dir).select("mac12", "ts_ms", "event_id")


# Rules on payloads: rule_id, path, comparison, threshold and how long it has to hold.
READING_RULES = [
    (1, "$.load", ">", 9000.0, 0), (2, "$.load", ">=", 2500.0, 6 * 3_600_000),
    (3, "$.status.k", "<", 50.0, 12 * 3_600_000), (4, "$.status.k", "<>", 7.0, 3 * 86_400_000),
    (5, "$.load", "<=", 12_000.0, 2 * 86_400_000), (6, "$.status.k", "=", 13.0, 0),
    (7, "$.none", ">", 0.0, 0),
]


def reading_rules(spark) -> DataFrame:
    return spark.createDataFrame(
        READING_RULES, "rule_id int, path string, op string, threshold double, hold_ms bigint")


def readings(spark, sf_dir) -> DataFrame:
    """Messages with a JSON payload; some lack the metric, some are no JSON."""
    return _events(spark, sf_dir).select(
        "mac12", "ts_ms", "event_id",
        F.expr("""CASE WHEN event_id % 61 = 0 THEN 'no json' WHEN event_id % 50 = 0
              THEN concat('{"load":"', event_id, '","status":', props, '}')
              ELSE concat('{"load":', cast(round(value * 100) AS bigint), ',"status":', props, '}')
              END""").alias("payload"),
        F.expr("if(event_id % 61 = 0 OR event_id % 50 = 0, NULL, cast(round(value * 100) AS bigint))")
        .alias("load"))


def frames(spark, sf_dir) -> DataFrame:
    """Binary device frames, some with a wrong length and some cut short."""
    return _events(spark, sf_dir).select(
        F.expr("((user_id % 10) + 1) * 4294967296 + user_id + 1").alias("stream_id"),
        "event_id",
        F.expr("""unhex(substr(concat(mac12, lpad(hex(ts_ms), 16, '0'),
                    lpad(hex(octet_length(props) + if(event_id % 11 = 0, 1, 0)), 8, '0'),
                    hex(props)), 1, if(event_id % 13 = 0, 20, 2147483647)))""").alias("frame"),
    )


def chunks(spark, sf_dir) -> DataFrame:
    """Byte chunks of the valid frames, cut inside the header; some streams start with a frame
    whose declared length is over the cap."""
    ev = _events(spark, sf_dir).withColumn(
        "stream_id", F.expr("((user_id % 10) + 1) * 4294967296 + user_id + 1"))
    ev = ev.filter("event_id % 11 <> 0 AND event_id % 13 <> 0")
    first = (ev.filter("user_id % 25 = 24").groupBy("stream_id")
             .agg(F.min("event_id").alias("first_id")))
    ev = ev.join(first, "stream_id", "left")
    length = "if(event_id = first_id, 2097152, octet_length(props))"
    whole = F.expr(f"""unhex(concat(mac12, lpad(hex(ts_ms), 16, '0'),
                       lpad(hex({length}), 8, '0'), hex(props)))""")
    return ev.withColumn("frame", whole).select(
        "stream_id",
        F.explode(F.array(
            F.struct((F.col("event_id") * 2).alias("seq"),
                     F.expr("substring(frame, 1, 7)").alias("bytes")),
            F.struct((F.col("event_id") * 2 + 1).alias("seq"),
                     F.expr("substring(frame, 8)").alias("bytes")))).alias("_c"),
    ).select("stream_id", "_c.seq", "_c.bytes")


def tunnel_packets(spark, sf_dir) -> DataFrame:
    return _events(spark, sf_dir).select(
        F.col("event_id").alias("id"),
        F.expr("""unhex(concat('49505450', '01', lpad(hex(1 + event_id % 8), 2, '0'),
                    if(event_id % 17 = 0, '0001', '0000'),
                    lpad(hex(if(event_id % 19 = 0, 0, user_id + 1)), 16, '0'),
                    lpad(hex(octet_length(props)), 8, '0'), hex(props)))""").alias("packet"),
    )


def gossip_payloads(spark, sf_dir) -> DataFrame:
    return _events(spark, sf_dir).select(
        F.col("event_id").alias("id"),
        F.expr("""if(event_id % 3 = 0, encode(props, 'UTF-8'),
                    unhex(concat('49504742', '01', lpad(hex(event_id % 6), 2, '0'), '0000',
                      lpad(hex(if(event_id % 29 = 0, 0, user_id + 1)), 64, '0'),
                      lpad(hex(event_id DIV 4 + 1), 64, '0'),
                      lpad(hex(octet_length(props)), 8, '0'), hex(props))))""").alias("payload"),
    )


def gossip_arrivals(spark, sf_dir) -> DataFrame:
    """Arrivals of gossip messages at nodes: type, stream and identity, with the time."""
    return _events(spark, sf_dir).select(
        F.expr("CASE event_id % 3 WHEN 0 THEN 'control' WHEN 1 THEN 'replicate' "
               "ELSE 'kafka_broadcast' END").alias("type"),
        F.expr("user_id % 2 + 1").alias("stream_id"),
        F.expr("lpad(lower(hex(user_id % 5 + 1)), 64, '0')").alias("origin"),
        F.expr("lpad(lower(hex(user_id DIV 10 + 1)), 64, '0')").alias("message_id"),
        F.expr("cast(event_id % 6 AS int)").alias("ttl"),
        "ts_ms", F.col("event_id").alias("seq"),
    )


def inbound_packets(spark, sf_dir) -> DataFrame:
    """Tunnel frames that carry the gossip arrivals; some plain, some with an invalid envelope."""
    return _events(spark, sf_dir).withColumn("body", F.expr("""if(event_id % 11 = 0, hex(props),
            concat('49504742', '01', lpad(hex(event_id % 6), 2, '0'), '0000',
              lpad(hex(if(event_id % 13 = 0, 0, user_id % 5 + 1)), 64, '0'),
              lpad(hex(user_id DIV 10 + 1), 64, '0'),
              lpad(hex(octet_length(props)), 8, '0'), hex(props)))""")).select(
        F.col("event_id").alias("seq"), F.col("ts_ms").alias("arrival_ms"),
        F.expr("""unhex(concat('49505450', '01', CASE event_id % 3 WHEN 0 THEN '04' WHEN 1 THEN '06'
                    ELSE '07' END, '0000', lpad(hex(user_id % 2 + 1), 16, '0'),
                    lpad(hex(length(body) DIV 2), 8, '0'), body))""").alias("packet"))


def topic_packets(spark, sf_dir) -> DataFrame:
    """Tunnel frames of which every third carries a topic message: well-formed, faulty or empty; some
    come twice, some without envelope or with an invalid one. Time runs 100,000 times as fast."""
    values = envelopes(spark, sf_dir).select(F.col("offset").alias("event_id"), "value")
    rows = _events(spark, sf_dir).drop("value").join(values, "event_id").withColumn("content", F.expr(
        """CASE WHEN event_id % 3 <> 2 THEN hex(props) WHEN event_id % 37 = 0 THEN ''
             ELSE hex(value) END""")).withColumn("body", F.expr("""if(event_id % 11 = 0, content,
            concat('49504742', '01', lpad(hex(event_id % 6), 2, '0'), '0000',
              lpad(hex(if(event_id % 13 = 0, 0, (event_id DIV 6) % 5 + 1)), 64, '0'),
              lpad(hex(if(event_id % 4 = 0, event_id + 1000000000, event_id DIV 6 + 1)), 64, '0'),
              lpad(hex(length(content) DIV 2), 8, '0'), content))"""))
    return rows.select(
        F.col("event_id").alias("seq"),
        F.expr(f"{AS_OF_MS} + (ts_ms - {AS_OF_MS}) DIV 100000").alias("arrival_ms"),
        F.expr("""unhex(concat('49505450', '01', CASE event_id % 3 WHEN 0 THEN '04' WHEN 1 THEN '06'
                    ELSE '07' END, '0000', lpad(hex((event_id DIV 6) % 2 + 1), 16, '0'),
                    lpad(hex(length(body) DIV 2), 8, '0'), body))""").alias("packet"))


def mqtt_messages(spark, sf_dir) -> DataFrame:
    return _events(spark, sf_dir).select(
        F.expr(f"""concat('iota/node-', user_id % 4, if(event_id % 7 = 0, '/extra', ''),
                     '/devices/', {DASHED},
                     if(event_id % 9 = 0, '/status', '/telemetry'))""").alias("topic"),
        F.expr("concat('c', user_id)").alias("clientid"),
        F.expr("concat('u', user_id % 7)").alias("username"),
        F.expr("cast(event_id % 3 AS int)").alias("qos"),
        F.col("ts_ms").alias("timestamp"),
        F.expr("concat('q', event_id)").alias("id"),
        F.encode("props", "UTF-8").alias("payload"),
    )


def packets(spark, sf_dir) -> DataFrame:
    return spread(table(spark, sf_dir, "lineitem"), "l_orderkey").select(
        F.expr("""concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey,
                    cast(l_quantity AS bigint), cast(round(l_extendedprice * 100) AS bigint),
                    date_format(l_shipdate, 'yyyyMMdd'))""").alias("packet_id"),
        F.expr("cast(l_linenumber % 3 AS int)").alias("chain"),
        F.expr("concat('10.0.0.', l_suppkey % 8)").alias("src"),
        F.expr("concat('10.1.0.', l_partkey % 8)").alias("dst"),
        F.expr("cast(1024 + l_partkey % 5 AS int)").alias("sport"),
        F.expr("element_at(array(22, 80, 443, 53), cast(l_suppkey % 4 AS int) + 1)").alias("dport"),
        F.expr("element_at(array(6, 17, 1, 2, 50), cast(l_partkey % 5 AS int) + 1)")
        .alias("protocol"),
        F.expr("cast(cast(l_quantity AS bigint) % 2 AS int)").alias("syn"),
        F.expr("cast((cast(l_quantity AS bigint) DIV 2) % 2 AS int)").alias("ack"),
        F.lit(0).alias("fin"), F.lit(0).alias("rst"),
        F.expr("if(l_linenumber % 2 = 0, 8, 0)").alias("type"),
        F.lit(0).alias("code"),
        F.expr("concat('eth', l_suppkey % 2)").alias("in_if"),
        F.expr("concat('eth', l_partkey % 2)").alias("out_if"),
        F.expr("if(l_partkey % 97 = 0, 4, 5)").alias("hdr_words"),
        F.col("l_shipdate").cast("timestamp").alias("ts"),
    )


# Rule columns: chain, rule_no, action, src, dst, sport, dport, protocol, ifname, then the extra
# match: whether it is set, TCP flags, ICMP/IGMP type and code. '' and 0 match anything.
RULES = [
    (0, 1, 0, "", "", 0, 22, 6, "", False, 0, 0, 0, 0, 0, 0),
    (0, 2, 1, "10.0.0.1", "", 0, 0, 0, "", False, 0, 0, 0, 0, 0, 0),
    (0, 3, 0, "", "", 0, 0, 6, "", True, 1, 0, 0, 0, 0, 0),
    (0, 4, 1, "", "", 0, 53, 17, "", False, 0, 0, 0, 0, 0, 0),
    (0, 5, 0, "", "", 0, 0, 1, "", True, 0, 0, 0, 0, 8, 0),
    (1, 1, 1, "", "", 0, 0, 0, "eth0", False, 0, 0, 0, 0, 0, 0),
    (1, 2, 0, "", "10.1.0.3", 0, 0, 0, "", False, 0, 0, 0, 0, 0, 0),
    (2, 1, 0, "", "", 0, 0, 0, "eth1", False, 0, 0, 0, 0, 0, 0),
    (2, 2, 1, "", "", 0, 443, 6, "", False, 0, 0, 0, 0, 0, 0),
    (2, 3, 3, "", "", 0, 0, 2, "", False, 0, 0, 0, 0, 0, 0),
]
RULE_SCHEMA = ("chain int, rule_no int, action int, src string, dst string, sport int, dport int, "
               "protocol int, ifname string, extra boolean, syn int, ack int, fin int, rst int, "
               "type int, code int")


def rules(spark) -> DataFrame:
    return spark.createDataFrame(RULES, RULE_SCHEMA)


def many_rules(spark, sf_dir) -> DataFrame:
    """A rule for every customer, most of them narrow."""
    return table(spark, sf_dir, "customer").withColumn("k", F.col("c_custkey").cast("bigint")).selectExpr(
        "cast(k % 3 AS int) AS chain", "cast(k AS int) AS rule_no", "cast(k % 6 AS int) AS action",
        "if(k % 11 = 0, '', concat('10.0.0.', k % 8)) AS src",
        "if(k % 7 = 0, '', concat('10.1.0.', (k DIV 8) % 8)) AS dst",
        "cast(if(k % 5 = 0, 0, 1024 + k % 5) AS int) AS sport",
        "if(k % 4 = 0, 0, element_at(array(22, 80, 443, 53), cast((k DIV 3) % 4 AS int) + 1)) AS dport",
        "if(k % 13 = 0, 0, element_at(array(6, 17, 1, 2, 50), cast((k DIV 5) % 5 AS int) + 1)) AS protocol",
        "if(k % 10 = 1, concat('eth', k % 2), '') AS ifname", "k % 9 = 0 AS extra",
        "cast(k % 2 AS int) AS syn", "cast((k DIV 2) % 2 AS int) AS ack", "0 AS fin", "0 AS rst",
        "if(k % 4 = 1, 8, 0) AS type", "0 AS code")


def _node(k: str) -> str:
    return (f"named_struct('host', concat('h', {k}), 'port', 9000 + {k} % 1000, "
            f"'id', lpad(lower(hex({k})), 64, '0'))")


def routes(spark, sf_dir) -> DataFrame:
    """Route tables of the fleet's nodes: one row per (owner, peer)."""
    c = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("k"), F.concat(F.lit("n"), "c_nationkey").alias("owner"))
    prev = lag_across(c, keys=["owner"], segment=F.expr("k DIV 1000"), order="k", value="k",
                      out="prev_k")
    a = AS_OF_MS
    return prev.select(
        "owner", "k",
        F.expr(_node("k")).alias("node"),
        F.expr(f"if(prev_k IS NULL, NULL, {_node('prev_k')})").alias("source"),
        F.expr(f"""if(k % 5 = 0, NULL, named_struct(
              'accepting_ingress', k % 11 <> 0,
              'max_kcp_links', 512L, 'current_kcp_links', (k * 3) % 520,
              'max_ingress_streams', cast(CASE WHEN k % 9 = 0 THEN 0
                WHEN k % 13 = 0 THEN 18446744073709551615 ELSE 4096 END AS decimal(20,0)),
              'current_ingress_streams', (k * 17) % 4200,
              'max_ingress_bytes_per_second', if(k % 4 = 1, 0L, 1048576L),
              'current_ingress_bytes_per_second', (k * 997) % 1100000,
              'updated_at_ms', {a} - (k % 240) * 1000))""").alias("capability"),
        F.expr("CASE WHEN k % 7 = 3 THEN 'bad' WHEN k % 7 < 3 THEN 'new' ELSE 'tried' END")
        .alias("state"),
        F.expr("cast(k % 12 AS int)").alias("attempts"),
        F.expr("cast((k * 5) % 14 AS int)").alias("failures"),
        F.expr("cast(k % 10 AS int)").alias("hop_count"),
        F.expr(f"if(k % 53 = 0, {a} + 1200000, {a} - (k * 7919 % 4000000) * 1000)")
        .alias("last_seen_ms"),
        F.expr(f"if(k % 3 = 0, 0, {a} - (k * 131 % 2000) * 1000)").alias("last_try_ms"),
        F.expr(f"if(k % 4 = 0, 0, {a} - (k * 6007 % 1500000) * 1000)").alias("last_success_ms"),
        F.expr("k % 6 = 0").alias("kcp_connected"),
    )


def adverts(spark, sf_dir) -> DataFrame:
    """Advertisements heard by each owner, in arrival order ``seq``."""
    return _events(spark, sf_dir).select(
        F.expr("concat('n', user_id % 25)").alias("owner"),
        F.expr(_node("(user_id + 1)")).alias("node"),
        F.expr(f"if(event_id % 4 = 0, NULL, {_node('(event_id % 50 + 1)')})").alias("source"),
        F.expr("cast(event_id % 10 AS int)").alias("advertised_hops"),
        F.expr("""if(event_id % 5 = 0, NULL, named_struct(
              'accepting_ingress', true,
              'max_kcp_links', 512L, 'current_kcp_links', event_id % 512,
              'max_ingress_streams', 4096L, 'current_ingress_streams', event_id % 4096,
              'max_ingress_bytes_per_second', 0L, 'current_ingress_bytes_per_second', 0L,
              'updated_at_ms', ts_ms))""").alias("capability"),
        F.expr("event_id % 7 = 0").alias("connected"),
        "ts_ms", F.col("event_id").alias("seq"),
    )


def route_events(spark, sf_dir) -> DataFrame:
    return _events(spark, sf_dir).select(
        F.expr("concat('n', user_id % 25)").alias("owner"),
        F.col("user_id").alias("node"),
        F.expr("""CASE event_type WHEN 'signup' THEN 'advert' WHEN 'click' THEN 'attempt'
                    WHEN 'view' THEN 'success' WHEN 'error' THEN 'failure'
                    ELSE 'disconnect' END""").alias("kind"),
        F.expr("event_type = 'view' AND event_id % 2 = 0").alias("connected"),
        "ts_ms", F.col("event_id").alias("seq"),
    )


def fleet_log(spark, sf_dir) -> DataFrame:
    """Adverts and health events of the owners' routes in one order."""
    return adverts(spark, sf_dir).join(
        _events(spark, sf_dir).select(F.col("event_id").alias("seq"), F.expr(
            """CASE WHEN event_id % 3 = 0 OR event_type = 'signup' THEN 'advert'
                 WHEN event_type = 'click' THEN 'attempt' WHEN event_type = 'view' THEN 'success'
                 WHEN event_type = 'error' THEN 'failure' ELSE 'disconnect' END""").alias("kind")), "seq")


def ingress(spark, sf_dir) -> DataFrame:
    return _events(spark, sf_dir).select(
        F.expr("user_id % 10").alias("node"),
        F.expr("(user_id % 10) * 4294967296 + user_id + 1").alias("stream_id"),
        F.expr("""CASE event_type WHEN 'signup' THEN 'Connected' WHEN 'purchase' THEN 'Closed'
                    ELSE 'Data' END""").alias("kind"),
        F.expr("cast(round(value * 20) AS int)").alias("bytes"),
        F.expr(f"(ts_ms - {AS_OF_MS}) DIV 10000").alias("t_ms"),
        F.col("event_id").alias("seq"),
    )


def links(spark, sf_dir) -> DataFrame:
    """Directed peer links; the modulus is the number of suppliers."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("s"))
    n = s.agg(F.count("*")).scalar()
    both = s.select("s", F.explode(F.array((7 * F.col("s") + 3) % n,
                                           (11 * F.col("s") + 5) % n)).alias("b"))
    return both.filter("s <> b").select(F.col("s").alias("a"), "b").distinct()


def origins(spark, sf_dir) -> DataFrame:
    """The nodes whose messages are followed: all of them."""
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("origin"))


def peers(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(
        F.expr("lpad(lower(hex(s_suppkey + 1)), 64, '0')").alias("peer_id"),
        F.expr("concat('10.2.', s_suppkey % 256, '.', s_nationkey)").alias("addr"),
        F.expr("cast(9000 + s_suppkey % 1000 AS int)").alias("port"),
    )


def hellos(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    a = AS_OF_MS
    return c.select(
        "k",
        F.expr("if(k % 10 = 1, 'bye', 'hello')").alias("type"),
        F.expr("if(k % 10 = 2, 2, 1)").alias("version"),
        F.expr("if(k % 10 = 3, 'other', 'self')").alias("target"),
        F.expr("if(k % 17 = 0, '', concat('h', k))").alias("host"),
        F.expr("k % 70000").alias("port"),
        F.expr("lpad(lower(hex(k)), 64, '0')").alias("id"),
        F.expr(f"{a} + (k % 25 - 12) * 60000").alias("ts_ms"),
        F.expr("repeat('ab', if(k % 10 = 4, 30, 32))").alias("nonce"),
        F.expr("repeat('cd', 64)").alias("signature"),
        F.lit(a).alias("now_ms"),
    )


def device_names(spark, sf_dir) -> DataFrame:
    """Device names and topics as devices write them: well-formed, odd and wrong."""
    return _events(spark, sf_dir).select(
        "event_id", "mac12",
        F.expr(f"""CASE event_id % 7 WHEN 0 THEN concat('  ', upper({COLON}), ' ')
              WHEN 1 THEN {DASHED} WHEN 2 THEN mac12
              WHEN 3 THEN concat_ws('.', substr(mac12, 1, 4), substr(mac12, 5, 4), substr(mac12, 9))
              WHEN 4 THEN concat('Device-', user_id) WHEN 5 THEN ''
              ELSE concat(substr(mac12, 1, 6), ' ', substr(mac12, 7)) END""").alias("mac"),
        F.expr(f"""CASE event_id % 5 WHEN 0 THEN {TOPIC} WHEN 1 THEN concat({TOPIC}, '/extra')
              WHEN 2 THEN concat('devices/', mac12, '/telemetry')
              WHEN 3 THEN concat('/devices/a/b/devices/', mac12, '/telemetry') ELSE '' END""")
        .alias("topic"),
    )

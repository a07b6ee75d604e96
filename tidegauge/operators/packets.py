"""Packet classification by first-match rules, hit statistics and the hit log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidegauge import schema as S
from tidegauge.session import checkpointed

RULES_UNROLLED = 64
RULES_PER_BLOCK = 1024
BROADCAST_RULES = 200_000
JOINS_PER_STAGE = 6
LOG_PATTERN = (r"^Time: (\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})  From (\S+) To (\S+) "
               r"(\S+) PROTOCOL was (\S+)$")


def code_name(code: Column, names: dict[int, str], unknown: str) -> Column:
    out = F.lit(unknown)
    for number, name in names.items():
        out = F.when(code == number, name).otherwise(out)
    return out


def name_code(name: Column, names: dict[int, str]) -> Column:
    """Code of a name, NULL for unknown names."""
    out = F.lit(None).cast("int")
    for number, text in names.items():
        out = F.when(name == text, number).otherwise(out)
    return out


def packet_ok(packet) -> Column:
    """Only packets with a whole header, of at least five words, are matched."""
    return packet("hdr_words") >= 5


def ifname_ok(rule, packet) -> Column:
    name = rule("ifname")
    into, out = name == packet("in_if"), name == packet("out_if")
    chain = packet("chain")
    return (name == "") | ((chain == 0) & into) | ((chain == 1) & out) | (
        (chain == 2) & (into | out))


def ip_ok(rule, packet) -> Column:
    return (((rule("src") == "") | (rule("src") == packet("src")))
            & ((rule("dst") == "") | (rule("dst") == packet("dst")))
            & ((rule("protocol") == 0) | (rule("protocol") == packet("protocol"))))


def transport_ok(rule, packet) -> Column:
    ports = (((rule("sport") == 0) | (rule("sport") == packet("sport")))
             & ((rule("dport") == 0) | (rule("dport") == packet("dport"))))
    flags = ((rule("ack") == packet("ack")) & (rule("fin") == packet("fin"))
             & (rule("syn") == packet("syn")) & (rule("rst") == packet("rst")))
    kind = (rule("type") == packet("type")) & (rule("code") == packet("code"))
    extra = rule("extra")
    protocol = packet("protocol")
    return (F.when(protocol == 6, ports & (~extra | flags))
            .when(protocol == 17, ports)
            .when(protocol.isin(1, 2), ~extra | kind)
            .otherwise(False))


def matches(rule, packet) -> Column:
    return ifname_ok(rule, packet) & ip_ok(rule, packet) & transport_ok(rule, packet)


RULE_FIELDS = ("rule_no", "action", "src", "dst", "sport", "dport", "protocol", "ifname", "extra",
               "syn", "ack", "fin", "rst", "type", "code")


def _rule_blocks(rules: DataFrame) -> list[DataFrame]:
    """Rule lists per chain, in blocks small enough to broadcast, first rules first."""
    n = rules.count()
    listed = F.sort_array(F.collect_list(F.struct(*RULE_FIELDS))).alias("_rules")
    if n <= RULES_PER_BLOCK:
        return [rules.groupBy("chain").agg(listed)]
    place = F.row_number().over(Window.partitionBy("chain").orderBy("rule_no")) - 1
    numbered = rules.withColumn("_block", F.floor(place / RULES_PER_BLOCK))
    blocks = -(-n // RULES_PER_BLOCK)
    return [numbered.filter(F.col("_block") == b).groupBy("chain").agg(listed)
            for b in range(blocks)]


def _unrolled(rules: list) -> Column:
    """First match as a chain of conditions, in rule order; constants that match anything fold
    away, and a packet is compared only up to its first match."""
    hit = None
    for rule in sorted(rules, key=lambda r: (r["chain"], r["rule_no"])):
        found = (F.col("chain") == rule["chain"]) & matches(lambda f, r=rule: F.lit(r[f]), F.col)
        value = F.struct(F.lit(rule["rule_no"]).alias("rule_no"),
                         F.lit(rule["action"]).alias("rule_action"))
        hit = F.when(found, value) if hit is None else hit.when(found, value)
    return F.lit(None).cast("struct<rule_no:int,rule_action:int>") if hit is None else hit


def classify_packets(packets: DataFrame, rules: DataFrame) -> DataFrame:
    """Add ``rule_no`` and ``rule_action`` of the first rule of the packet's chain to match.

    Packets are not multiplied. A short rule table, the usual case, becomes one conditional
    expression. Of a longer one, rules that ask for the same fields are found by one equi-join.
    """
    few = rules.limit(RULES_UNROLLED + 1).collect()
    if len(few) <= RULES_UNROLLED:
        out = packets.withColumn("_hit", F.when(packet_ok(F.col), _unrolled(few)))
    else:
        out = _tuple_space(packets, rules)
    return out.select(*packets.columns, "_hit.rule_no", "_hit.rule_action")


# Packet columns that a group of rules may ask for, beside chain and protocol.
_ASKED = {"src": ["src"], "dst": ["dst"], "sport": ["sport"], "dport": ["dport"],
          "flags": ["syn", "ack", "fin", "rst"], "kind": ["type", "code"],
          "in_if": ["in_if"], "out_if": ["out_if"]}


def _asking(rules: DataFrame) -> DataFrame:
    """Each rule once for every protocol and side it applies to, with ``_asks``: what it asks for.

    The protocols are those that any rule can match. Ports mean nothing to ICMP and IGMP, flags are
    TCP's, kinds those of ICMP and IGMP. A rule on the interface of a forwarded packet applies to
    either side.
    """
    protocol = F.explode(F.when(F.col("protocol") == 0, F.array(*map(F.lit, S.PROTOCOLS))).otherwise(
        F.array("protocol"))).alias("protocol")
    rest = [c for c in ("chain", *RULE_FIELDS) if c != "protocol"]
    each = rules.select(*rest, protocol).filter(F.col("protocol").isin(*S.PROTOCOLS))
    side = F.when(F.col("ifname") == "", F.array(F.lit(""))).when(
        F.col("chain") == 0, F.array(F.lit("in_if"))).when(
        F.col("chain") == 1, F.array(F.lit("out_if"))).otherwise(F.array(F.lit("in_if"), F.lit("out_if")))
    each = each.withColumn("_side", F.explode(side))
    ported = F.col("protocol").isin(6, 17)
    asked = {"src": F.col("src") != "", "dst": F.col("dst") != "",
             "sport": ported & (F.col("sport") != 0), "dport": ported & (F.col("dport") != 0),
             "flags": F.col("extra") & (F.col("protocol") == 6),
             "kind": F.col("extra") & F.col("protocol").isin(1, 2)}
    names = [F.when(on, F.lit(n)) for n, on in asked.items()]
    return each.withColumns({"in_if": F.col("ifname"), "out_if": F.col("ifname")}).withColumn(
        "_asks", F.concat_ws(",", *names, F.nullif("_side", F.lit(""))))


def _firsts(asking: DataFrame) -> DataFrame:
    """The first rule of each set and its values; what a set does not ask for is NULL."""
    asks = F.split("_asks", ",")
    values = [F.when(F.array_contains(asks, n), F.col(c)).alias(c) for n, cols in _ASKED.items() for c in cols]
    named = asking.select("_asks", "chain", "protocol", *values, F.struct(
        "rule_no", F.col("action").alias("rule_action")).alias("_rule"))
    keys = [c for c in named.columns if c != "_rule"]
    return named.groupBy(*keys).agg(F.min("_rule").alias("_first"))


def _tuple_space(packets: DataFrame, rules: DataFrame) -> DataFrame:
    """Add ``_hit`` by tuple-space search: one equi-join for each set of fields that rules ask for.

    The work per packet follows the number of such sets, at most 144, and not that of the rules. A
    set's rules with the same values are one: the first of them. A set's table is broadcast if these
    are few, however many rules they stand for, else joined by its keys.
    """
    firsts = checkpointed(_firsts(_asking(rules)))
    sets = {r["_asks"]: r["n"] for r in firsts.groupBy("_asks").agg(F.count("*").alias("n")).collect()}
    hit = F.lit(None).cast("struct<rule_no:int,rule_action:int>")
    out, names = packets.withColumn("_hit", hit), sorted(sets)
    for at in range(0, len(names), JOINS_PER_STAGE):
        found = []
        for i, asks in enumerate(names[at:at + JOINS_PER_STAGE]):
            keys = ["chain", "protocol", *[c for n in asks.split(",") if n for c in _ASKED[n]]]
            first = firsts.filter(F.col("_asks") == asks).select(*keys, F.col("_first").alias(f"_found{i}"))
            out = out.join(F.broadcast(first) if sets[asks] <= BROADCAST_RULES else first, keys, "left")
            found.append(f"_found{i}")
        # The lambda ends the generated method here: with all joins in one, it would not be compiled.
        known = F.filter(F.array("_hit", *found), lambda x: x.isNotNull())
        out = out.withColumn("_hit", F.array_min(known)).drop(*found)
    return out.withColumn("_hit", F.when(packet_ok(F.col), F.col("_hit")))


def first_match(packets: DataFrame, rules: DataFrame) -> DataFrame:
    """The same choice as a ranking: the smallest number among the matching rules.

    Rules are searched one by one in blocks; of more rules than a block has, by the sets of fields
    they ask for.
    """
    if len(rules.select("chain").limit(RULES_PER_BLOCK + 1).collect()) > RULES_PER_BLOCK:
        return _tuple_space(packets, rules).select(*packets.columns, "_hit.rule_no")
    out = packets.withColumn("rule_no", F.lit(None).cast("int"))
    for block in _rule_blocks(rules):
        numbers = F.transform("_rules", lambda r: F.when(
            matches(lambda f: r[f], F.col), r["rule_no"]))
        best = F.when(packet_ok(F.col), F.array_min(numbers))
        out = (out.join(F.broadcast(block), "chain", "left")
               .withColumn("rule_no", F.least("rule_no", best)).drop("_rules"))
    return out.select(*packets.columns, "rule_no")


def count_matching(packets: DataFrame, rules: DataFrame, predicate) -> DataFrame:
    """Add ``matching``: how many rules of the packet's chain fulfil a predicate on (rule, packet)."""
    out = packets.withColumn("matching", F.lit(0))
    for block in _rule_blocks(rules):
        hits = F.filter("_rules", lambda r: predicate(lambda f: r[f], F.col))
        here = F.coalesce(F.when(F.col("_rules").isNotNull(), F.size(hits)), F.lit(0))
        out = (out.join(F.broadcast(block), "chain", "left")
               .withColumn("matching", F.col("matching") + here).drop("_rules"))
    return out


def apply_actions(classified: DataFrame, default_action: int = 1, disabled: bool = False) -> DataFrame:
    """Add ``action`` and ``hit``: the rule's action, else the default; all pass when disabled."""
    if disabled:
        return classified.withColumn("action", F.lit(1)).withColumn("hit", F.lit(False))
    return (classified.withColumn("action", F.coalesce("rule_action", F.lit(default_action)))
            .withColumn("hit", F.col("rule_no").isNotNull()))


def rule_stats(applied: DataFrame, rules: DataFrame) -> DataFrame:
    """Hits per rule, rules without hits included."""
    hits = applied.filter("hit").groupBy("chain", "rule_no").agg(F.count("*").alias("hits"))
    return (rules.select("chain", "rule_no", "action")
            .join(hits, ["chain", "rule_no"], "left")
            .withColumn("hits", F.coalesce("hits", F.lit(0).cast("bigint"))))


def totals(stats: DataFrame) -> DataFrame:
    return stats.agg(F.count("*").alias("rules"), F.coalesce(F.sum("hits"), F.lit(0)).alias("hits"))


def list_rules(rules: DataFrame, chain: int | None = None) -> DataFrame:
    """Rules of one chain or of all, in chain and list order, with names for codes."""
    chosen = rules if chain is None else rules.filter(F.col("chain") == chain)
    return chosen.orderBy("chain", "rule_no").select(
        code_name(F.col("chain"), S.CHAINS, "unknown").alias("chain_name"), "rule_no",
        code_name(F.col("action"), S.ACTIONS, "NOTSET").alias("action_name"),
        F.when(F.col("src") == "", "0.0.0.0").otherwise(F.col("src")).alias("source"), "sport",
        F.when(F.col("dst") == "", "0.0.0.0").otherwise(F.col("dst")).alias("dest"), "dport",
        "protocol")


def log_time(ts: Column) -> Column:
    """Wall time, at the log's fixed offset from UTC, of an instant."""
    return ts.cast("timestamp_ntz") + F.expr(f"INTERVAL '{S.LOG_UTC_OFFSET_HOURS}' HOUR")


def hit_log_lines(applied: DataFrame, paused: bool = False) -> DataFrame:
    """One line of text per matched packet; none while logging is paused."""
    hits = applied.filter(F.col("hit") & ~F.lit(paused))
    return hits.select(F.format_string(
        "Time: %s  From %s To %s %s PROTOCOL was %s",
        F.date_format(log_time(F.col("ts")), "yyyy-MM-dd HH:mm:ss"), "src", "dst",
        code_name(F.col("protocol"), S.PROTOCOLS, "unknown"),
        code_name(F.col("action"), S.ACTIONS, "UNKNOWN")).alias("value"))


def parse_hit_log(lines: DataFrame) -> DataFrame:
    """Columns of hit log lines; lines of another form are left out."""
    good = lines.filter(F.col("value").rlike(LOG_PATTERN))

    def part(i):
        return F.regexp_extract("value", LOG_PATTERN, i)

    return good.select(
        F.to_timestamp_ntz(part(1), F.lit("yyyy-MM-dd HH:mm:ss")).alias("log_time"),
        part(2).alias("src"), part(3).alias("dst"), part(4).alias("protocol_name"),
        part(5).alias("action_name"))

"""Route tables of the fleet: health, scores, choices, merging and next hops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidegauge import schema as S
from tidegauge.functions.payload import hex_id
from tidegauge.plans.segments import rank_across, top_per_key

ZERO_ID = "0" * 64


def node_valid(node: Column) -> Column:
    """An endpoint with host, port and a non-zero id; false for a NULL node."""
    ok = (node["host"] != "") & (node["port"] != 0) & (node["id"] != ZERO_ID)
    return F.coalesce(ok, F.lit(False))


def valid_routes(routes: DataFrame) -> DataFrame:
    return routes.filter(node_valid(F.col("node")))


def route_state(text: Column) -> Column:
    return F.when(text.isin("tried", "bad"), text).otherwise("new")


def is_terrible(as_of: int) -> Column:
    """Not worth keeping; a route tried within the last minute is never judged."""
    last_try, last_seen = F.col("last_try_ms"), F.col("last_seen_ms")
    success = F.col("last_success_ms")
    return (
        F.when((last_try != 0) & (last_try >= as_of - S.RETRY_BACKOFF_MS), False)
        .when(last_seen > as_of + S.ROUTE_FUTURE_SKEW_MS, True)
        .when((last_seen == 0) | (last_seen < as_of - S.ROUTE_STALE_MS), True)
        .when((success == 0) & (F.col("attempts") >= S.GIVE_UP_ATTEMPTS), True)
        .when((success != 0) & (success < as_of - S.SUCCESS_STALE_MS)
              & (F.col("failures") >= S.BAD_FAILURES), True)
        .otherwise(False)
    )


def in_retry_backoff(as_of: int) -> Column:
    last_try = F.col("last_try_ms")
    return (last_try != 0) & (last_try > as_of - S.RETRY_BACKOFF_MS)


def route_chance(as_of: int) -> Column:
    last_try, state = F.col("last_try_ms"), F.col("state")
    recent = (last_try != 0) & (last_try > as_of - S.RECENT_TRY_MS)
    attempts = F.least(F.col("attempts"), F.lit(8)).cast("double")
    # 0.01 for a recent try, 0.66 per attempt, 1.25 for tried, 0.05 for bad routes.
    chance = F.when(recent, 0.01).otherwise(1.0) * F.pow(F.lit(0.66), attempts)
    return chance * F.when(state == "tried", 1.25).when(state == "bad", 0.05).otherwise(1.0)


def capability_score(as_of: int) -> Column:
    """1 without a report, 0 when full or refusing, 0.5 when the report is old, else by load."""
    cap = F.col("capability")
    pairs = [("max_kcp_links", "current_kcp_links"),
             ("max_ingress_streams", "current_ingress_streams"),
             ("max_ingress_bytes_per_second", "current_ingress_bytes_per_second")]
    full, load = F.lit(False), F.lit(0.0)
    for limit, used in pairs:
        limited = cap[limit] != 0
        full = full | (limited & (cap[used] >= cap[limit]))
        share = cap[used].cast("double") / F.when(limited, cap[limit].cast("double"))
        load = F.greatest(load, F.coalesce(share, F.lit(0.0)))
    load = F.greatest(F.lit(0.0), F.least(F.lit(1.0), load))
    stale = (cap["updated_at_ms"] != 0) & (cap["updated_at_ms"] < as_of - S.CAPABILITY_STALE_MS)
    return (F.when(cap.isNull(), 1.0).when(~cap["accepting_ingress"], 0.0).when(stale, 0.5)
            .when(full, 0.0).otherwise(0.1 + 0.9 * (1.0 - load)))


def route_score(as_of: int) -> Column:
    score = route_chance(as_of) * capability_score(as_of)
    hops = F.col("hop_count")
    return F.when(hops > 1, score / hops.cast("double")).otherwise(score)


def local_hops(source_valid: Column, connected: Column, advertised: Column) -> Column:
    """Hops as seen from here: one more than advertised by the source, one when linked."""
    return (F.when(connected, 1).when(source_valid, F.least(advertised + 1, F.lit(255)))
            .otherwise(advertised).cast("int"))


def with_health(routes: DataFrame, as_of: int) -> DataFrame:
    return routes.withColumns({
        "terrible": is_terrible(as_of), "backoff": in_retry_backoff(as_of),
        "chance": route_chance(as_of), "cap_score": capability_score(as_of),
        "score": route_score(as_of),
    })


# --- choices per owner --------------------------------------------------------------------

def _best_per_owner(candidates: DataFrame, order) -> DataFrame:
    # A filter on row_number keeps one row per owner in each map task before the shuffle.
    w = Window.partitionBy("owner").orderBy(*order)
    return candidates.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def pick_probe(routes: DataFrame, as_of: int) -> DataFrame:
    """The best route of each owner to try next; equal scores go to the smaller id."""
    fit = valid_routes(routes).filter(
        ~F.col("kcp_connected") & (F.col("state") != "bad") & ~is_terrible(as_of)
        & ~in_retry_backoff(as_of)).withColumn("score", route_score(as_of))
    return _best_per_owner(fit.filter("score > 0"), [F.desc("score"), F.col("node.id")])


def pick_default_hop(routes: DataFrame, as_of: int) -> DataFrame:
    """The best linked route of each owner."""
    fit = valid_routes(routes).filter(F.col("kcp_connected") & (F.col("state") != "bad")) \
        .withColumn("score", route_score(as_of))
    return _best_per_owner(fit.filter("score > 0"), [F.desc("score"), F.col("node.id")])


def sample_routes(routes: DataFrame, as_of: int, salt: str = "",
                  max_routes: int = S.RESPONSE_MAX_ROUTES,
                  percent: int = S.RESPONSE_PERCENT) -> DataFrame:
    """A spread sample of each owner's healthy routes: a share of them, up to ``max_routes``.

    Which ones is decided by a salted hash of the id, so that a rerun gives the same sample.
    """
    fit = valid_routes(routes).filter(~is_terrible(as_of) & (F.col("state") != "bad"))
    fit = fit.withColumn("_draw", F.md5(F.concat(F.lit(salt), "node.id")))
    share = F.expr(f"(count(1) * {percent} + 99) DIV 100")
    sizes = fit.groupBy("owner").agg(
        F.greatest(F.lit(1), F.least(F.lit(max_routes), share)).alias("_size"))
    drawn = top_per_key(fit, ["owner"], ["_draw"], max_routes, F.col("node.id"), "_place")
    return drawn.join(sizes, "owner").filter("_place <= _size").drop("_draw", "_place", "_size")


def reconnect_order(routes: DataFrame) -> DataFrame:
    """Place of each route in the order its owner reconnects: tried ones, latest success first."""
    fit = valid_routes(routes).filter(~F.col("kcp_connected") & (F.col("state") != "bad"))
    untried = F.when(F.col("state") == "tried", 0).otherwise(1)
    days = F.expr("last_success_ms DIV 86400000")
    segment = untried.cast("bigint") * 1_000_000_000 - days
    return rank_across(fit, ["owner"], segment,
                       [F.desc("last_success_ms"), F.col("node.id")], "place")


def trim_routes(routes: DataFrame, as_of: int, max_routes: int = S.MAX_ROUTES) -> DataFrame:
    """Routes an owner keeps when its table is full.

    A full table loses its hopeless routes without link; if it is still full, the one route
    without link that scores lowest (bad ones a hundredth) goes too.
    """
    valid = valid_routes(routes)
    weak = ~F.col("kcp_connected") & is_terrible(as_of)
    # 0.01 is a fixed value.
    rank = route_score(as_of) * F.when(F.col("state") == "bad", 0.01).otherwise(1.0)
    judged = valid.withColumn("_weak", weak).withColumn("_rank", rank)
    keys = F.struct("_rank", F.col("node.id").alias("id"))
    tables = judged.groupBy("owner").agg(
        F.count("*").alias("_n"), F.count_if(~F.col("_weak")).alias("_kept"),
        F.min(F.when(~F.col("kcp_connected") & ~F.col("_weak"), keys)).alias("_victim"))
    full = F.col("_n") >= max_routes
    evicted = full & (F.col("_kept") >= max_routes) & F.col("_victim").isNotNull() & (
        F.col("node.id") == F.col("_victim.id"))
    return (judged.join(tables, "owner")
            .filter(~(full & F.col("_weak")) & ~F.coalesce(evicted, F.lit(False)))
            .select(*routes.columns))


def route_counts(routes: DataFrame, max_links: int = S.MAX_LINKS) -> DataFrame:
    """Routes and links per owner, and whether one more link is allowed."""
    counts = valid_routes(routes).groupBy("owner").agg(
        F.count("*").alias("routes"), F.count_if("kcp_connected").alias("links"))
    return counts.withColumn("can_add_link", F.col("links") < max_links)


def resolve_next_hop(routes: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """Next hop to each target (owner, target_id): itself when linked, else its source when that
    is linked and not bad, else none (NULL). Default targets: all known routes."""
    known = valid_routes(routes).select(
        "owner", F.col("node.id").alias("target_id"), "state", "kcp_connected", "hop_count",
        F.col("source.id").alias("_via"))
    if targets is not None:
        known = targets.join(known, ["owner", "target_id"], "left")
    relays = (valid_routes(routes).filter(F.col("kcp_connected") & (F.col("state") != "bad"))
              .select("owner", F.col("node.id").alias("_via"), F.col("node.id").alias("_relay")))
    usable = F.col("state").isNotNull() & (F.col("state") != "bad")
    direct = usable & F.col("kcp_connected")
    # Only targets that a relay could reach go and look for it: the others have no key to meet by.
    wanting = F.coalesce(usable & ~F.col("kcp_connected") & F.col("_via").isNotNull(), F.lit(False))
    none = F.lit(None).cast("string").alias("_relay")
    joined = known.filter(wanting).join(relays, ["owner", "_via"], "left").unionByName(
        known.filter(~wanting).select("*", none))
    via = F.col("_relay").isNotNull()
    return joined.select(
        "owner", "target_id",
        F.when(direct, F.col("target_id")).when(via, F.col("_relay")).alias("next_hop_id"),
        F.when(direct, True).when(via, False).alias("direct"),
        F.when(direct, 1).when(via, F.col("hop_count")).alias("hop_count"))


# --- merging and health -------------------------------------------------------------------

def heard_adverts(adverts: DataFrame, max_hops: int = S.MAX_ROUTE_HOPS) -> DataFrame:
    """Adverts that count: of a valid node within the hop limit, with ``hops`` as seen from here and
    without a source that is none."""
    source_valid = node_valid(F.col("source"))
    return (adverts.filter(node_valid(F.col("node")))
            .withColumn("hops", local_hops(source_valid, F.col("connected"), F.col("advertised_hops")))
            .filter(F.col("hops") <= max_hops)
            .withColumn("source", F.when(source_valid, F.col("source"))))


def merge_routes(adverts: DataFrame) -> DataFrame:
    """Route table that adverts add up to, one row per (owner, node).

    The newest advert gives address and time, the newest with a report the capability. The path
    is the first advert's, unless a sourced advert is shorter or the first one told no distance;
    of equal paths the earlier stays. A linked node is one hop away and has no source, except that
    a first advert that is linked keeps its own; adverts after a link change no path. Adverts over
    the hop limit do not count.
    """
    return _merged(heard_adverts(adverts))


def _merged(heard: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """``links`` (owner, node, seq) are the times at which a route was found to be linked."""
    path = F.struct("hops", "source")
    sourced = F.col("source").isNotNull()
    merged = heard.groupBy("owner", F.col("node.id").alias("node_id")).agg(
        F.max_by("node", "seq").alias("node"),
        F.max_by("ts_ms", "seq").alias("last_seen_ms"),
        F.max_by("capability", F.when(F.col("capability").isNotNull(), F.col("seq")))
        .alias("capability"),
        F.min_by(path, F.col("seq")).alias("_first"),
        F.min_by(path, F.when(sourced, F.struct("hops", "seq"))).alias("_best"),
        F.min("seq").alias("_born"), F.min_by("connected", "seq").alias("_born_linked"),
        F.max(F.when(F.col("connected"), F.col("seq"))).alias("_linked"),
    )
    if links is not None:
        again = links.groupBy("owner", F.col("node.id").alias("node_id")).agg(F.max("seq").alias("_again"))
        merged = merged.join(again, ["owner", "node_id"], "left").withColumn(
            "_linked", F.greatest("_linked", "_again"))
    linked_later = F.coalesce(F.col("_linked") > F.col("_born"), F.lit(False))
    better = F.col("_best").isNotNull() & ~F.col("_born_linked") & (
        (F.col("_first.hops") == 0) | (F.col("_best.hops") < F.col("_first.hops")))
    chosen = F.when(better, F.col("_best")).otherwise(F.col("_first"))
    return merged.select(
        "owner", "node_id", "node", "capability", "last_seen_ms",
        F.when(linked_later, 1).otherwise(chosen["hops"]).alias("hop_count"),
        F.when(~linked_later, chosen["source"]).alias("source"))


def route_table(log: DataFrame) -> DataFrame:
    """What each owner knows of each node after all adverts, attempts, successes, failures and
    disconnects: address, path, report, state, counters, link and times.

    ``log`` has owner, node, seq, ts_ms, kind and connected, and for adverts source,
    advertised_hops and capability. Events before a node's first advert do not count. A link, also
    one that a success tells of, puts the node one hop away for good: no later path is shorter.

    All parts are aggregations that combine before they shuffle, so the events of one route may be
    spread over any number of tasks.
    """
    known = log.filter(node_valid(F.col("node")))
    heard = heard_adverts(known.filter("kind = 'advert'"))
    others = known.filter("kind <> 'advert'")
    links = others.filter("kind = 'success' AND connected").select("owner", "node", "seq")
    columns = ["owner", F.col("node.id").alias("node"), "kind", "connected", "ts_ms", "seq"]
    health = route_health(heard.select(*columns).unionByName(others.select(*columns)))
    paths = _merged(heard, links).drop("last_seen_ms")
    return paths.join(health.withColumnRenamed("node", "node_id"), ["owner", "node_id"])


def route_health(events: DataFrame) -> DataFrame:
    """State of each (owner, node) after its events: advert, attempt, success, failure, disconnect.

    Events before the first advert do not count. A success clears the counters, so what remains
    is to count attempts and failures after the last success: the marks (first advert, last
    success) are found first and joined to the events, both steps combining before they shuffle.
    ``connected`` on a success or advert tells that a link exists.
    """
    key = ["owner", "node"]

    def when(kind, value):
        return F.when(F.col("kind") == kind, value)

    linked = F.col("connected") & F.col("kind").isin("advert", "success")
    marks_a = events.groupBy(*key).agg(F.min(when("advert", F.col("seq"))).alias("_born")) \
        .filter("_born IS NOT NULL")
    lived = events.join(marks_a, key).filter(F.col("seq") >= F.col("_born"))
    good = (F.col("kind") == "success") | linked
    marks_b = lived.groupBy(*key).agg(
        F.max(when("success", F.col("seq"))).alias("_cleared"),
        F.max(F.when(good, F.col("seq"))).alias("_good"))
    after = lived.join(marks_b, key)
    since_success = F.col("seq") > F.coalesce("_cleared", F.lit(-1))
    since_good = F.col("seq") > F.coalesce("_good", F.lit(-1))
    tries = F.col("kind").isin("attempt", "success", "failure")
    sightings = F.col("kind").isin("advert", "success")
    link_change = linked | F.col("kind").isin("failure", "disconnect")
    sums = after.groupBy(*key).agg(
        F.count_if((F.col("kind") == "attempt") & since_success).alias("attempts"),
        F.count_if((F.col("kind") == "failure") & since_good).alias("failures"),
        F.max_by("ts_ms", F.when(tries, F.col("seq"))).alias("_try"),
        F.max_by("ts_ms", F.when(sightings, F.col("seq"))).alias("last_seen_ms"),
        F.max_by("ts_ms", F.when(good, F.col("seq"))).alias("_success"),
        F.max_by(linked, F.when(link_change, F.col("seq"))).alias("_linked"),
        F.max(when("failure", F.col("seq"))).alias("_failed"),
        F.max(F.when((F.col("kind") == "advert") & ~linked, F.col("seq"))).alias("_heard"),
    )
    revived = F.col("_heard") > F.col("_failed")
    zero = F.lit(0).cast("bigint")
    state = (F.when((F.col("failures") >= S.BAD_FAILURES) & ~F.coalesce(revived, F.lit(False)), "bad")
             .when(F.col("failures") >= S.BAD_FAILURES, "new")
             .when(F.col("_success").isNotNull(), "tried").otherwise("new"))
    return sums.select(
        *key, state.alias("state"), "attempts", "failures",
        F.coalesce("_linked", F.lit(False)).alias("kcp_connected"), "last_seen_ms",
        F.coalesce("_try", zero).alias("last_try_ms"),
        F.coalesce("_success", zero).alias("last_success_ms"))


def hello_valid(local_target: str = "self") -> Column:
    """Whether a logged handshake was well-formed, addressed to us and timely."""
    skew = F.abs(F.col("ts_ms") - F.col("now_ms"))
    return F.coalesce(
        (F.col("type") == "hello") & (F.col("version") == 1) & (F.col("target") == local_target)
        & F.col("host").isNotNull() & F.col("port").between(1, 65535)
        & hex_id(F.col("id")).isNotNull() & (skew <= S.HELLO_SKEW_MS)
        & hex_id(F.col("nonce")).isNotNull() & hex_id(F.col("signature"), 128).isNotNull(),
        F.lit(False))


def parse_capability(text: Column) -> Column:
    """Capability report of a JSON text, NULL when it is no object.

    A field that is missing or no unsigned 64-bit integer counts as 0, a missing
    ``accepting_ingress`` as true. Counters are DECIMAL(20,0), which holds all of them; the time is
    a signed BIGINT.
    """
    numbers = [f.name for f in S.CAPABILITY.fields if f.name != "accepting_ingress"]
    raw = F.from_json(text, "accepting_ingress BOOLEAN, "
                      + ", ".join(f"{n} DECIMAL(38,0)" for n in numbers))
    written = F.from_json(text, ", ".join(f"{n} STRING" for n in numbers))
    zero, most = F.lit(0).cast("decimal(20,0)"), F.lit(str(2**64 - 1)).cast("decimal(20,0)")

    def number(name):
        # A number in the text, not a quoted one, that is also spelled as an integer.
        kind = F.schema_of_variant(F.variant_get(F.try_parse_json(text), f"$.{name}", "variant"))
        unquoted = kind.rlike("^(BIGINT|DECIMAL)")
        if name == "updated_at_ms":
            whole = unquoted & written[name].rlike("^-?[0-9]{1,19}$")
            return F.coalesce(F.when(whole, raw[name].try_cast("bigint")), F.lit(0).cast("bigint"))
        whole = unquoted & written[name].rlike("^[0-9]+$") & (raw[name] <= most)
        return F.coalesce(F.when(whole, raw[name].cast("decimal(20,0)")), zero)

    report = F.struct(F.coalesce(raw["accepting_ingress"], F.lit(True)).alias("accepting_ingress"),
                      *[number(n).alias(n) for n in numbers])
    is_object = F.trim(text).startswith("{") & F.try_parse_json(text).isNotNull()
    return F.when(is_object, report)


def capability_json(capability: Column) -> Column:
    """Report text, NULL for no report."""
    return F.to_json(capability)


def union_nodes(first: DataFrame, second: DataFrame) -> DataFrame:
    """Seed nodes of two origins, one after the other, doubles included."""
    return first.unionByName(second)

"""Route snapshot documents: ``{"version": 1, "entries": [...]}``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tidegauge import schema as S
from tidegauge.functions.payload import hex_id
from tidegauge.operators.fleet import ZERO_ID, node_valid, route_state, valid_routes
from tidegauge.session import scratch

SNAPSHOT_VERSION = 1  # fixed value

_NODE = "host STRING, port BIGINT, public_key STRING, id STRING, convid STRING"
# Wider than the counters, so that what is none can be told from what is.
_CAPABILITY = ", ".join(
    f"{f.name}: {'DECIMAL(38,6)' if f.dataType == S.U64 else f.dataType.simpleString()}"
    for f in S.CAPABILITY.fields)
_ENTRY = (f"node STRUCT<{_NODE}>, state STRING, attempts BIGINT, failures BIGINT, "
          f"capability STRUCT<{_CAPABILITY}>, hop_count BIGINT, last_seen_ms BIGINT, "
          f"last_try_ms BIGINT, last_success_ms BIGINT, source STRUCT<{_NODE}>")
SNAPSHOT_DDL = f"owner STRING, version BIGINT, entries ARRAY<STRUCT<{_ENTRY}>>"


def snapshot_folder(spark: SparkSession) -> str:
    return scratch(spark, "route-snapshots")


def _node_out(node: Column) -> Column:
    return F.struct(node["host"].alias("host"), node["port"].alias("port"),
                    node["id"].alias("public_key"))


def write_route_snapshots(routes: DataFrame, path: str, local_id: Column | None = None) -> str:
    """Write one document for each owner, of its valid routes to other nodes in order of their ids;
    absent parts are left out.

    A document's lines are its head, one entry each and its foot. They are sorted by owner and
    streamed into the owner's file, so a document of any number of routes needs no list in memory.
    """
    kept = valid_routes(routes)
    if local_id is not None:
        kept = kept.filter(F.col("node.id") != local_id)
    source = F.col("source")
    entry = F.struct(
        _node_out(F.col("node")).alias("node"), "state", "attempts", "failures", "capability",
        "hop_count", "last_seen_ms", "last_try_ms", "last_success_ms",
        F.when(node_valid(source), _node_out(source)).alias("source"))
    lines = kept.select("owner", F.lit(1).alias("_line"), F.col("node.id").alias("_id"),
                        F.to_json(entry).alias("value"))
    owners = kept.select("owner").distinct()
    name = F.regexp_extract(F.to_json(F.struct("owner")), r'^\{"owner":(.*)\}$', 1)
    head = F.concat(F.lit('{"owner":'), name, F.lit(f',"version":{SNAPSHOT_VERSION},"entries":['))
    rows = (lines.unionByName(owners.select("owner", F.lit(0).alias("_line"), F.lit("").alias("_id"),
                                            head.alias("value")))
            .unionByName(owners.select("owner", F.lit(2).alias("_line"), F.lit("").alias("_id"),
                                       F.lit("]}").alias("value")))
            .withColumn("owner", F.coalesce("owner", F.lit(""))))
    # The window only counts lines as they pass; its order is the order of the file.
    order = Window.partitionBy("owner").orderBy("_line", "_id", "value")
    later = (F.row_number().over(order) > 2) & (F.col("_line") == 1)
    (rows.select("owner", F.concat(F.when(later, ",").otherwise(""), "value").alias("value"))
     .write.partitionBy("owner").text(path))
    return path


def _node_in(node: Column) -> Column:
    """Node with a checked endpoint and id, NULL when malformed."""
    name = F.coalesce(node["public_key"], node["id"], node["convid"])
    ident = hex_id(name)
    ok = node["host"].isNotNull() & node["port"].between(1, 65535) & ident.isNotNull()
    return F.when(ok, F.struct(node["host"].alias("host"), node["port"].alias("port"),
                               ident.alias("id")))


def read_route_snapshots(spark: SparkSession, path: str, as_of_ms: int,
                         local_id: Column | None = None, multi_line: bool = True) -> DataFrame:
    """Routes of snapshot documents of the supported version, one row per usable entry.

    Files hold one document each, or with ``multi_line`` off one a line. Links do not outlive a
    restart, so none is connected; a tried route without success starts as new. A counter that is no
    unsigned 64-bit integer counts as 0.
    """
    docs = spark.read.schema(SNAPSHOT_DDL).json(path, multiLine=multi_line, recursiveFileLookup=True)
    me = local_id if local_id is not None else F.lit(None).cast("string")
    zero = F.lit(0).cast("bigint")
    entries = (
        docs.filter((F.col("version") == SNAPSHOT_VERSION) & F.col("entries").isNotNull())
        .select("owner", me.alias("_me"), F.explode("entries").alias("e"))
        .select("owner", "_me", "e", _node_in(F.col("e.node")).alias("node"),
                _node_in(F.col("e.source")).alias("_source"))
        .filter(F.col("node").isNotNull() & (F.col("node.id") != ZERO_ID)
                & ~F.coalesce(F.col("node.id") == F.col("_me"), F.lit(False)))
    )
    cap = F.col("e.capability")
    most = F.lit(str(2**64 - 1)).cast("decimal(20,0)")

    def counter(field):
        value = cap[field.name]
        if field.dataType != S.U64:
            return F.greatest(F.coalesce(value, zero), zero)
        whole = (value >= 0) & (value <= most) & (value == F.floor(value))
        return F.when(whole, value.cast(S.U64)).otherwise(F.lit(0).cast(S.U64))

    report = F.when(cap.isNotNull(), F.struct(
        F.coalesce(cap["accepting_ingress"], F.lit(True)).alias("accepting_ingress"),
        *[counter(f).alias(f.name) for f in S.CAPABILITY.fields[1:]]))
    success = F.coalesce("e.last_success_ms", zero)
    state = route_state(F.col("e.state"))
    own = (F.col("_source.id") == F.col("node.id")) | F.coalesce(
        F.col("_source.id") == F.col("_me"), F.lit(False))
    return entries.select(
        "owner", "node", F.when(~own & (F.col("_source.id") != ZERO_ID), F.col("_source")).alias("source"),
        report.alias("capability"),
        F.when((state == "tried") & (success == 0), "new").otherwise(state).alias("state"),
        F.coalesce("e.attempts", zero).cast("int").alias("attempts"),
        F.coalesce("e.failures", zero).cast("int").alias("failures"),
        F.least(F.coalesce("e.hop_count", zero), F.lit(S.MAX_ROUTE_HOPS)).cast("int").alias("hop_count"),
        F.coalesce(F.nullif(F.col("e.last_seen_ms"), zero), F.lit(as_of_ms)).alias("last_seen_ms"),
        F.coalesce("e.last_try_ms", zero).alias("last_try_ms"),
        success.alias("last_success_ms"), F.lit(False).alias("kcp_connected"))

"""Streaming pipelines. Each is one query with its own checkpoint, so consumers of the same topic
keep independent positions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from tidegauge import schema as S
from tidegauge.functions.jsonfields import evaluated_once
from tidegauge.operators import envelopes as E
from tidegauge.operators import frames as R
from tidegauge.operators import gossip as G
from tidegauge.operators.admission import rate_limit
from tidegauge.operators.presence import dedupe_fixed, dedupe_sliding
from tidegauge.sources.tables import append_batch, append_messages
from tidegauge.streaming.state import dedupe_fixed_stream, dedupe_sliding_stream, rate_limit_stream
from tidegauge.streaming.stores import registry_rows_of, state_sessions


# What device state is made of: the rows that the relay and the edge have let through.
DELIVERED = T.StructType([
    T.StructField("mac_hex", T.StringType()), T.StructField("value", T.StringType()),
    T.StructField("arrival_ms", T.LongType()), T.StructField("partition", T.IntegerType()),
    T.StructField("offset", T.LongType())])


def _trigger(writer, available_now: bool):
    """All that is there, then stop; or micro-batches without a pause as long as rows wait.

    When a micro-batch is due is the source's rule: enough rows, or enough time.
    """
    return writer.trigger(availableNow=True) if available_now else writer


def ingest_stream(topic: DataFrame, table: str, quarantine: str, checkpoint: str,
                  available_now: bool = True, on_error: str = "quarantine"):
    """Topic rows to the device message table; bad rows to the quarantine with the reason.

    A micro-batch is written to folders of its own number before its offsets are committed. A
    batch that is repeated after a crash overwrites them, so each row is kept once.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        parsed = E.parse_envelopes(batch)
        if on_error == "fail":
            append_messages(E.device_messages(E.apply_bad_message_policy(parsed, "fail")), table,
                            batch_id)
            return
        kept = parsed.persist()
        try:
            append_messages(E.device_messages(kept), table, batch_id)
            if on_error == "quarantine":
                bad = E.apply_bad_message_policy(kept, "quarantine")
                append_batch(bad.select(*S.LANDING.fieldNames(), "error"), quarantine, batch_id)
        finally:
            kept.unpersist()

    writer = topic.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return _trigger(writer, available_now).start()


def registry_stream(topic: DataFrame, checkpoint: str, available_now: bool = True,
                    on_error: str = "skip"):
    """Topic rows to the device registry, which ``stores.read_registry`` reads from the checkpoint."""
    parsed = E.connections(E.parse_connections(topic))
    registry = registry_rows_of(E.apply_bad_message_policy(parsed, on_error))
    writer = (registry.writeStream.format("noop").outputMode("update")
              .option("checkpointLocation", checkpoint))
    return _trigger(writer, available_now).start()


def state_stream(messages: DataFrame, checkpoint: str, delay: str | None, expired: str | None = None,
                 available_now: bool = True, **ttls: int):
    """Messages (mac_hex, value, arrival_ms, partition, offset) to device state, which
    ``stores.read_state`` reads from the checkpoint.

    A query of its own beside the one that writes the messages: state that cannot be kept holds
    nothing else back. Entries that expire go to the table ``expired``, if it is named. With a delay of
    None entries are kept past their expiry, and nothing can go to that table.
    """
    if delay is None and expired:
        raise ValueError("without a delay nothing leaves the state")
    writer = state_sessions(messages, delay, **ttls).writeStream.outputMode(
        "append" if delay else "update").option("checkpointLocation", checkpoint)
    writer = writer.format("parquet").option("path", expired) if expired else writer.format("noop")
    return _trigger(writer, available_now).start()


def relay_stream(topic: DataFrame, peers: DataFrame, sent: str, delivered: str, checkpoint: str,
                 ttl_ms: int = S.SEEN_TTL_MS, available_now: bool = True):
    """Topic rows, without repeats, to the table ``delivered`` and to the peers each is passed on to.

    A row that names no message is one of its own: it gets an id made of its place in the topic.
    Device state follows from the delivered rows, by ``state_stream``.
    """
    parsed = E.parse_edge_json(topic).filter("accepted")
    fresh = dedupe_fixed_stream(parsed, "message_id", "arrival_ms", "offset", ttl_ms)

    def write(batch: DataFrame, batch_id: int) -> None:
        kept = batch.persist()
        try:
            append_batch(kept.select(*DELIVERED.fieldNames()), delivered, batch_id)
            place = F.concat_ws("-", F.lit("topic"), "partition", "offset")
            named = F.coalesce(F.nullif("message_id", F.lit("")), place).alias("message_id")
            routed = G.rendezvous_fanout(kept.select(named, "partition", "offset"), peers)
            append_batch(routed, sent, batch_id)
        finally:
            kept.unpersist()

    writer = fresh.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return _trigger(writer, available_now).start()


def inbound_gossip(packets: DataFrame, local_id: str) -> DataFrame:
    """Messages in received tunnel frames (seq, arrival_ms, packet) of the types that are passed on.

    Invalid frames and own messages are left out. A topic message that came without an envelope gets
    an id of its own here and starts with the default number of hops.
    """
    # Each decoding step is computed once, or its byte arithmetic is repeated in all that follows.
    frames = evaluated_once(R.decode_tunnel_frames(packets)).filter("valid")
    decoded = evaluated_once(R.decode_gossip(frames)).filter(
        (F.col("status") != "invalid") & F.col("type").isin(*G.RELAYED, "kafka_broadcast"))
    plain = F.col("status") == "plain"
    heard = decoded.filter(~plain & (F.col("origin") != local_id)
                           | plain & (F.col("type") == "kafka_broadcast"))
    return heard.select(
        "seq", "arrival_ms", "type", F.col("stream_id").cast("bigint").alias("stream_id"),
        F.when(plain, F.lit(local_id)).otherwise(F.col("origin")).alias("origin"),
        F.when(plain, F.concat_ws("-", F.lit("frame"), "seq")).otherwise(F.col("message_id"))
        .alias("message_id"),
        F.when(plain, 0).otherwise(F.col("ttl")).alias("ttl"), "body")


def outbound_gossip(fresh: DataFrame, peers: DataFrame) -> DataFrame:
    """Peers each fresh message goes on to, with the hops it has left."""
    relayed = F.when(F.col("ttl") > 1, F.col("ttl") - 1)
    ttl = F.when(F.col("type") == "kafka_broadcast", G.relay_kafka_ttl(F.col("ttl"))).otherwise(relayed)
    going = fresh.select("seq", "type", "message_id", ttl.cast("int").alias("ttl"))
    return G.rendezvous_fanout(going.filter("ttl IS NOT NULL"), peers)


def gossip_inbound(packets: DataFrame, local_id: str, peers: DataFrame, seen_ttl_ms: int) -> DataFrame:
    """Received frames to what is passed on: seq, type, message_id, ttl and peer_id."""
    heard = inbound_gossip(packets, local_id)
    fresh = dedupe_sliding(heard, list(G.GOSSIP_KEY), "arrival_ms", "seq", seen_ttl_ms)
    return outbound_gossip(fresh, peers)


def received_frames(packets: DataFrame, local_id: str, seen_ttl_ms: int) -> DataFrame:
    """Valid frames of any type that are neither our own nor a repeat, with their bodies.

    Only frames with an envelope can be recognised as repeats.
    """
    heard, plain = _heard_frames(packets, local_id)
    fresh = dedupe_sliding(heard, list(G.GOSSIP_KEY), "arrival_ms", "seq", seen_ttl_ms)
    return fresh.unionByName(plain)


def _heard_frames(packets: DataFrame, local_id: str) -> tuple[DataFrame, DataFrame]:
    """Frames in an envelope of another node, and those without envelope."""
    frames = evaluated_once(R.decode_tunnel_frames(packets)).filter("valid")
    decoded = evaluated_once(R.decode_gossip(frames))
    relayed = F.col("type").isin(*G.RELAYED, "kafka_broadcast")
    enveloped = relayed & (F.col("status") == "envelope")
    columns = ["seq", "arrival_ms", "type", F.col("stream_id").cast("bigint").alias("stream_id"), "origin",
               "message_id", "ttl"]
    heard = decoded.filter(enveloped & (F.col("origin") != local_id)).select(*columns, "body")
    none = F.lit(None).cast("string")
    plain = decoded.filter(~relayed | (F.col("status") == "plain")).withColumns(
        {"origin": none, "message_id": none, "ttl": F.lit(0),
         "body": F.when(relayed, F.col("body")).otherwise(F.col("payload"))}).select(*columns, "body")
    return heard, plain


def inbound_topic(packets: DataFrame, local_id: str, seen_ttl_ms: int, capacity: int,
                  ttl_ms: int = S.SEEN_TTL_MS, segment_ms: int = 50_000) -> DataFrame:
    """Topic messages in received frames that are recorded here and passed on.

    All frames draw on the node's byte budget in the order they arrive, and those it does not admit
    are lost. A topic message that cannot be read stops here; of one id, only the first within
    ``ttl_ms`` is recorded and passed on. The columns are those that device state is made of, the
    message's own id (``message_id``), and for the way on the envelope's id (``frame_id``) and the hops
    it has left (``ttl``, NULL at the last hop).
    """
    received = received_frames(packets, local_id, seen_ttl_ms).withColumns(
        {"node": F.lit(local_id), "size": F.octet_length("body")})
    admitted = rate_limit(received, capacity, ms="arrival_ms", seq="seq", size="size", segment_ms=segment_ms)
    parsed, bare = _topic_messages(admitted)
    return _recorded(dedupe_fixed(parsed, "message_id", "arrival_ms", "seq", ttl_ms).unionByName(bare))


def inbound_topic_stream(packets: DataFrame, local_id: str, seen_ttl_ms: int, capacity: int,
                         ttl_ms: int = S.SEEN_TTL_MS) -> DataFrame:
    """Stream form of ``inbound_topic``: three stateful steps one after the other.

    A stream that is used twice runs, and keeps its state, twice: so what follows a stateful step is one
    stream. Of other frames than topic messages only the size goes on to the byte budget.
    """
    heard, plain = _heard_frames(packets, local_id)
    heard, plain = (rows.withColumns({"node": F.lit(local_id), "size": F.octet_length("body"),
                                      "body": F.when(F.col("type") == "kafka_broadcast", F.col("body"))})
                    for rows in (heard, plain))
    fresh = dedupe_sliding_stream(heard, list(G.GOSSIP_KEY), "arrival_ms", "seq", seen_ttl_ms)
    admitted = rate_limit_stream(fresh.unionByName(plain), capacity, "node", "arrival_ms", "seq", "size",
                                 refused=False)
    topic = _topic_rows(admitted)
    empty = F.col("value") == ""
    parsed = evaluated_once(_parsed_topic(topic)).filter(empty | F.col("accepted"))
    readable = parsed.withColumns({"mac_hex": F.when(~empty, F.col("mac_hex")),
                                   "message_id": F.when(empty, "").otherwise(F.col("message_id"))})
    return _recorded(dedupe_fixed_stream(readable.select(*_TOPIC_COLUMNS), "message_id", "arrival_ms", "seq", ttl_ms))


_TOPIC_COLUMNS = ("seq", "arrival_ms", "frame_id", "ttl", "value", "mac_hex", "message_id")


def _topic_rows(marked: DataFrame) -> DataFrame:
    admitted = marked.filter((F.col("type") == "kafka_broadcast") & F.col("accepted"))
    frame = F.coalesce("message_id", F.concat_ws("-", F.lit("frame"), "seq")).alias("frame_id")
    return admitted.select(
        "seq", "arrival_ms", frame, F.col("message_id").alias("meta_id"), F.col("origin").alias("meta_origin"),
        G.relay_kafka_ttl(F.col("ttl")).alias("ttl"), F.col("body").cast("string").alias("value"))


def _parsed_topic(topic: DataFrame) -> DataFrame:
    return E.parse_edge_json(topic, "arrival_ms", F.col("meta_origin"), F.col("meta_id"))


def _topic_messages(marked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Admitted topic messages that can be read, and those that are empty."""
    topic = _topic_rows(marked)
    # An empty message has nothing to record, and nothing to be recognised by: it only goes on.
    empty = F.col("value") == ""
    parsed = _parsed_topic(topic.filter(~empty)).filter("accepted")
    bare = topic.filter(empty).withColumns(
        {"mac_hex": F.lit(None).cast("string"), "message_id": F.lit("")}).select(*_TOPIC_COLUMNS)
    return parsed.select(*_TOPIC_COLUMNS), bare


def _recorded(fresh: DataFrame) -> DataFrame:
    return fresh.withColumns(
        {"partition": F.lit(0), "offset": F.col("seq"), "ttl": F.col("ttl").cast("int")})


def gossip_inbound_stream(packets: DataFrame, local_id: str, peers: DataFrame, delivered: str,
                          sent: str, checkpoint: str, seen_ttl_ms: int, available_now: bool = True):
    """Stream form: fresh messages to the ``delivered`` table, and what is passed on to ``sent``."""
    heard = inbound_gossip(packets, local_id)
    fresh = dedupe_sliding_stream(heard, list(G.GOSSIP_KEY), "arrival_ms", "seq", seen_ttl_ms)

    def write(batch: DataFrame, batch_id: int) -> None:
        kept = batch.persist()
        try:
            append_batch(kept, delivered, batch_id)
            append_batch(outbound_gossip(kept, peers), sent, batch_id)
        finally:
            kept.unpersist()

    writer = fresh.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return _trigger(writer, available_now).start()


def edge_stream(frames: DataFrame, produced: str, checkpoint: str,
                ttl_ms: int = S.SEEN_TTL_MS, available_now: bool = True):
    """Device frames (stream_id, frame, message_id, origin, arrival_ms, offset) to topic rows, with
    the message's device, time and place beside them.

    Device state follows from the produced rows, by ``state_stream``: producing never waits for it.
    """
    messages = R.frames_to_messages(frames, F.col("arrival_ms"), F.col("origin_id"), F.col("frame_id"))
    fresh = dedupe_fixed_stream(messages, "message_id", "arrival_ms", "offset", ttl_ms)

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch.withColumns({"key": F.col("mac_hex"), "value": E.to_envelope_json()})
        append_batch(rows.select("key", *DELIVERED.fieldNames()), produced, batch_id)

    writer = fresh.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return _trigger(writer, available_now).start()


def run_to_table(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Run a stream over all that is there into a Parquet table."""
    (stream.writeStream.format("parquet").outputMode("append").option("path", path)
     .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
     .awaitTermination())

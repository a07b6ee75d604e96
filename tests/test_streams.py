"""Streams over several micro-batches give what the batch forms give on the whole."""

import json
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from tidegauge import schema as S
from tidegauge.operators import admission as A
from tidegauge.operators import fleet as R
from tidegauge.operators import frames as FR
from tidegauge.operators import presence as P
from tidegauge.sources.landing import stream_landing
from tidegauge.sources.tables import read_device_messages
from tidegauge.streaming import pipelines as L
from tidegauge.streaming import state as ST
from tidegauge.streaming import stats as STATS
from tidegauge.streaming.stores import read_registry, read_state


def feed(spark, tmp_path, df, order, parts=3):
    """A stream that takes the rows in order, one file per micro-batch."""
    rows = df.orderBy(order).collect()
    size = -(-len(rows) // parts)
    folder = str(tmp_path / "in")
    for i in range(parts):
        one = spark.createDataFrame(rows[i * size:(i + 1) * size], df.schema).coalesce(1)
        one.write.mode("append").parquet(folder)
        for name in os.listdir(folder):
            path = os.path.join(folder, name)
            if os.path.getmtime(path) > time.time() - 3600:
                os.utime(path, (1_000_000 + i * 1000,) * 2)
    return stream_landing(spark, folder, df.schema, max_files=1)


def drain(spark, tmp_path, stream):
    L.run_to_table(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    return spark.read.schema(stream.schema).parquet(str(tmp_path / "out"))


def rows_of(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


def keyed(spark, seed=1, n=900):
    rnd = random.Random(seed)
    # A watermark starts at the epoch and takes no row that is not later than it.
    t, rows = 1_000_000, []
    for s in range(n):
        t += rnd.choice([0, 1, 20, 90])
        rows.append(("hot" if s % 3 == 0 else rnd.choice(["", "a", "b"]), t, s))
    return spark.createDataFrame(rows, "k string, t long, s long")


def test_fixed_expiry(spark, tmp_path):
    df = keyed(spark)
    got = drain(spark, tmp_path, ST.dedupe_fixed_stream(feed(spark, tmp_path / "s", df, "t"), "k", "t", "s", 200))
    assert rows_of(got, "k", "t", "s") == rows_of(P.dedupe_fixed(df, "k", "t", "s", 200), "k", "t", "s")


def test_sliding_expiry_with_timers(spark, tmp_path):
    df = keyed(spark, 2)
    stream = ST.dedupe_sliding_stream(feed(spark, tmp_path / "s", df, "t"), "k", "t", "s", 70, delay="1 second")
    got = drain(spark, tmp_path, stream)
    assert rows_of(got, "k", "t", "s") == rows_of(P.dedupe_sliding(df, "k", "t", "s", 70), "k", "t", "s")


def test_presence_changes(spark, tmp_path):
    df = keyed(spark, 3).filter("k <> ''")
    got = drain(spark, tmp_path, ST.presence_changes(feed(spark, tmp_path / "s", df, "t"), "k", "t", "s", 80))
    sessions = P.presence_sessions(df, "k", "t", 80).collect()
    last = {}
    for r in sessions:
        last[r.k] = max(last.get(r.k, 0), r.start_ms)
    want = [(r.k, r.start_ms, "online") for r in sessions]
    want += [(r.k, r.end_ms, "offline") for r in sessions if r.start_ms < last[r.k]]
    assert rows_of(got, "k", "at_ms", "status") == sorted(want, key=repr)


def test_presence_timers_report_silence(spark, tmp_path):
    df = spark.createDataFrame([("a", 1_000, 0), ("b", 10_000, 1), ("b", 20_000, 2)], "k string, t long, s long")
    stream = ST.presence_changes(feed(spark, tmp_path / "s", df, "t"), "k", "t", "s", 5_000, delay="0 seconds")
    assert ("a", 6_000, "offline") in rows_of(drain(spark, tmp_path, stream), "k", "at_ms", "status")


def test_rate_and_stream_limits(spark, tmp_path):
    from test_admission import SCHEMA, traffic

    df = spark.createDataFrame(traffic(7, 600), SCHEMA)
    data = df.filter("kind = 'Data'")
    got = drain(spark, tmp_path / "a", ST.rate_limit_stream(feed(spark, tmp_path / "a", data, "seq"), 150))
    assert rows_of(got, "seq", "accepted") == rows_of(A.rate_limit_ingress(df, 150), "seq", "accepted")
    got = drain(spark, tmp_path / "b", ST.admit_streams_stream(feed(spark, tmp_path / "b", df, "seq"), 2))
    want = A.admit_streams(df, 2).filter("kind = 'Connected'")
    assert rows_of(got.filter("kind = 'Connected'"), "seq", "accepted") == rows_of(want, "seq", "accepted")


def test_route_health(spark, tmp_path):
    rnd = random.Random(9)
    kinds = ["advert", "attempt", "failure", "failure", "failure", "success", "disconnect"]
    df = spark.createDataFrame(
        [("o", rnd.randint(0, 3), rnd.choice(kinds), rnd.random() < 0.3, 1000 + i, i) for i in range(600)],
        "owner string, node long, kind string, connected boolean, ts_ms long, seq long")
    out = drain(spark, tmp_path, ST.route_health_stream(feed(spark, tmp_path, df, "seq")))
    last = out.groupBy("owner", "node").agg({"upto_seq": "max"}).withColumnRenamed("max(upto_seq)", "upto_seq")
    columns = ["owner", "node", *ST.RouteHealth.FIELDS]
    assert rows_of(out.join(last, ["owner", "node", "upto_seq"]), *columns) == rows_of(
        R.route_health(df), *columns)


def test_frames_across_micro_batches(spark, tmp_path):
    from test_frames import cut, frame

    rnd = random.Random(8)
    rows = []
    for stream in (1, 2, 3):
        data = b"".join(frame(rnd.randbytes(rnd.choice([0, 9, 60]))) for _ in range(40))
        rows += [(stream, i, c) for i, c in enumerate(cut(rnd, data))]
    df = spark.createDataFrame(rows, "stream_id long, seq long, bytes binary")
    got = drain(spark, tmp_path, ST.reassemble_frames_stream(feed(spark, tmp_path, df, "seq")))
    columns = ["stream_id", "frame_no", "frame"]
    assert rows_of(got, *columns) == rows_of(FR.reassemble_frames(df), *columns)


def envelope_rows(spark, first, n):
    rows = []
    for i in range(first, first + n):
        mac = f"{i % 7:012x}"
        value = "broken" if i % 5 == 4 else json.dumps(
            {"mac_hex": mac, "timestamp_ms": 1000 + i, "payload_base64": "dGlkZQ=="})
        rows.append((0, i, mac, value, 2000 + i))
    return spark.createDataFrame(rows, S.LANDING).coalesce(1)


def test_ingest_goes_on_where_it_stopped(spark, tmp_path):
    landing, table, bad = (str(tmp_path / n) for n in ("landing", "table", "bad"))

    def run():
        L.ingest_stream(stream_landing(spark, landing), table, bad,
                        str(tmp_path / "checkpoint")).awaitTermination()
        return read_device_messages(spark, table).count(), spark.read.parquet(f"{bad}/batch_id=*").count()

    envelope_rows(spark, 0, 20).write.mode("append").parquet(landing)
    assert run() == (16, 4)
    assert run() == (16, 4)
    envelope_rows(spark, 20, 10).write.mode("append").parquet(landing)
    assert run() == (24, 6)


def test_repeated_batch_is_kept_once(spark, tmp_path):
    """A crash between the write and the commit repeats the batch."""
    landing, table, check = (str(tmp_path / n) for n in ("landing", "table", "checkpoint"))
    envelope_rows(spark, 0, 20).write.parquet(landing)
    args = (table, str(tmp_path / "bad"), check)
    L.ingest_stream(stream_landing(spark, landing), *args).awaitTermination()
    for name in os.listdir(f"{check}/commits"):
        os.remove(f"{check}/commits/{name}")
    L.ingest_stream(stream_landing(spark, landing), *args).awaitTermination()
    assert read_device_messages(spark, table).count() == 16


def test_failing_policy_stops_the_stream(spark, tmp_path):
    landing = str(tmp_path / "landing")
    envelope_rows(spark, 0, 20).write.parquet(landing)
    query = L.ingest_stream(stream_landing(spark, landing), str(tmp_path / "t"), str(tmp_path / "b"),
                            str(tmp_path / "c"), on_error="fail")
    with pytest.raises(Exception, match="bad message"):
        query.awaitTermination()


def test_registry_follows_arrival_and_keeps_ids(spark, tmp_path):
    landing, checkpoint = str(tmp_path / "landing"), str(tmp_path / "checkpoint")

    def run():
        L.registry_stream(stream_landing(spark, landing), checkpoint).awaitTermination()
        return {r.mac_addr: (int(r.id) - 9 * 10**24, r.timestamp)
                for r in read_registry(spark, checkpoint).collect()}

    def arrive(offset, mac, ts):
        value = json.dumps({"mac_hex": mac, "timestamp_ms": ts})
        spark.createDataFrame([(0, offset, mac, value, 9)], S.LANDING).write.mode("append").parquet(landing)

    assert read_registry(spark, checkpoint) is None
    arrive(5, "02c4f1907be5", 100)
    assert run() == {"02:c4:f1:90:7b:e5": (5, 100)}
    arrive(6, "02c4f1907be5", 50)
    arrive(7, "02c4f1907b00", 70)
    assert run() == {"02:c4:f1:90:7b:e5": (5, 50), "02:c4:f1:90:7b:00": (7, 70)}
    assert run() == {"02:c4:f1:90:7b:e5": (5, 50), "02:c4:f1:90:7b:00": (7, 70)}  # nothing new
    assert [r.timestamp for r in read_registry(spark, checkpoint, 0).collect()] == [100]


def test_device_state_is_renewed_and_leaves_the_store(spark, tmp_path):
    landing, checkpoint, gone = (str(tmp_path / n) for n in ("landing", "checkpoint", "gone"))

    def run(*rows):
        spark.createDataFrame([(m, v, t, 0, t) for m, v, t in rows], L.DELIVERED).coalesce(1).write.mode(
            "append").parquet(landing)
        L.state_stream(stream_landing(spark, landing, L.DELIVERED, max_files=1), checkpoint, "0 seconds",
                       gone, state_ttl_ms=100, latest_ttl_ms=0).awaitTermination()
        state = {r.key.removeprefix("device:"): (r.value, r.expires_at_ms)
                 for r in read_state(spark, checkpoint).collect()}
        return state, spark.read.format("statestore").load(checkpoint).count()

    assert read_state(spark, checkpoint) is None
    state, held = run(("a", "v1", 10_000), ("a", "v2", 10_050), ("b", "w1", 10_050))
    assert state == {"a:state": ("online", 10_150), "a:latest": ("v2", None),
                     "b:state": ("online", 10_150), "b:latest": ("w1", None)} and held == 4
    state, held = run(("a", "v3", 10_149))  # a day of its own: b goes on until the watermark passes
    assert state["a:state"] == ("online", 10_249) and state["a:latest"] == ("v3", None) and held == 4
    state, held = run(("c", "u", 10_200))
    assert set(state) == {"a:state", "a:latest", "b:latest", "c:state", "c:latest"} and held == 5
    ended = {r.key: r.written_ms for r in spark.read.parquet(gone).collect()}
    assert ended == {"device:b:state": 10_050}
    state, held = run(("b", "w2", 20_000))  # comes back after it had expired
    assert state["b:state"] == ("online", 20_100) and state["b:latest"] == ("w2", None)
    assert set(state) == {"a:latest", "b:state", "b:latest", "c:latest"} and held == 4


def test_producing_goes_on_when_state_cannot_be_kept(spark, tmp_path):
    """State is a query of its own: it may fail for good while the other goes on."""
    produced = str(tmp_path / "produced")
    rows = [(1, bytes.fromhex("02c4f1907be5") + (10_000 + i).to_bytes(8, "big") + b"\0\0\0\1x", f"f{i}", "o",
             10_000 + i, i, 0) for i in range(4)]
    schema = ("stream_id long, frame binary, frame_id string, origin_id string, arrival_ms long, "
              "offset long, partition int")
    landing = str(tmp_path / "frames")
    for part in (rows[:2], rows[2:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(landing)
        L.edge_stream(stream_landing(spark, landing, schema), produced,
                      str(tmp_path / "edge")).awaitTermination()
        held = stream_landing(spark, f"{produced}/batch_id=*", L.DELIVERED)
        broken = L.state_stream(held.withColumn("value", F.raise_error(F.lit("no store"))),
                                str(tmp_path / "state"), "0 seconds")
        with pytest.raises(Exception, match="no store"):
            broken.awaitTermination()
    assert spark.read.parquet(f"{produced}/batch_id=*").count() == 4
    held = stream_landing(spark, f"{produced}/batch_id=*", L.DELIVERED)
    L.state_stream(held, str(tmp_path / "state-2"), "0 seconds").awaitTermination()
    assert {r.key for r in read_state(spark, str(tmp_path / "state-2")).collect()} == {
        "device:02c4f1907be5:state", "device:02c4f1907be5:latest"}


def test_seen_ids_as_a_join_of_streams(spark, tmp_path):
    rnd = random.Random(12)
    seen = [(rnd.choice(["a", "b", "c", "", None]), 100_000 + 7 * i) for i in range(60)]
    late = max(t for _, t in seen)
    msgs = [(rnd.choice(["a", "b", "c", "d", "", None]), late + 3 * i, i) for i in range(200)]
    sdf = spark.createDataFrame(seen, "message_id string, seen_ms long")
    mdf = spark.createDataFrame(msgs, "message_id string, arrival_ms long, s long")
    # Both streams go on long after the rows that count, so that all of them are decided.
    s_end = spark.createDataFrame([("z", 10**9)], "message_id string, seen_ms long")
    m_end = spark.createDataFrame([("z", 10**9, -1)], "message_id string, arrival_ms long, s long")
    stream = ST.drop_seen_stream(feed(spark, tmp_path / "m", mdf.union(m_end), "arrival_ms"),
                                 feed(spark, tmp_path / "n", sdf.union(s_end), "seen_ms"), "10 seconds", 300)
    got = drain(spark, tmp_path, stream).filter("s >= 0")
    columns = ("message_id", "arrival_ms", "s")
    assert rows_of(got, *columns) == rows_of(P.drop_seen(mdf, sdf, 300), *columns)
    with pytest.raises(ValueError):
        ST.drop_seen_stream(mdf, sdf, "1 hour", 0)


def test_batch_stats_are_those_of_the_batches(spark, tmp_path):
    df = envelope_rows(spark, 0, 90)
    got = STATS.batch_stats(spark, feed(spark, tmp_path, df, "offset"), str(tmp_path / "checkpoint")).collect()
    sizes = [len(r.key) + len(r.value) for r in df.orderBy("offset").collect()]
    assert [tuple(r) for r in got] == [(i, 30, sum(sizes[30 * i:30 * i + 30])) for i in range(3)]
    assert STATS.batch_stats(spark, stream_landing(spark, str(tmp_path / "in")),
                             str(tmp_path / "checkpoint")).count() == 0


def test_idle_sessions(spark, tmp_path):
    df = spark.createDataFrame([("a", 0), ("a", 900), ("a", 1900), ("b", 50_000), ("b", 90_000)], "k string, t long")
    stream = ST.idle_sessions_stream(feed(spark, tmp_path, df, "t"), ["k"], "t", 1000,
                                     "0 seconds")
    got = rows_of(drain(spark, tmp_path, stream), "k", "start_ms", "end_ms", "events")
    assert got == [("a", 0, 1900, 2), ("a", 1900, 2900, 1), ("b", 50_000, 51_000, 1)]


def test_idle_sessions_without_timeout_or_of_one_millisecond(spark, tmp_path):
    rows = [("a", 5), ("a", 6), ("b", 900_000), ("a", 70_000)]
    df = spark.createDataFrame(rows, "k string, t long")
    never = ST.idle_sessions_stream(feed(spark, tmp_path / "n", df, "t"), ["k"], "t", 0, "0 seconds")
    query = never.writeStream.format("memory").queryName("never").outputMode("complete").trigger(
        availableNow=True).option("checkpointLocation", str(tmp_path / "never")).start()
    query.awaitTermination()
    got = {tuple(r) for r in spark.table("never").collect()}
    assert got == {("a", 5, 70_000, 3, None), ("b", 900_000, 900_000, 1, None)}
    short = ST.idle_sessions_stream(feed(spark, tmp_path / "s", df, "t"), ["k"], "t", 1, "1 hour")
    query = short.writeStream.format("memory").queryName("short").outputMode("complete").trigger(
        availableNow=True).option("checkpointLocation", str(tmp_path / "short")).start()
    query.awaitTermination()
    assert {(r.k, r.start_ms, r.events, r.end_ms) for r in spark.table("short").collect()} == {
        ("a", 5, 1, 6), ("a", 6, 1, 7), ("a", 70_000, 1, 70_001), ("b", 900_000, 1, 900_001)}

import random
import struct

import pytest

from tidegauge.operators import frames as R
from tidegauge.operators import long_streams as LS


def frame(payload, length=None):
    return b"\x01\x02\x03\x04\x05\x06" + struct.pack(
        ">QI", 1723456789012, len(payload) if length is None else length) + payload


def cut(rnd, data):
    out = []
    while data:
        n = rnd.randint(1, 40)
        out.append(data[:n])
        data = data[n:]
    return out


def run(spark, streams, max_payload=100, cut=R.reassemble_frames):
    rows = [(s, i, c) for s, chunks in streams.items() for i, c in enumerate(chunks)]
    random.Random(0).shuffle(rows)
    df = spark.createDataFrame(rows, "stream_id long, seq long, bytes binary")
    got = cut(df, max_payload=max_payload).collect()
    out = {}
    for r in sorted(got, key=lambda r: (r.stream_id, r.frame_no)):
        out.setdefault(r.stream_id, []).append(bytes(r.frame))
    return out


def test_streams_are_cut_into_frames(spark):
    rnd = random.Random(4)
    frames = {s: [frame(rnd.randbytes(rnd.choice([0, 1, 30, 100]))) for _ in range(30)] for s in range(1, 6)}
    streams = {s: cut(rnd, b"".join(f) + b"\x00" * 9) for s, f in frames.items()}
    # The buffer holds one frame of the largest size and must take a chunk on top of a partial one.
    assert run(spark, streams, max_payload=200) == frames


def test_too_large_a_payload_ends_the_stream(spark):
    good, bad = frame(b"x" * 10), frame(b"", 101)
    # Frames cut from the chunk that ends the stream are dropped with it.
    assert run(spark, {1: [good, good + bad, good]}) == {1: [good]}


def test_too_large_a_chunk_ends_the_stream(spark):
    good = frame(b"x" * 10)
    assert run(spark, {1: [good, good * 5, good], 2: [good, good[:20], good[20:] + good * 3 + b"x" * 10]}) == {
        1: [good], 2: [good]}


@pytest.mark.parametrize("range_bytes", [1, 19, 64, 500, 10**6])
def test_long_streams_are_cut_as_by_one_reader(spark, range_bytes):
    """Frames, garbage, headers that declare too much and chunks that overflow, in small ranges."""
    rnd = random.Random(range_bytes)
    streams = {}
    for s in range(24):
        parts = [frame(rnd.choice([b"", bytes(rnd.choice([1, 18, 40])), rnd.randbytes(rnd.choice([5, 90, 200]))]))
                 for _ in range(rnd.choice([1, 10, 25]))]
        if s % 4 == 1:
            parts.insert(rnd.randrange(len(parts) + 1), frame(b"", rnd.choice([201, 2**31])))
        if s % 4 == 2:
            parts.append(rnd.randbytes(rnd.choice([3, 17, 18, 60])))
        chunks = cut(rnd, b"".join(parts))
        if s % 6 == 5:
            at = rnd.randrange(len(chunks))
            chunks[at:at + 9] = [b"".join(chunks[at:at + 9])]  # perhaps too much at once
        if s % 5 == 0:
            chunks.insert(rnd.randrange(len(chunks)), b"")
        streams[s + 1] = chunks
    streams[99] = [b"", b""]

    def long(df, max_payload):
        return LS.reassemble(df, max_payload, long_bytes=1, range_bytes=range_bytes)

    want = run(spark, streams, max_payload=200)
    assert run(spark, streams, 200, long) == want and sum(map(len, want.values())) > 50


def test_chains_through_a_range():
    data = frame(b"abc") + frame(b"") + frame(b"x" * 30)
    entry, leaves = LS.exits(data[:50], data[50:], 100)
    assert dict(zip(entry.tolist(), leaves.tolist()))[0] == len(data)
    assert LS.next_starts(data[:20], data[20:], 2)[0] == -1


def test_edge_frames(spark):
    rows = [(1, frame(b"ebb")), (2, frame(b"ebb", 4)), (3, b"\x01" * 17), (4, frame(b"")),
            (5, struct.pack(">6sQI", b"\xff" * 6, 2**64 - 1, 0))]
    got = {r.id: r for r in R.decode_edge_frames(
        spark.createDataFrame(rows, "id long, frame binary")).collect()}
    assert [got[i].valid for i in range(1, 6)] == [True, False, False, True, True]
    assert got[1].mac_hex == "010203040506" and bytes(got[1].payload) == b"ebb"
    assert int(got[5].timestamp_ms) == 2**64 - 1


def test_gossip_and_tunnel_edges(spark):
    head = bytes.fromhex("49504742") + b"\x01\x03\x00\x00" + b"\x01" * 32 + b"\x02" * 32
    rows = [(1, b"IPG"), (2, b"IPGB"), (3, head + struct.pack(">I", 2) + b"ok"),
            (4, head + struct.pack(">I", 3) + b"ok"), (5, b""),
            (6, head[:6] + b"\x01" + head[7:] + struct.pack(">I", 0))]
    got = {r.id: r for r in R.decode_gossip(
        spark.createDataFrame(rows, "id long, payload binary")).collect()}
    assert [got[i].status for i in range(1, 7)] == [
        "plain", "invalid", "envelope", "invalid", "plain", "invalid"]
    assert got[3].ttl == 3 and bytes(got[3].body) == b"ok"
    packet = bytes.fromhex("49505450") + b"\x01\x04\x00\x00" + struct.pack(">QI", 0, 0)
    rows = [(1, packet), (2, packet[:5] + b"\x02" + packet[6:]), (3, packet[:5] + b"\x08" + packet[6:])]
    got = R.decode_tunnel_frames(spark.createDataFrame(rows, "id long, packet binary"))
    assert [(r.valid, r.type) for r in got.orderBy("id").collect()] == [
        (True, "control"), (False, None), (False, None)]


def test_short_ranges_are_streamed_and_not_groups_of_their_own(spark):
    rnd = random.Random(8)
    rows, want = [], {}
    for stream in (1, 2):
        low = 0
        for seq in range(300):
            data = rnd.randbytes(rnd.randint(1, 40))
            rows.append((stream, seq, low, low + len(data), data))
            want.setdefault((stream, low // 64), []).append(rows[-1])
            low += len(data)
    rnd.shuffle(rows)
    chunks = spark.createDataFrame(rows, "stream long, seq long, low long, high long, bytes binary")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # ranges go on over batches
    try:
        ranges = LS._ranges(chunks, 64)
        got = {(r.stream, r.low, r.high, bytes(r.data)) for r in ranges.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {(k[0], p[0][2], p[-1][3], b"".join(r[4] for r in p)) for k, p in want.items()}
    assert "FlatMapGroupsInPandas" not in ranges._jdf.queryExecution().toString()

import random

import pytest
from pyspark.sql import functions as F

from tidegauge.operators import admission as A

SCHEMA = "node long, stream_id long, kind string, bytes int, t_ms long, seq long"


def traffic(seed, n=1200, streams=9):
    """Two thirds of the rows belong to node 0; bursts, rests and rows over the capacity."""
    rnd = random.Random(seed)
    rows, t = [], 0
    for seq in range(n):
        t += rnd.choice([0, 0, 1, 30, 200, 200, 900 if seq % 50 == 0 else 5])
        node = 0 if seq % 3 else rnd.randint(1, 3)
        kind = rnd.choice(["Connected", "Closed", "Data", "Data"])
        rows.append((node, rnd.randint(0, streams), kind, rnd.choice([0, 1, 50, 99, 100, 101]), t, seq))
    return rows


def bucket(rows, capacity):
    state, out = {}, {}
    for node, _, kind, size, t, seq in rows:
        if kind != "Data":
            continue
        if size == 0 or capacity == 0:
            out[seq] = True
            continue
        tokens, at = state.get(node, (float(capacity), t))
        tokens = min(float(capacity), tokens + float(capacity) * (t - at) / 1000.0)
        out[seq] = tokens >= size
        state[node] = (tokens - size if out[seq] else tokens, t)
    return out


@pytest.mark.parametrize("capacity", [100, 1000, 20000, 0])
@pytest.mark.parametrize("segment_ms", [50, 5_000, 10**9])
def test_rate_limit_equals_a_plain_walk(spark, capacity, segment_ms):
    rows = traffic(capacity)
    df = spark.createDataFrame(rows, SCHEMA)
    got = A.rate_limit_ingress(df, capacity, segment_ms=segment_ms).collect()
    assert {r.seq: r.accepted for r in got} == bucket(rows, capacity)


def limited_streams(rows, most):
    open_streams, out = {}, {}
    for node, stream, kind, _, _, seq in rows:
        mine = open_streams.setdefault(node, set())
        if kind == "Connected":
            ok = stream != 0 and (stream in mine or most == 0 or len(mine) < most)
            if ok:
                mine.add(stream)
            out[seq] = ok
        elif kind == "Closed" and stream != 0:
            mine.discard(stream)
            out[seq] = True
    return out


@pytest.mark.parametrize("most", [1, 3, 6, 0])
@pytest.mark.parametrize("segment", [100, 10**9])
def test_stream_limit_equals_a_plain_walk(spark, most, segment):
    rows = traffic(most)
    df = spark.createDataFrame(rows, SCHEMA)
    got = A.admit_streams(df, most, F.expr(f"t_ms DIV {segment}")).collect()
    assert {r.seq: r.accepted for r in got} == limited_streams(rows, most)


def test_repeated_connects_count_once(spark):
    rows = [(0, 1, "Connected", 0, i, i) for i in range(3)] + [(0, 1, "Closed", 0, 9, 9)] * 1
    got = A.peak_streams(spark.createDataFrame(rows, SCHEMA)).first()
    assert (got.peak, got.opened) == (1, 1)


def test_rows_in_one_moment_are_judged_without_their_bodies(spark, monkeypatch):
    """Windows and the replay see numbers only, in short segments."""
    rows = traffic(7)
    want = bucket(rows, 1000)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("body", F.repeat(F.lit("x"), 200))
    kept, cut = [], []
    monkeypatch.setattr(A, "SEGMENT_ROWS", 50)
    monkeypatch.setattr(A, "checkpointed", lambda d: kept.append(d.columns) or d.localCheckpoint())
    floor = F.floor
    monkeypatch.setattr(A.F, "floor", lambda c: cut.append(str(c)) or floor(c))
    got = A.rate_limit_ingress(df, 1000, segment_ms=10**9).collect()
    assert {r.seq: r.accepted for r in got} == want and {len(r.body) for r in got} == {200}
    assert "body" in kept[0] and not any("body" in columns for columns in kept[1:])
    assert cut and "1000000000" not in cut[0]

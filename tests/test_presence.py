import random

import pytest

from tidegauge.operators import presence as P


def events(spark, times, key="a"):
    return spark.createDataFrame([(key, t, i) for i, t in enumerate(times)], "k string, t long, s long")


@pytest.mark.parametrize("gap, sessions", [(59_999, 1), (60_000, 2), (60_001, 2)])
def test_a_silence_of_the_time_to_live_ends_a_session(spark, gap, sessions):
    found = P.presence_sessions(events(spark, [0, gap]), "k", "t", 60_000).collect()
    assert len(found) == sessions
    assert max(r.end_ms for r in found) == gap + 60_000


def fixed(rows, ttl):
    out, held = [], {}
    for k, t, s in sorted(rows, key=lambda r: (r[1], r[2])):
        if not k or k not in held or (ttl > 0 and t >= held[k] + ttl):
            out.append((k, t, s))
            held[k] = t
    return sorted(out, key=repr)


def sliding(rows, ttl):
    out, seen = [], {}
    for k, t, s in sorted(rows, key=lambda r: (r[1], r[2])):
        if k not in seen or (ttl > 0 and t - seen[k] >= ttl):
            out.append((k, t, s))
        seen[k] = t
    return sorted(out)


def random_rows(seed, n=1500):
    """A third of the rows share one key that never rests; some rows have no key."""
    rnd = random.Random(seed)
    rows, t = [], 0
    for s in range(n):
        t += rnd.choice([0, 1, 7, 40, 100])
        key = "hot" if s % 3 == 0 else rnd.choice(["", None, "a", "b", f"k{s % 40}"])
        rows.append((key, t, s))
    return rows


@pytest.mark.parametrize("ttl", [100, 101, 1000, 0])
@pytest.mark.parametrize("fold_rows", [1000, 2])
def test_fixed_expiry_equals_a_plain_walk(spark, monkeypatch, ttl, fold_rows):
    # With fold_rows = 2 nearly all sessions take the way over spans.
    monkeypatch.setattr(P, "FOLD_ROWS", fold_rows)
    monkeypatch.setattr(P, "SPAN_TTLS", 4)
    rows = random_rows(ttl)
    df = spark.createDataFrame(rows, "k string, t long, s long")
    got = sorted(map(tuple, P.dedupe_fixed(df, "k", "t", "s", ttl).collect()), key=repr)
    assert got == fixed(rows, ttl)


@pytest.mark.parametrize("ttl", [100, 0])
def test_sliding_expiry_equals_a_plain_walk(spark, ttl):
    rows = [r for r in random_rows(5) if r[0] is not None]
    df = spark.createDataFrame(rows, "k string, t long, s long")
    got = sorted(map(tuple, P.dedupe_sliding(df, "k", "t", "s", ttl).collect()))
    assert got == sliding(rows, ttl)


def test_seen_ids_expire(spark):
    msgs = spark.createDataFrame([("a", 599), ("a", 600), ("", 1), (None, 2), ("b", 1)],
                                 "message_id string, arrival_ms long")
    seen = spark.createDataFrame([("a", 0), ("a", -50), ("", 0), (None, 0)], "message_id string, seen_ms long")
    got = sorted(map(tuple, P.drop_seen(msgs, seen, 600).collect()), key=repr)
    assert got == [("", 1), ("a", 600), ("b", 1), (None, 2)]
    assert P.drop_seen(msgs, seen, 0).count() == 3


def test_state_without_time_to_live_never_expires(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(0, 1, "d", "v1", 10), (0, 2, "d", "v2", 5)],
                                 "partition int, offset long, k string, v string, t long")
    state = P.device_state(rows, "k", "v", "t", state_ttl_ms=60, latest_ttl_ms=0)
    got = {r.key: (r.value, r.expires_at_ms) for r in state.collect()}
    assert got == {"device:d:state": ("online", 70), "device:d:latest": ("v2", None)}
    assert [r.key for r in P.alive(state, F.lit(70)).collect()] == ["device:d:latest"]


@pytest.mark.parametrize("rule, plain", [(P.dedupe_fixed, fixed), (P.dedupe_sliding, sliding)])
def test_the_shortest_time_to_live_keeps_all_but_equal_times(spark, rule, plain):
    rows = [("a", t, s) for s, t in enumerate([0, 0, 1, 2, 2, 5])]
    got = rule(spark.createDataFrame(rows, "k string, t long, s long"), "k", "t", "s", 1)
    assert sorted(map(tuple, got.collect())) == sorted(plain(rows, 1))
    assert P.presence_sessions(events(spark, [0, 0, 1, 2, 2, 5]), "k", "t", 1).count() == 4

"""Rules, alerts and series against plain walks; streams against batch forms."""

import json
import random

import pytest
from pyspark.sql import functions as F

from test_streams import drain, feed, rows_of
from tidegauge.operators import rules as R
from tidegauge.operators import series as Y
from tidegauge.streaming import rules as SR

RULES = [(1, "$.a", ">", 5.0, 0), (2, "$.a", ">=", 3.0, 40), (3, "$.b.c", "<>", 1.0, 100), (4, "$.a", "=", 0.0, 7),
         (5, "$.b.c", "<=", 2.0, 1000), (6, "$.no", "<", 1.0, 0)]
RULE_SCHEMA = "rule_id int, path string, op string, threshold double, hold_ms bigint"


def traffic(seed, n=500):
    """A third of the rows are one device's; some payloads are broken or lack a number."""
    rnd, t, rows = random.Random(seed), 1_000_000, []
    for i in range(n):
        t += rnd.choice([0, 0, 1, 9, 40, 300])
        payload = rnd.choice(["{", "[]", '{"a":"7"}', None]) if rnd.random() < 0.1 else json.dumps(
            {"a": rnd.choice([0, 2, 3.0, 5, 6.5]), "b": {"c": rnd.randrange(4)}})
        rows.append(("hot" if i % 3 == 0 else rnd.choice("xyz"), t, i, payload))
    return rows


def value_at(payload, path):
    try:
        out = json.loads(payload)
        for name in path[2:].split("."):
            out = out[name]
    except (ValueError, TypeError, KeyError):
        return None
    return out if isinstance(out, (int, float)) else None


OPS = {">": float.__gt__, ">=": float.__ge__, "<": float.__lt__, "<=": float.__le__, "=": float.__eq__,
       "<>": float.__ne__}


def plain_hits(rows, as_of):
    out = []
    for rule, path, op, limit, hold in RULES:
        since, last = {}, {}
        for device, t, _, payload in rows:
            v = value_at(payload, path)
            if v is None:
                continue
            last[device] = t
            if OPS[op](float(v), limit):
                since.setdefault(device, t)
            elif device in since:
                out += [(device, rule, since[device], since[device] + hold)] * (since.pop(device) + hold <= t)
        out += [(d, rule, s, s + hold) for d, s in since.items() if s + hold <= max(as_of, last[d])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("segment_ms", [500, R.SEGMENT_MS])
def test_hits_are_those_of_a_walk(spark, segment_ms):
    rows = traffic(segment_ms)
    df = spark.createDataFrame(rows, "k string, t long, s long, payload string")
    rules = spark.createDataFrame(RULES, RULE_SCHEMA)
    as_of = rows[-1][1] - 30
    got = R.rule_hits(df, rules, F.lit(as_of), "k", "t", "s", segment_ms=segment_ms)
    assert rows_of(got, "k", "rule_id", "since_ms", "hit_ms") == plain_hits(rows, as_of)
    assert R.rule_hits(df, rules.limit(0), F.lit(as_of), "k", "t", "s").count() == 0
    assert R.rule_hits(df.limit(0), rules, F.lit(as_of), "k", "t", "s").count() == 0


def test_too_many_paths_are_refused(spark, monkeypatch):
    monkeypatch.setattr(R, "MAX_PATHS", 2)
    df = spark.createDataFrame(traffic(1, 3), "k string, t long, s long, payload string")
    with pytest.raises(ValueError, match="paths"):
        R.rule_hits(df, spark.createDataFrame(RULES, RULE_SCHEMA), F.lit(0), "k", "t", "s")


def test_hits_of_a_stream(spark, tmp_path):
    rows = traffic(4, 300)
    df = spark.createDataFrame(rows, "k string, t long, s long, payload string")
    rules = spark.createDataFrame(RULES, RULE_SCHEMA)
    stream = SR.rule_hits_stream(feed(spark, tmp_path, df, "s"), rules, "50 milliseconds", "k", "t", "s")
    got = rows_of(drain(spark, tmp_path, stream), "k", "rule_id", "since_ms", "hit_ms")
    assert got == plain_hits(rows, rows[-1][1] - 50)


def levels(seed, n=500):
    rnd, t, rows = random.Random(seed), 1_000_000, []
    for i in range(n):
        t += rnd.choice([0, 1, 30, 200])
        rows.append(("hot" if i % 3 == 0 else rnd.choice("xy"), t, i, rnd.choice([1.0, 4.0, 5.0, 6.0, 9.0, None])))
    return rows


def plain_alerts(rows, as_of, every):
    out, since, last = [], {}, {}

    def repeats(device, upto):
        times = max(0, (upto - since[device]) // every)
        return [(device, since[device] + n * every, "repeat", n) for n in range(1, times + 1)]

    for device, t, _, v in rows:
        if v is None:
            continue
        last[device] = t
        if device not in since and v >= 8:
            since[device] = t
            out.append((device, t, "raise", 0))
        elif device in since and v <= 1:
            again = repeats(device, t - 1)
            out += [*again, (device, t, "clear", len(again))]
            del since[device]
    for device in since:
        out += repeats(device, max(as_of, last[device]))
    return sorted(out, key=repr)


@pytest.mark.parametrize("every", [50, 10_000])
def test_alerts_are_those_of_a_walk(spark, tmp_path, every):
    rows = levels(every)
    df = spark.createDataFrame(rows, "k string, t long, s long, v double")
    as_of, columns = rows[-1][1] - 40, ("k", "at_ms", "kind", "n")
    got = R.alerts(df, F.lit(as_of), "k", "t", "s", "v", 8, 1, every, segment_ms=700)
    assert rows_of(got, *columns) == plain_alerts(rows, as_of, every)
    stream = SR.alerts_stream(feed(spark, tmp_path, df, "s"), "40 milliseconds", "k", "t", "s", "v", 8, 1, every)
    assert rows_of(drain(spark, tmp_path, stream), *columns) == plain_alerts(rows, as_of, every)


def test_an_alert_clears_below_what_raises_it():
    with pytest.raises(ValueError):
        R.decisive(F.lit(1), 5, 5)


@pytest.mark.parametrize("forward", [False, True])
@pytest.mark.parametrize("tolerance", [None, 30])
def test_as_of_join_takes_the_nearest_row(spark, forward, tolerance):
    rnd = random.Random(3)
    left = [(rnd.choice("ab"), rnd.randrange(-500, 500), i) for i in range(80)]
    right = [(rnd.choice("abc"), rnd.randrange(-500, 500), i, f"v{i}") for i in range(60)]
    got = Y.as_of_join(spark.createDataFrame(left, "k string, t long, s long"),
                       spark.createDataFrame(right, "k string, t long, s long, v string"), ["k"], "t", "s",
                       ["v"], forward, tolerance, "near_", segment_ms=100)
    want = []
    for k, t, s in left:
        fit = [(abs(t - u), n if forward else -n, u, v) for j, u, n, v in right
               if j == k and (u >= t if forward else u <= t)]
        best = min(fit, default=None)
        near = best and (tolerance is None or best[0] <= tolerance)
        want.append((k, t, s, *(best[2:] if near else (None, None))))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_cleaned_series(spark):
    rows = [("a", 5, 0, 10.0), ("a", 20, 1, 40.0), ("a", 20, 2, 50.0), ("a", 25, 3, 1e9), ("a", 44, 4, 98.0),
            ("a", 200, 5, 98.0), ("a", 210, 6, None), ("b", 30, 7, 7.0), ("c", 31, 8, 7.0)]
    got = Y.clean_series(spark.createDataFrame(rows, "k string, t long, s long, v double"), "k", "t", "s", "v",
                         10, 30, 0, 1000, segment_ms=15)
    out = sorted((r.k, r.t, r.v, r.kind) for r in got.collect() if r.t <= 60 or r.t == 200)
    assert out == [("a", 10, pytest.approx(70 / 3), "interpolated"), ("a", 20, 50.0, "measured"),
                   ("a", 30, 70.0, "interpolated"), ("a", 40, 90.0, "interpolated"), ("a", 50, None, "gap"),
                   ("a", 60, None, "gap"), ("a", 200, 98.0, "measured"), ("b", 30, 7.0, "measured")]
    assert got.count() == 21

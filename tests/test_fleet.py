import json
from decimal import Decimal
import random

import pytest
from pyspark.sql import functions as F

from tidegauge import schema as S
from tidegauge.operators import fleet as R
from tidegauge.sources import routes as SR
from tidegauge.streaming.state import RouteHealth

NOW = 1_704_067_200_000


def hexid(k):
    return f"{k:064x}"


def test_health_equals_a_plain_walk(spark):
    rnd = random.Random(3)
    kinds = ["advert"] * 2 + ["attempt"] * 3 + ["failure"] * 6 + ["success", "disconnect"]
    rows = [("o", 0 if i % 3 == 0 else rnd.randint(1, 5), rnd.choice(kinds), rnd.random() < 0.2,
             1000 + i, i) for i in range(2500)]
    want = {}
    for _, node, kind, linked, ts, _ in rows:
        state = RouteHealth.step(want.get(node), kind, linked, ts)
        if state is not None:
            want[node] = state
    df = spark.createDataFrame(
        rows, "owner string, node long, kind string, connected boolean, ts_ms long, seq long")
    got = {r.node: r for r in R.route_health(df).collect()}
    assert set(got) == set(want)
    for node, state in want.items():
        assert {f: got[node][f] for f in state} == state


def test_all_states_occur_in_the_walk():
    route = None
    for i in range(10):
        route = RouteHealth.step(route, "advert" if i == 0 else "failure", False, i + 1)
    assert route["state"] == "new"
    assert RouteHealth.step(route, "failure", False, 20)["state"] == "bad"
    assert RouteHealth.step(route, "advert", False, 21)["state"] == "new"
    assert RouteHealth.step(route, "success", False, 22)["state"] == "tried"


def route(k, **change):
    base = dict(owner="o", node=("h", 9000, hexid(k)), source=None, capability=None, state="new",
                attempts=0, failures=0, hop_count=0, last_seen_ms=NOW, last_try_ms=0,
                last_success_ms=0, kcp_connected=False)
    return tuple({**base, **change}.values())


SCHEMA = (f"owner string, node struct<host:string,port:bigint,id:string>, "
          f"source struct<host:string,port:bigint,id:string>, "
          f"capability {S.CAPABILITY.simpleString()}, state string, attempts int, failures int, "
          "hop_count int, last_seen_ms long, last_try_ms long, last_success_ms long, "
          "kcp_connected boolean")


def table(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


@pytest.mark.parametrize("change, terrible, backoff", [
    ({}, False, False),
    ({"last_try_ms": NOW - 60_000, "last_seen_ms": 0}, False, False),
    ({"last_try_ms": NOW - 59_999}, False, True),
    ({"last_try_ms": NOW - 60_001, "last_seen_ms": 0}, True, False),
    ({"last_seen_ms": NOW + 600_001}, True, False),
    ({"last_seen_ms": NOW + 600_000}, False, False),
    ({"last_seen_ms": NOW - S.ROUTE_STALE_MS}, False, False),
    ({"last_seen_ms": NOW - S.ROUTE_STALE_MS - 1}, True, False),
    ({"attempts": 3}, True, False),
    ({"attempts": 3, "last_success_ms": NOW}, False, False),
    ({"failures": 10, "last_success_ms": NOW - S.SUCCESS_STALE_MS - 1}, True, False),
    ({"failures": 10, "last_success_ms": NOW - S.SUCCESS_STALE_MS}, False, False),
])
def test_health_limits(spark, change, terrible, backoff):
    row = R.with_health(table(spark, route(1, **change)), NOW).first()
    assert (row.terrible, row.backoff) == (terrible, backoff)


def test_capability_score_of_half_load(spark):
    cap = (True, *map(Decimal, (512, 12, 4096, 128, 10485760, 5242880)), NOW)
    row = R.with_health(table(spark, route(1, capability=cap)), NOW).first()
    assert row.cap_score == pytest.approx(0.55)


def test_full_table_loses_its_weakest_route(spark):
    rows = [route(k, attempts=2 if k == 4 else 0, last_success_ms=NOW) for k in range(1, 6)]
    kept = R.trim_routes(table(spark, *rows), NOW, max_routes=5)
    assert sorted(int(r.node.id, 16) for r in kept.collect()) == [1, 2, 3, 5]
    assert R.trim_routes(table(spark, *rows), NOW, max_routes=6).count() == 5


def test_a_snapshot_of_many_routes_is_one_document(spark, tmp_path):
    most = Decimal(2**64 - 1)
    rows = [route(k, owner=owner, source=("s", 1, hexid(k + 1)), capability=(
                True, most, Decimal(0), Decimal(k), Decimal(0), Decimal(1), most - k, NOW))
            for owner, n in (("many", 10_001), ('a "b"/c=d', 3), ("one", 2)) for k in range(1, n)]
    rows += [rows[-1], route(0, owner="none")]
    path = SR.write_route_snapshots(table(spark, *rows), str(tmp_path / "snap"))
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True).collect()
    docs = {d["owner"]: d for d in (json.loads(r.value) for r in files)}
    assert len(files) == 3 and {o: len(d["entries"]) for o, d in docs.items()} == {
        "many": 10_000, 'a "b"/c=d': 2, "one": 2}
    names = [e["node"]["public_key"] for e in docs["many"]["entries"]]
    assert names == sorted(names)
    back = SR.read_route_snapshots(spark, path, NOW).collect()
    assert sorted((r.owner, r.node.id, r.capability, r.source.id) for r in back) == sorted(
        (r[0], r[1][2], r[3], r[2][2]) for r in rows[:-1])


def test_counters_of_snapshots(spark, tmp_path):
    node = {"host": "h", "port": 1, "id": hexid(7)}
    values = [0, 2**64 - 1, 2**64, 2**63, -1, 1.5, "x", None]
    entries = [{"node": {**node, "id": hexid(i + 1)}, "capability": {"max_ingress_streams": v}}
               for i, v in enumerate(values)]
    (tmp_path / "a.json").write_text(json.dumps({"version": 1, "entries": entries}, indent=1))
    got = SR.read_route_snapshots(spark, str(tmp_path), NOW).orderBy("node.id").collect()
    found = [r.capability and int(r.capability.max_ingress_streams) for r in got]
    assert found[:6] == [0, 2**64 - 1, 0, 2**63, 0, 0]


def test_reading_odd_snapshots(spark, tmp_path):
    node = {"host": "h", "port": 1, "public_key": "0x" + hexid(7).upper()}
    entries = [
        {"node": node, "state": "tried", "hop_count": 99},
        {"node": {**node, "public_key": hexid(8)}, "state": "odd", "last_seen_ms": 0,
         "source": {**node, "public_key": hexid(8)}},
        {"node": {**node, "public_key": hexid(9)}, "state": "tried", "last_success_ms": 5,
         "source": {"host": "s", "port": 2, "id": hexid(7)}},
        {"node": {**node, "port": 0}}, {"node": {**node, "public_key": "12"}},
        {"node": {**node, "public_key": hexid(0)}}, {"state": "new"},
        {"node": {**node, "public_key": hexid(5)}},
    ]
    (tmp_path / "good.json").write_text(json.dumps({"version": 1, "entries": entries}, indent=2))
    (tmp_path / "old.json").write_text(json.dumps({"version": 2, "entries": entries}, indent=2))
    (tmp_path / "none.json").write_text(json.dumps({"version": 1}, indent=2))
    got = SR.read_route_snapshots(spark, str(tmp_path), NOW, F.lit(hexid(5)), multi_line=True)
    rows = {int(r.node.id, 16): r for r in got.collect()}
    assert sorted(rows) == [7, 8, 9]
    assert (rows[7].state, rows[7].hop_count, rows[7].last_seen_ms) == ("new", 8, NOW)
    assert (rows[8].state, rows[8].source, rows[8].last_seen_ms) == ("new", None, NOW)
    assert (rows[9].state, rows[9].source.id) == ("tried", hexid(7))


def test_next_hop_cases(spark):
    linked = dict(kcp_connected=True)
    via = ("h", 9000, hexid(1))
    rows = [route(1, **linked), route(2, source=via, hop_count=3), route(3, source=via, state="bad"),
            route(4), route(5, source=("h", 9000, hexid(4)), hop_count=2),
            route(6, state="bad", **linked), route(7, source=("h", 9000, hexid(6)), hop_count=2)]
    targets = spark.createDataFrame([("o", hexid(k)) for k in range(1, 9)], "owner string, target_id string")
    got = {int(r.target_id, 16): (r.next_hop_id and int(r.next_hop_id, 16), r.direct, r.hop_count)
           for r in R.resolve_next_hop(table(spark, *rows), targets).collect()}
    none = (None, None, None)
    assert got == {1: (1, True, 1), 2: (1, False, 3), 3: none, 4: none, 5: none, 6: none, 7: none,
                   8: none}

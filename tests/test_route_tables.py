"""Route tables from adverts and health events, with and without a bound, against plain walks."""

import random
from decimal import Decimal

import pytest

from test_streams import drain, feed
from tidegauge import schema as S
from tidegauge.operators import bounded_routes as B
from tidegauge.operators import fleet as R
from tidegauge.streaming import routes as SR

NODE = "struct<host:string,port:bigint,id:string>"
LOG = (f"owner string, node {NODE}, source {NODE}, advertised_hops int, "
       f"capability {S.CAPABILITY.simpleString()}, connected boolean, ts_ms long, seq long, kind string")
START = 1_704_000_000_000


def node(k):
    return (f"h{k}", 9000 + k, f"{k:064x}")


def log(seed, n=700, owners="ab", nodes=9):
    rnd, t, rows = random.Random(seed), START, []
    for seq in range(n):
        t += rnd.choice([1, 500, 30_000, 61_000, 700_000, 9 * 86_400_000 if seq % 97 == 0 else 5])
        kind = rnd.choice(["advert"] * 5 + ["attempt", "success", "failure", "failure", "disconnect"])
        most = rnd.choice([0, 10, 2**64 - 1])
        report = (rnd.random() < 0.9, Decimal(10), Decimal(rnd.randrange(12)), Decimal(most),
                  Decimal(rnd.randrange(20)), Decimal(0), Decimal(3), t - rnd.choice([0, 100_000, 200_000]))
        peer = rnd.choice([node(rnd.randint(1, nodes))] * 30 + [("", 1, "1" * 64), ("h", 0, "2" * 64), None])
        rows.append((rnd.choice(owners), peer, rnd.choice([None, node(rnd.randint(1, nodes)), ("", 0, "0" * 64)]),
                     rnd.randrange(11), rnd.choice([None, report]), rnd.random() < 0.12, t, seq, kind))
    return rows


def valid(n):
    return n is not None and n[0] != "" and n[1] != 0 and n[2] != "0" * 64


def score(r, now):
    out = (0.01 if r["tried"] and r["tried"] > now - 600_000 else 1.0) * 0.66 ** min(r["attempts"], 8)
    out *= {"new": 1.0, "tried": 1.25, "bad": 0.05}[r["state"]]
    c = r["report"]
    if c is not None:
        pairs = [(c[i], c[i + 1]) for i in (1, 3, 5)]
        if not c[0]:
            out *= 0.0
        elif c[7] and c[7] < now - 120_000:
            out *= 0.5
        elif any(m and u >= m for m, u in pairs):
            out *= 0.0
        else:
            out *= 0.1 + 0.9 * (1 - min(1.0, max([0.0, *[float(u) / float(m) for m, u in pairs if m]])))
    return out / max(r["hops"], 1) * (0.01 if r["state"] == "bad" else 1.0)


def hopeless(r, now):
    if r["tried"] and r["tried"] >= now - 60_000:
        return False
    return (r["seen"] > now + 600_000 or r["seen"] < now - 30 * 86_400_000
            or not r["success"] and r["attempts"] >= 3
            or r["success"] and r["success"] < now - 7 * 86_400_000 and r["failures"] >= 10)


def walked(rows, room):
    tables, refused = {}, 0
    for owner, peer, source, advertised, report, linked, now, _, kind in rows:
        source = source if valid(source) else None
        hops = 1 if linked else advertised + (source is not None)
        if not valid(peer) or kind == "advert" and hops > 8:
            continue
        table = tables.setdefault(owner, {})
        r = table.get(peer[2])
        if r is None:
            if kind != "advert":
                continue
            if len(table) >= room:
                for i in [i for i, x in table.items() if not x["linked"] and hopeless(x, now)]:
                    del table[i]
                loose = [(score(x, now), i) for i, x in table.items() if not x["linked"]]
                if len(table) >= room and loose:
                    del table[min(loose)[1]]
                if len(table) >= room:
                    refused += 1
                    continue
            table[peer[2]] = dict(node=peer, report=report, hops=hops, source=source, attempts=0, failures=0,
                                  state="tried" if linked else "new", linked=linked, seen=now, tried=0,
                                  success=now if linked else 0)
            continue
        if kind == "advert":
            r |= dict(node=peer, seen=now, report=report or r["report"])
            if source and not r["linked"] and (r["hops"] == 0 or hops < r["hops"]):
                r |= dict(source=source, hops=hops)
            r["state"] = "new" if r["state"] == "bad" else r["state"]
            if linked:
                r |= dict(state="tried", success=now, failures=0, linked=True, hops=1, source=None)
        elif kind == "attempt":
            r |= dict(attempts=r["attempts"] + 1, tried=now)
        elif kind == "success":
            r |= dict(state="tried", failures=0, attempts=0, seen=now, tried=now, success=now)
            r |= dict(linked=True, hops=1, source=None) if linked else {}
        elif kind == "failure":
            r |= dict(failures=r["failures"] + 1, tried=now, linked=False)
            r["state"] = "bad" if r["failures"] >= 10 else "new" if not r["success"] else r["state"]
        else:
            r["linked"] = False
    return sorted((o, i, tuple(r["node"]), r["report"] and tuple(r["report"]), r["hops"],
                   r["source"] and tuple(r["source"]), r["state"], r["attempts"], r["failures"], r["linked"],
                   r["seen"], r["tried"], r["success"]) for o, t in tables.items() for i, r in t.items()), refused


COLUMNS = ["owner", "node_id", "node", "capability", "hop_count", "source", "state", "attempts", "failures",
           "kcp_connected", "last_seen_ms", "last_try_ms", "last_success_ms"]


def found(df):
    return sorted(tuple(tuple(v) if isinstance(v, tuple) else v for v in r) for r in df.select(*COLUMNS).collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_route_table_is_that_of_a_walk(spark, seed):
    rows = log(seed)
    df = spark.createDataFrame(rows, LOG)
    assert found(R.route_table(df)) == walked(rows, 10**6)[0]
    assert R.route_table(df.limit(0)).count() == 0


@pytest.mark.parametrize("room", [1, 3, 6])
def test_bounded_tables_are_those_of_a_walk(spark, room):
    rows = log(room, 900) + log(50, 60, owners="c", nodes=room)
    rows = [(*r[:7], i, r[8]) for i, r in enumerate(rows)]
    want, _ = walked(rows, room)
    assert found(B.bounded_routes(spark.createDataFrame(rows, LOG), room)) == want
    assert max(sum(o == x for o, *_ in want) for x in "abc") <= room


def test_bounded_tables_of_a_stream(spark, tmp_path):
    rows = log(7, 400)
    out = drain(spark, tmp_path, SR.bounded_routes_stream(
        feed(spark, tmp_path, spark.createDataFrame(rows, LOG), "seq"), 4))
    last = out.groupBy("owner").agg({"upto_seq": "max"}).withColumnRenamed("max(upto_seq)", "upto_seq")
    assert found(out.join(last, ["owner", "upto_seq"])) == walked(rows, 4)[0]


def test_a_table_of_links_refuses():
    table = B.RouteTable(2)
    for k in (1, 2, 3):
        table.step("advert", START, True, dict(zip(("host", "port", "id"), node(k))), 1)
    assert sorted(table.rows) == [node(1)[2], node(2)[2]]
    rows = [("o", node(k), None, 1, None, True, START + k, k, "advert") for k in (1, 2, 3)]
    assert walked(rows, 2)[1] == 1


def test_tables_grow_past_their_first_size():
    table = B.RouteTable(3000)
    for k in range(1, 3501):
        table.step("advert", START + k, False, dict(zip(("host", "port", "id"), node(k))), 2)
    assert len(table.rows) == 3000 and len(table.entries()) == 3000
    again = B.RouteTable.of(3000, table.entries())
    assert sorted(again.rows) == sorted(table.rows) and (again.scores(START).sum() > 0)

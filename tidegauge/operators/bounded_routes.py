"""Route tables with room for so many routes, filled in the order adverts arrive.

An advert of an unknown node that finds the table full first drops the hopeless routes without link;
if that gives no room, the route without link that scores lowest goes, and where all are linked the
advert is refused. What an owner knows then depends on the order of its events. Owners that never
heard of more nodes than they have room for are settled by ``fleet.route_table``, in parallel; only
the events of the others are replayed, streamed through the tasks in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tidegauge import schema as S
from tidegauge.operators.fleet import heard_adverts, node_valid, route_table

STATES = ("new", "tried", "bad")
COUNTERS = [f.name for f in S.CAPABILITY.fields[1:-1]]

# Columns of a route on its way through a walk, beside its address, source and report.
_LONGS = ("hops", "state", "attempts", "failures", "seen", "tried", "success")


class RouteTable:
    """The routes of one owner as columns; a route keeps its row while it is known."""

    def __init__(self, max_routes: int) -> None:
        self.max_routes = max_routes
        self.rows: dict[str, int] = {}
        self._free: list[int] = []
        size = min(max_routes, 1024)
        self.longs = {n: np.zeros(size, np.int64) for n in _LONGS}
        self.linked, self.used = np.zeros(size, bool), np.zeros(size, bool)
        self.has_report, self.accepting = np.zeros(size, bool), np.zeros(size, bool)
        self.counters = np.zeros((len(COUNTERS), size), np.uint64)
        self.updated = np.zeros(size, np.int64)
        self.node: list = [None] * size
        self.source: list = [None] * size
        self.report: list = [None] * size

    def _row(self) -> int:
        if self._free:
            return self._free.pop()
        row = len(self.rows)
        if row == len(self.linked):
            more = min(self.max_routes, 2 * row) - row
            self.longs = {n: np.r_[a, np.zeros(more, np.int64)] for n, a in self.longs.items()}
            for name in ("linked", "used", "has_report", "accepting"):
                setattr(self, name, np.r_[getattr(self, name), np.zeros(more, bool)])
            self.counters = np.c_[self.counters, np.zeros((len(COUNTERS), more), np.uint64)]
            self.updated = np.r_[self.updated, np.zeros(more, np.int64)]
            for name in ("node", "source", "report"):
                getattr(self, name).extend([None] * more)
        return row

    def _drop(self, row: int) -> None:
        del self.rows[self.node[row]["id"]]
        self.used[row] = False
        self._free.append(row)

    def _hopeless(self, now: int) -> np.ndarray:
        c = self.longs
        judged = ~((c["tried"] != 0) & (c["tried"] >= now - S.RETRY_BACKOFF_MS))
        old = (c["seen"] > now + S.ROUTE_FUTURE_SKEW_MS) | (c["seen"] == 0) | (
            c["seen"] < now - S.ROUTE_STALE_MS)
        untried = (c["success"] == 0) & (c["attempts"] >= S.GIVE_UP_ATTEMPTS)
        failing = ((c["success"] != 0) & (c["success"] < now - S.SUCCESS_STALE_MS)
                   & (c["failures"] >= S.BAD_FAILURES))
        return judged & (old | untried | failing)

    def scores(self, now: int) -> np.ndarray:
        """As ``fleet.route_score``, with what a bad route counts when a victim is looked for."""
        c = self.longs
        recent = (c["tried"] != 0) & (c["tried"] > now - S.RECENT_TRY_MS)
        chance = np.where(recent, 0.01, 1.0) * 0.66 ** np.minimum(c["attempts"], 8).astype(np.float64)
        chance *= np.choose(c["state"], (1.0, 1.25, 0.05))
        load, full = np.zeros(len(chance)), np.zeros(len(chance), bool)
        for most, current in zip(self.counters[::2], self.counters[1::2]):
            limited = most != 0
            full |= limited & (current >= most)
            share = np.divide(current.astype(np.float64), most.astype(np.float64),
                              out=np.zeros(len(chance)), where=limited)
            load = np.maximum(load, share)
        stale = (self.updated != 0) & (self.updated < now - S.CAPABILITY_STALE_MS)
        report = np.where(~self.accepting, 0.0, np.where(stale, 0.5, np.where(
            full, 0.0, 0.1 + 0.9 * (1.0 - np.minimum(load, 1.0)))))
        score = chance * np.where(self.has_report, report, 1.0)
        score = np.where(c["hops"] > 1, score / np.maximum(c["hops"], 1), score)
        return score * np.where(c["state"] == 2, 0.01, 1.0)

    def make_room(self, now: int) -> bool:
        if len(self.rows) < self.max_routes:
            return True
        loose = self.used & ~self.linked
        for row in np.flatnonzero(loose & self._hopeless(now)):
            self._drop(int(row))
        if len(self.rows) < self.max_routes:
            return True
        candidates = np.flatnonzero(loose)
        if not len(candidates):
            return False
        scores = self.scores(now)[candidates]
        lowest = candidates[scores == scores.min()]  # ties: the smallest id
        self._drop(min(lowest.tolist(), key=lambda r: self.node[r]["id"]))
        return True

    def _set_report(self, row: int, report: dict | None) -> None:
        self.report[row], self.has_report[row] = report, report is not None
        if report is not None:
            self.accepting[row] = bool(report["accepting_ingress"])
            self.counters[:, row] = [int(report[n] or 0) for n in COUNTERS]
            self.updated[row] = int(report["updated_at_ms"] or 0)

    def step(self, kind: str, now: int, linked: bool, node: dict, hops: int = 0,
             source: dict | None = None, report: dict | None = None) -> None:
        """Take one event; adverts are those that ``fleet.heard_adverts`` lets through."""
        row, c = self.rows.get(node["id"]), self.longs
        if row is None:
            if kind != "advert" or not self.make_room(now):
                return
            row = self._row()
            c = self.longs  # the columns may have grown
            self.rows[node["id"]] = row
            self.used[row], self.linked[row] = True, linked
            self.node[row], self.source[row] = node, source
            for name, value in zip(_LONGS, (hops, int(linked), 0, 0, now, 0, now if linked else 0)):
                c[name][row] = value
            self._set_report(row, report)
            return
        if kind == "advert":
            self.node[row], c["seen"][row] = node, now
            if report is not None:
                self._set_report(row, report)
            if source is not None and not self.linked[row] and (
                    c["hops"][row] == 0 or hops < c["hops"][row]):
                self.source[row], c["hops"][row] = source, hops
            if c["state"][row] == 2:
                c["state"][row] = 0
            if linked:
                c["state"][row], c["success"][row], c["failures"][row] = 1, now, 0
        elif kind == "success":
            c["state"][row], c["failures"][row], c["attempts"][row] = 1, 0, 0
            c["seen"][row] = c["tried"][row] = c["success"][row] = now
        elif kind == "attempt":
            c["attempts"][row] += 1
            c["tried"][row] = now
        elif kind == "failure":
            c["failures"][row] += 1
            c["tried"][row] = now
            if c["failures"][row] >= S.BAD_FAILURES:
                c["state"][row] = 2
            elif c["success"][row] == 0:
                c["state"][row] = 0
        if kind in ("failure", "disconnect"):
            self.linked[row] = False
        elif linked and kind in ("advert", "success"):
            self.linked[row], c["hops"][row], self.source[row] = True, 1, None

    def entries(self) -> list[dict]:
        c = self.longs
        return [{"node": self.node[r], "capability": self.report[r], "source": self.source[r],
                 "state": STATES[c["state"][r]], "kcp_connected": bool(self.linked[r]),
                 **{n: int(c[n][r]) for n in _LONGS if n != "state"}} for r in self.rows.values()]

    @classmethod
    def of(cls, max_routes: int, entries: list[dict]) -> RouteTable:
        """A table as ``entries`` left it."""
        out = cls(max_routes)
        for e in entries:
            row = out._row()
            out.rows[e["node"]["id"]] = row
            out.used[row], out.linked[row] = True, e["kcp_connected"]
            out.node[row], out.source[row] = e["node"], e["source"]
            for name in _LONGS:
                out.longs[name][row] = STATES.index(e["state"]) if name == "state" else e[name]
            out._set_report(row, e["capability"])
        return out


_NODE = "struct<host:string,port:bigint,id:string>"
TABLE = (f"owner string, node_id string, node {_NODE}, capability {S.CAPABILITY.simpleString()}, "
         f"hop_count int, source {_NODE}, state string, attempts bigint, failures bigint, "
         "kcp_connected boolean, last_seen_ms bigint, last_try_ms bigint, last_success_ms bigint")


def table_rows(owner: str, entries: list[dict]) -> list[dict]:
    from decimal import Decimal

    def report(c):
        return c and {**c, **{n: Decimal(int(c[n] or 0)) for n in COUNTERS}}

    return [{"owner": owner, "node_id": e["node"]["id"], "node": e["node"],
             "capability": report(e["capability"]), "hop_count": e["hops"], "source": e["source"],
             "state": e["state"], "attempts": e["attempts"], "failures": e["failures"],
             "kcp_connected": e["kcp_connected"], "last_seen_ms": e["seen"], "last_try_ms": e["tried"],
             "last_success_ms": e["success"]} for e in entries]


def walk_events(log: DataFrame) -> DataFrame:
    """The events a walk takes: adverts that count, and the others, with reports of one type."""
    known = log.filter(node_valid(F.col("node")))
    report = F.col("capability")
    fields = [report[f.name].cast(f.dataType).alias(f.name) for f in S.CAPABILITY.fields]
    known = known.withColumn("capability", F.when(report.isNotNull(), F.struct(*fields)))
    columns = ["owner", "seq", "ts_ms", "kind", "connected", "node", "hops", "source", "capability"]
    heard = heard_adverts(known.filter("kind = 'advert'")).select(*columns)
    others = known.filter("kind <> 'advert'").withColumns(
        {"hops": F.lit(0), "source": F.lit(None).cast(_NODE),
         "capability": F.lit(None).cast(S.CAPABILITY)}).select(*columns)
    return heard.unionByName(others)


def take(table: RouteTable, rows: pd.DataFrame) -> None:
    for kind, now, linked, node, hops, source, report in zip(
            rows["kind"], rows["ts_ms"], rows["connected"], rows["node"], rows["hops"], rows["source"],
            rows["capability"]):
        table.step(kind, int(now), bool(linked), plain(node), int(hops), plain(source), plain(report))


def plain(struct) -> dict | None:
    """A struct as a dictionary, whichever way it came to Python."""
    if struct is None or struct is pd.NA or isinstance(struct, float):
        return None
    out = struct.asDict() if hasattr(struct, "asDict") else dict(struct)
    return {k: v if v is None or isinstance(v, (str, bool)) else int(v) for k, v in out.items()}


def bounded_routes(log: DataFrame, max_routes: int = S.MAX_ROUTES) -> DataFrame:
    """As ``fleet.route_table``, for owners with room for ``max_routes`` routes.

    A route that is dropped is forgotten with its history; its next advert starts it anew.
    """
    events = walk_events(log)
    nodes = events.filter("kind = 'advert'").select("owner", F.col("node.id").alias("id")).distinct()
    crowded = nodes.groupBy("owner").count().filter(F.col("count") > max_routes).select("owner")
    settled = route_table(log.join(crowded, "owner", "left_anti"))

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        owner, table = None, None
        for batch in batches:
            for name, rows in batch.groupby("owner", sort=False):
                if name != owner:
                    if table is not None:
                        yield pd.DataFrame(table_rows(owner, table.entries()))
                    owner, table = name, RouteTable(max_routes)
                take(table, rows)
        if table is not None:
            yield pd.DataFrame(table_rows(owner, table.entries()))

    ordered = events.join(crowded, "owner", "left_semi").repartition("owner").sortWithinPartitions(
        "owner", "seq")
    replayed = ordered.mapInPandas(walk, TABLE)
    columns = replayed.columns
    report = F.col("capability")
    fields = [report[f.name].cast(f.dataType).alias(f.name) for f in S.CAPABILITY.fields]
    settled = settled.withColumn("capability", F.when(report.isNotNull(), F.struct(*fields)))
    return settled.select(*columns).unionByName(replayed)

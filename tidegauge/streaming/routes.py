"""Bounded route tables as state: one owner's table, of bounded size, per key."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, types as T
from pyspark.sql.streaming import StatefulProcessor

from tidegauge import schema as S
from tidegauge.operators.bounded_routes import TABLE, RouteTable, table_rows, take, walk_events
from tidegauge.streaming.state import _in_order, _run_processor, _struct


class BoundedTable(StatefulProcessor):
    """Takes an owner's events in order and emits its table after each micro-batch."""

    def __init__(self, max_routes: int):
        self.max_routes = max_routes

    def init(self, handle):
        self.state = handle.getValueState("routes", _struct(entries=T.StringType()))

    def handleInputRows(self, key, rows, timerValues):
        pdf = _in_order(rows, ["seq"])
        held = json.loads(self.state.get()[0]) if self.state.exists() else []
        table = RouteTable.of(self.max_routes, held)
        take(table, pdf)
        entries = table.entries()
        self.state.update((json.dumps(entries),))
        if entries:
            yield pd.DataFrame(table_rows(key[0], entries)).assign(upto_seq=int(pdf["seq"].max()))

    def close(self):
        pass


def bounded_routes_stream(log: DataFrame, max_routes: int = S.MAX_ROUTES) -> DataFrame:
    """Stream form of ``bounded_routes``: the tables that a micro-batch has touched, each whole, with
    the last event they have seen (``upto_seq``)."""
    schema = f"{TABLE}, upto_seq bigint"
    return _run_processor(walk_events(log), ["owner"], BoundedTable(max_routes), schema)

"""Compare a Spark result with the result of its SQL, ignoring row order."""

from __future__ import annotations

import datetime
import decimal
import math
import pathlib
import time

import duckdb

timings: list[float] = []  # seconds each SQL took

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        path = pathlib.Path(sf_dir) / f"{name}.parquet"
        if path.exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    if isinstance(value, decimal.Decimal):
        return f"{value.normalize():f}"
    if isinstance(value, (bytes, bytearray, memoryview)):
        return bytes(value).hex()
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, dict):
        return tuple(plain(v) for v in value.values())
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(row[i]) for i in order) for row in rows]
    return sorted(columns), sorted(out, key=repr)


TYPE_NAMES = {
    "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE",
    "boolean": "BOOLEAN", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP", "binary": "BLOB",
}


def differences(df, con, sql: str) -> list[str]:
    """Empty when both results agree in columns, types and rows."""
    got = sorted_rows(df.columns, [tuple(r) for r in df.collect()])
    started = time.time()
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    types = {c[0]: str(c[1]) for c in cursor.description}
    want = sorted_rows(names, cursor.fetchall())
    timings.append(time.time() - started)
    out = []
    if got[0] != want[0]:
        return [f"columns {got[0]} against {want[0]}"]
    for name, kind in df.dtypes:
        known = TYPE_NAMES.get(kind)
        if known and known != types[name]:
            out.append(f"type of {name}: {kind} against {types[name]}")
    if len(got[1]) != len(want[1]):
        out.append(f"rows {len(got[1])} against {len(want[1])}")
    if got[1] != want[1]:
        only_got = [r for r in got[1] if r not in set(want[1])][:3]
        only_want = [r for r in want[1] if r not in set(got[1])][:3]
        out.append(f"columns {got[0]}: only spark {only_got} only sql {only_want}")
    return out

"""Time-limited device state: presence, idle sessions and the two kinds of duplicate rules."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tidegauge import schema as S
from tidegauge.operators.registry import arrival_order
from tidegauge.session import checkpointed


CUT_TTLS = 64


def split_named(df: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows with a key, and those whose key is empty or NULL: no rule on repeats applies to them."""
    named = F.coalesce(F.col(key) != "", F.lit(False))
    return df.filter(named), df.filter(~named)


def _gap(ttl_ms: int) -> Column:
    # A session window keeps events together that are exactly one gap apart, while a key with a
    # time to live is gone at that very instant: hence one microsecond less. Events are whole
    # milliseconds, so no other pair is affected.
    return F.lit(f"{ttl_ms * 1000 - 1} microseconds")


def _instant(ms: str) -> Column:
    return F.timestamp_millis(F.col(ms))


def _sessions(df: DataFrame, keys: list[str], ms: str, ttl_ms: int,
              first: Column | None = None, seq: str | None = None) -> DataFrame:
    """Sessions of each key: ``_from``, ``_to``, ``_rows`` and, if asked for, the first row.

    Done in two steps, so that no task sees all rows of a key. Each key is cut along time into
    pieces of CUT_TTLS times the time to live, and sessions are built per piece. Then the pieces'
    sessions, as many as the time span allows and not as there are rows, are joined up: one that
    reaches to within the time to live of the next is the same session.
    """
    order = F.struct(ms, seq) if first is not None else None
    sums = [F.min(ms).alias("_from"), F.max(ms).alias("_to"), F.count("*").alias("_rows")]
    if first is not None:
        sums += [F.min(order).alias("_order"), F.min_by(first, order).alias("_first")]
    pieces = (
        df.withColumn("_at", _instant(ms))
        .withColumn("_cut", F.expr(f"{ms} DIV {ttl_ms * CUT_TTLS}"))
        .groupBy(*keys, "_cut", F.session_window("_at", _gap(ttl_ms))).agg(*sums)
        .drop("session_window", "_cut")
    )
    reach = F.concat(((F.col("_to") - F.col("_from") + ttl_ms) * 1000 - 1).cast("string"),
                     F.lit(" microseconds"))
    whole = [F.min("_from").alias("_from"), F.max("_to").alias("_to"), F.sum("_rows").alias("_rows")]
    if first is not None:
        whole.append(F.min_by("_first", F.col("_order")).alias("_first"))
    return (pieces.withColumn("_at", _instant("_from"))
            .groupBy(*keys, F.session_window("_at", reach)).agg(*whole).drop("session_window"))


def presence_sessions(df: DataFrame, keys, ms: str, ttl_ms: int) -> DataFrame:
    """Intervals during which a key was alive: a silence of ``ttl_ms`` or more ends one.

    ``start_ms`` and ``last_ms`` are the first and last event, ``end_ms`` the expiry after it. A
    time to live of 0 means that nothing expires.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    if ttl_ms <= 0:
        return df.groupBy(*keys).agg(
            F.min(ms).alias("start_ms"), F.max(ms).alias("last_ms"), F.count("*").alias("events"),
            F.lit(None).cast("bigint").alias("end_ms"))
    return _sessions(df, keys, ms, ttl_ms).select(
        *keys, F.col("_from").alias("start_ms"), F.col("_to").alias("last_ms"),
        F.col("_rows").alias("events"), (F.col("_to") + ttl_ms).alias("end_ms"))


def idle_sessions(df: DataFrame, ms: str, timeout_ms: int,
                  keys=("peer_ip", "peer_port", "conv")) -> DataFrame:
    """Sessions of a peer, ended by ``timeout_ms`` without traffic; 0 keeps them for ever."""
    return presence_sessions(df, list(keys), ms, timeout_ms)


def dedupe_sliding(df: DataFrame, keys, ms: str, seq: str, ttl_ms: int) -> DataFrame:
    """First arrivals, a repeat within ``ttl_ms`` of the last sighting being a duplicate.

    A duplicate renews the sighting, so an accepted row is the first one of a session.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    rest = [c for c in df.columns if c not in keys]
    row = F.struct(*rest)
    if ttl_ms <= 0:
        firsts = df.groupBy(*keys).agg(F.min_by(row, F.struct(ms, seq)).alias("_first"))
    else:
        firsts = _sessions(df, keys, ms, ttl_ms, row, seq)
    return firsts.select(*keys, "_first.*").select(*df.columns)


def device_online(df: DataFrame, key: str, ms: str, as_of: Column,
                  ttl_ms: int = S.DEVICE_ONLINE_TTL_MS) -> DataFrame:
    """Devices with a message later than ``ttl_ms`` before ``as_of``."""
    seen = df.filter(F.col(ms) <= as_of).groupBy(key).agg(F.max(ms).alias("last_seen_ms"))
    online = F.lit(True) if ttl_ms <= 0 else F.col("last_seen_ms") > as_of - ttl_ms
    return seen.withColumn("online", online)


def state_entries(device: Column, value: Column, state_ttl_ms: int, latest_ttl_ms: int) -> Column:
    """The two entries a message writes: key, value and time to live."""
    def entry(name: str, content: Column, ttl: int) -> Column:
        return F.struct(F.concat(F.lit("device:"), device, F.lit(f":{name}")).alias("key"),
                        content.alias("value"), F.lit(ttl).cast("bigint").alias("ttl_ms"))

    return F.array(entry("state", F.lit("online"), state_ttl_ms), entry("latest", value, latest_ttl_ms))


def device_state(df: DataFrame, key: str, value: str, ms: str,
                 state_ttl_ms: int = S.DEVICE_ONLINE_TTL_MS,
                 latest_ttl_ms: int = S.DEVICE_LATEST_TTL_MS) -> DataFrame:
    """Keyed state rows: ``state`` and ``latest`` of each device, each with its expiry.

    A time to live of 0 gives a NULL expiry: the row never expires.
    """
    last = df.groupBy(key).agg(F.max(ms).alias("written_ms"),
                               F.max_by(value, arrival_order()).alias(value))
    rows = last.select("written_ms", F.inline(
        state_entries(F.col(key), F.col(value), state_ttl_ms, latest_ttl_ms)))
    expiry = F.when(F.col("ttl_ms") > 0, F.col("written_ms") + F.col("ttl_ms"))
    return rows.select("key", "value", expiry.alias("expires_at_ms"))


def alive(state: DataFrame, as_of: Column) -> DataFrame:
    """State rows not yet expired at ``as_of``."""
    return state.filter(F.col("expires_at_ms").isNull() | (F.col("expires_at_ms") > as_of))


def drop_seen(msgs: DataFrame, seen: DataFrame, ttl_ms: int = S.SEEN_TTL_MS) -> DataFrame:
    """Messages whose id is not held by ``seen`` (message_id, seen_ms) when they arrive.

    Messages without id (empty or NULL) always pass; with a time to live of 0 an id is held for ever.
    """
    held = (split_named(seen, "message_id")[0].groupBy(F.col("message_id").alias("_id"))
            .agg(F.max("seen_ms").alias("_seen_ms")))
    hit = F.col("message_id") == F.col("_id")
    if ttl_ms > 0:
        hit = hit & (F.col("arrival_ms") < F.col("_seen_ms") + ttl_ms)
    named, nameless = split_named(msgs, "message_id")
    return named.join(held, hit, "left_anti").unionByName(nameless)


# --- fixed expiry -------------------------------------------------------------------------
# The first arrival sets the expiry and repeats do not renew it, so which row is accepted next
# depends on the row accepted before it. A key quiet for a full time to live starts afresh, which
# cuts its rows into sessions; a session shorter than the time to live accepts its first row only.
# Those two steps are plain aggregations and settle nearly every key. A longer session of at most
# FOLD_ROWS rows is folded as one sorted array. One with more rows is cut into spans of SPAN_TTLS
# times the time to live. Each span is reduced, in parallel, to a step function
# from the last acceptance before the span to the last one within it; chaining these few steps
# gives the state at each span's start, and the spans then mark their rows, again in parallel.

SPAN_TTLS = 64
FOLD_ROWS = 1000


def _chain_ends(times: np.ndarray, ttl: int) -> np.ndarray:
    """For each start, the last acceptance of the chain start, first time >= start + ttl, ..."""
    n = len(times)
    jump = np.append(np.searchsorted(times, times + ttl, side="left"), n)
    end = np.append(np.arange(n), n)
    while True:
        follow = jump[end]
        moved = follow < n
        if not moved.any():
            return times[end[:n]]
        end = np.where(moved, follow, end)


def _span_steps(ttl: int):
    def steps(pdf: pd.DataFrame) -> pd.DataFrame:
        times = np.sort(pdf["_t"].to_numpy())
        start = int(pdf["_span"].iloc[0]) * ttl * SPAN_TTLS
        # Any acceptance before the span has expired one ttl into it.
        entries = times[: np.searchsorted(times, start + ttl, side="left") + 1]
        ends = _chain_ends(times, ttl)[: len(entries)]
        keep = np.append(True, ends[1:] != ends[:-1]) if len(ends) else np.array([], bool)
        last_of_step = np.append(np.flatnonzero(keep)[1:] - 1, len(ends) - 1)
        return pd.DataFrame({
            "_group": pdf["_group"].iloc[0], "_span": pdf["_span"].iloc[0],
            "_upto": [entries[last_of_step].tolist()], "_end": [ends[keep].tolist()],
        })
    return steps


def _entry_states(ttl: int):
    # One row per span, a number bounded by the time a session lasts and not by its rows.
    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        state, states = None, []
        pdf = pdf.sort_values("_span")
        for upto, end in zip(pdf["_upto"], pdf["_end"]):
            states.append(state)
            at = 0 if state is None else int(np.searchsorted(upto, state + ttl, side="left"))
            if at < len(end):
                state = int(end[at])
        return pd.DataFrame({"_group": pdf["_group"], "_span": pdf["_span"],
                             "_state": pd.array(states, dtype="Int64")})
    return walk


def _mark_span(ttl: int):
    def mark(pdf: pd.DataFrame, entry: pd.DataFrame) -> pd.DataFrame:
        times = np.sort(pdf["_t"].to_numpy())
        state = entry["_state"].iloc[0]
        ready = times[0] if pd.isna(state) else int(state) + ttl
        accepted = []
        at = int(np.searchsorted(times, ready, side="left"))
        while at < len(times):
            accepted.append(times[at])
            at = int(np.searchsorted(times, times[at] + ttl, side="left"))
        return pd.DataFrame({"_group": pdf["_group"].iloc[0], "_t": accepted})
    return mark


def dedupe_fixed(df: DataFrame, key: str, ms: str, seq: str,
                 ttl_ms: int = S.SEEN_TTL_MS) -> DataFrame:
    """Rows that are no repeat of an earlier row whose expiry, set once, has not passed.

    Rows whose key is empty or NULL always pass; with a time to live of 0 only a key's first row
    passes.
    """
    named, anonymous = split_named(df, key)
    rest = [c for c in df.columns if c != key]
    row = F.struct(*rest)
    if ttl_ms <= 0:
        kept = named.groupBy(key).agg(F.min_by(row, F.struct(ms, seq)).alias("_first"))
        return kept.select(key, "_first.*").select(*df.columns).unionByName(anonymous)

    sessions = _sessions(named, [key], ms, ttl_ms, row, seq)
    span = F.col("_to") - F.col("_from")
    short = sessions.filter(span < ttl_ms).select(key, "_first.*").select(*df.columns)
    medium = _fold_sessions(named, sessions.filter((span >= ttl_ms) & (F.col("_rows") <= FOLD_ROWS)),
                            key, ms, seq, ttl_ms)

    # One row per time is enough: of rows with the same time only the first can be accepted.
    long = sessions.filter((span >= ttl_ms) & (F.col("_rows") > FOLD_ROWS))
    group = F.struct(F.col(key), F.col("_from"))
    # Read three times below, and small next to the input: written out once.
    points = checkpointed(
        _rows_of(named, long, key, ms, ttl_ms)
        .groupBy(group.alias("_id"), F.col(ms).alias("_t"))
        .agg(F.min_by(F.struct(*df.columns), F.col(seq)).alias("_row"))
        .withColumn("_group", F.to_json("_id"))
        .withColumn("_span", F.expr(f"_t DIV {ttl_ms * SPAN_TTLS}"))
    )
    if points.isEmpty():
        return short.unionByName(medium).unionByName(anonymous)
    times = points.select("_group", "_span", "_t")
    steps = times.groupBy("_group", "_span").applyInPandas(
        _span_steps(ttl_ms),
        "_group string, _span long, _upto array<bigint>, _end array<bigint>")
    entries = steps.groupBy("_group").applyInPandas(
        _entry_states(ttl_ms), "_group string, _span long, _state long")
    marked = times.groupBy("_group", "_span").cogroup(entries.groupBy("_group", "_span")) \
        .applyInPandas(_mark_span(ttl_ms), "_group string, _t long")
    accepted = points.join(marked, ["_group", "_t"]).select("_row.*").select(*df.columns)
    return short.unionByName(medium).unionByName(accepted).unionByName(anonymous)


def _rows_of(rows: DataFrame, sessions: DataFrame, key: str, ms: str, ttl_ms: int) -> DataFrame:
    """Rows that fall into the given sessions, with the session's start.

    They meet by key and time cut: a session is named for every cut it reaches into, and a row looks
    at the sessions of its own cut only, of which there are at most CUT_TTLS and one.
    """
    length = ttl_ms * CUT_TTLS
    spans = sessions.select(F.col(key).alias("_key"), "_from", "_to", F.explode(F.expr(
        f"sequence(_from DIV {length}, _to DIV {length})")).alias("_span_cut"))
    cut = rows.withColumn("_cut", F.expr(f"{ms} DIV {length}"))
    inside = ((F.col(key) == F.col("_key")) & (F.col("_cut") == F.col("_span_cut"))
              & F.col(ms).between(F.col("_from"), F.col("_to")))
    return cut.join(spans, inside).drop("_cut", "_span_cut")


def _fold_sessions(rows: DataFrame, sessions: DataFrame, key: str, ms: str, seq: str,
                   ttl_ms: int) -> DataFrame:
    """Accepted rows of sessions with few rows: a fold over each session's sorted rows."""
    columns = rows.columns
    ordered = F.sort_array(F.collect_list(F.struct(
        F.col(ms).alias("_t"), F.col(seq).alias("_s"), F.struct(*columns).alias("_row"))))
    grouped = _rows_of(rows, sessions, key, ms, ttl_ms).groupBy(key, "_from").agg(ordered.alias("_all"))
    start = F.slice("_all", 1, 1)
    kept = F.aggregate("_all", start, lambda out, row: F.when(
        row["_t"] >= F.element_at(out, -1)["_t"] + ttl_ms, F.array_append(out, row)).otherwise(out))
    return grouped.select(F.inline(kept)).select("_row.*").select(*columns)

"""Rules and alerts on readings: conditions that hold for a time, and thresholds with hysteresis.

Both come down to stretches: the time from the first row of a key for which something holds to the
first later row for which it does not. Stretches are found by comparing each row with the one before,
across time segments, so a key of very many rows is spread over tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidegauge.plans.segments import lag_across

MAX_PATHS = 256
BROADCAST_RULES = 100_000
NUMBERS = "^(BIGINT|DECIMAL|DOUBLE|FLOAT)"  # types of a VARIANT
SEGMENT_MS = 7 * 86_400_000


def _compare(value: Column, op: Column, limit: Column) -> Column:
    return (F.when(op == ">", value > limit).when(op == ">=", value >= limit)
            .when(op == "<", value < limit).when(op == "<=", value <= limit)
            .when(op == "=", value == limit).when(op == "<>", value != limit))


def conditions(messages: DataFrame, rules: DataFrame, key: str, ms: str, seq: str,
               payload: str = "payload") -> DataFrame:
    """``key, rule_id, hold_ms, ms, seq, holds`` for each message and rule that apply to each other.

    ``rules`` has rule_id, path, op, threshold and hold_ms. A rule applies to messages whose payload,
    a JSON text, has a number at its path. A payload is parsed once for all rules; the rules
    themselves are joined as a table, only their different paths are collected.
    """
    paths = [r.path for r in rules.select("path").distinct().limit(MAX_PATHS + 1).collect()]
    if len(paths) > MAX_PATHS:
        raise ValueError(f"rules read more than {MAX_PATHS} payload paths")
    parsed = messages.select(key, ms, seq, F.try_parse_json(F.col(payload).cast("string")).alias("_json"))

    def number(path):  # a text that spells a number is none
        kind = F.schema_of_variant(F.try_variant_get("_json", path, "variant"))
        return F.when(kind.rlike(NUMBERS), F.try_variant_get("_json", path, "double"))

    metrics = F.array(*[F.struct(F.lit(p).alias("path"), number(p).alias("_value")) for p in sorted(paths)])
    if not paths:
        metrics = F.array().cast("array<struct<path:string,_value:double>>")
    values = parsed.select(key, ms, seq, F.inline(metrics)).filter("_value IS NOT NULL")
    held = rules.select("rule_id", "path", "op", "threshold", F.col("hold_ms").cast("bigint"))
    if not rules.isStreaming and rules.count() <= BROADCAST_RULES:
        held = F.broadcast(held)
    holds = _compare(F.col("_value"), F.col("op"), F.col("threshold"))
    return values.join(held, "path").select(key, "rule_id", "hold_ms", ms, seq, holds.alias("holds"))


def stretches(rows: DataFrame, keys: Sequence[str], ms: str, seq: str, holds: str,
              segment_ms: int = SEGMENT_MS) -> DataFrame:
    """``keys, since_ms, end_ms, last_ms``: stretches in which ``holds`` is true.

    A stretch ends at the first row for which it is false; ``end_ms`` is NULL where there is none yet.
    Rows for which it is NULL change nothing. ``last_ms`` is the key's last row of any kind.
    """
    keys = list(keys)
    decided = rows.filter(F.col(holds).isNotNull()).select(
        *keys, ms, seq, F.col(holds).cast("int").alias("_on"))
    segment = F.expr(f"{ms} DIV {segment_ms}")
    before = lag_across(decided, keys, segment, [ms, seq], "_on", "_before")
    # What follows is alternately a beginning and an end.
    changes = before.filter(F.col("_on") != F.coalesce("_before", F.lit(0))).select(*keys, ms, seq, "_on")
    paired = lag_across(changes, keys, segment, [ms, seq], ms, "_since")
    ended = paired.filter("_on = 0").select(
        *keys, F.col("_since").alias("since_ms"), F.col(ms).alias("end_ms"))
    open_ = changes.groupBy(*keys).agg(F.max_by(F.struct("_on", ms), F.struct(ms, seq)).alias("c"))
    open_ = open_.filter("c._on = 1").select(
        *keys, F.col(f"c.{ms}").alias("since_ms"), F.lit(None).cast("bigint").alias("end_ms"))
    last = rows.groupBy(*keys).agg(F.max(ms).alias("last_ms"))
    return ended.unionByName(open_).join(last, keys)


def rule_hits(messages: DataFrame, rules: DataFrame, as_of: Column, key: str, ms: str, seq: str,
              payload: str = "payload", segment_ms: int = SEGMENT_MS) -> DataFrame:
    """``key, rule_id, since_ms, hit_ms``: times at which a rule's condition has held for its time.

    A condition hits once in a stretch: ``hold_ms`` after it began, if it still holds then. Of a
    stretch that goes on, what lies up to ``as_of`` or to the key's last reading is known.
    """
    checked = conditions(messages, rules, key, ms, seq, payload)
    held = stretches(checked, [key, "rule_id", "hold_ms"], ms, seq, "holds", segment_ms)
    hit = F.col("since_ms") + F.col("hold_ms")
    known = F.coalesce("end_ms", F.greatest(as_of, "last_ms"))
    return held.filter(hit <= known).select(key, "rule_id", "since_ms", hit.alias("hit_ms"))


def decisive(value: Column, raise_at: float, clear_at: float) -> Column:
    """True from the raising threshold on, false down to the clearing one, NULL between them."""
    if clear_at >= raise_at:
        raise ValueError("an alert clears below the value that raises it")
    return F.when(value >= raise_at, True).when(value <= clear_at, False)


def alerts(readings: DataFrame, as_of: Column, key: str, ms: str, seq: str, value: str,
           raise_at: float, clear_at: float, renotify_ms: int,
           segment_ms: int = SEGMENT_MS) -> DataFrame:
    """``key, at_ms, kind, n``: an alert is raised, repeated every ``renotify_ms`` and cleared.

    ``n`` counts the repeats of an alert. Nothing is repeated at the instant that clears it; an alert
    that goes on repeats up to ``as_of`` or the key's last reading. Readings without value are none.
    """
    marked = readings.filter(F.col(value).isNotNull()).select(
        key, ms, seq, decisive(F.col(value), raise_at, clear_at).alias("_raised"))
    held = stretches(marked, [key], ms, seq, "_raised", segment_ms)
    upto = F.coalesce(F.col("end_ms") - 1, F.greatest(as_of, "last_ms"))
    repeats = F.expr(f"(_upto - since_ms) DIV {renotify_ms}")
    events = held.withColumn("_upto", upto).withColumn("_times", F.greatest(repeats, F.lit(0)))
    raised = events.select(
        key, F.explode(F.sequence(F.lit(0).cast("bigint"), "_times")).alias("n"), "since_ms").select(
        key, (F.col("since_ms") + F.col("n") * renotify_ms).alias("at_ms"),
        F.when(F.col("n") == 0, "raise").otherwise("repeat").alias("kind"), "n")
    cleared = events.filter("end_ms IS NOT NULL").select(
        key, F.col("end_ms").alias("at_ms"), F.lit("clear").alias("kind"), F.col("_times").alias("n"))
    return raised.unionByName(cleared)

"""Series of readings: as-of joins, and cleaning onto an even grid, cut along time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tidegauge.plans.segments import running_max

SEGMENT_MS = 7 * 86_400_000


def as_of_join(left: DataFrame, right: DataFrame, keys: Sequence[str], ms: str, seq: str,
               columns: Sequence[str], forward: bool = False, tolerance_ms: int | None = None,
               prefix: str = "", segment_ms: int = SEGMENT_MS) -> DataFrame:
    """Each row of ``left`` with the last row of ``right`` not after it: its time and ``columns``.

    ``forward`` takes the first row not before it. Of rows of one time the one with the largest
    ``seq`` counts (forward: the smallest). Without a row, or none within ``tolerance_ms``, the new
    columns are NULL; they are called ``<prefix>ms`` and ``<prefix><column>``.

    Both sides are laid in one order and cut into time segments; only the last ``right`` row of each
    segment is carried over, so neither a key nor a pair of keys is ever held in one place.
    """
    sign = -1 if forward else 1
    seen = F.struct((F.col(ms) * sign).alias("rank"), (F.col(seq) * sign).alias("tie"),
                    F.col(ms).alias("at"), F.struct(*columns).alias("of"))
    right = right.select(*keys, F.col(ms).alias("_ms"), F.lit(0).alias("_side"), seen.alias("_seen"))
    rows = left.select(*keys, F.col(ms).alias("_ms"), F.lit(1).alias("_side"),
                       F.struct(*left.columns).alias("_row"))
    both = rows.unionByName(right, allowMissingColumns=True).withColumn("_order", F.col("_ms") * sign)
    segment = F.floor(F.col("_order") / segment_ms)
    found = running_max(both, keys, segment, ["_order", "_side"], F.col("_seen"), "_last")
    near = F.lit(True) if tolerance_ms is None else F.abs(F.col("_last.at") - F.col("_ms")) <= tolerance_ms
    last = F.when(near, F.col("_last"))
    return found.filter("_side = 1").select(
        "_row.*", last["at"].alias(f"{prefix}ms"), *[last["of"][c].alias(f"{prefix}{c}") for c in columns])


def grid(rows: DataFrame, key: str, ms: str, step_ms: int) -> DataFrame:
    """Multiples of ``step_ms`` from each key's first row to its last."""
    ends = rows.groupBy(key).agg(F.min(ms).alias("_a"), F.max(ms).alias("_b"))
    first = F.expr(f"-floor(-_a / {step_ms}) * {step_ms}").cast("bigint")
    return (ends.withColumn("_first", first).filter("_first <= _b")
            .select(key, F.explode(F.sequence("_first", "_b", F.lit(step_ms).cast("bigint"))).alias(ms)))


def clean_series(readings: DataFrame, key: str, ms: str, seq: str, value: str, step_ms: int,
                 max_gap_ms: int, low: float, high: float, segment_ms: int = SEGMENT_MS) -> DataFrame:
    """``key, ms, value, kind`` on an even grid: measured there, interpolated, or in a gap (NULL).

    Readings without value or outside ``low`` to ``high`` do not count; of several at one time the
    one with the largest ``seq`` does. Between two readings at most ``max_gap_ms`` apart the value
    runs in a straight line.
    """
    good = readings.filter(F.col(value).between(low, high)).groupBy(key, ms).agg(
        F.max_by(value, seq).cast("double").alias("_v"), F.max(seq).alias("_s"))
    points = grid(good, key, ms, step_ms)
    before = as_of_join(points, good, [key], ms, "_s", ["_v"], prefix="_a", segment_ms=segment_ms)
    around = as_of_join(before, good, [key], ms, "_s", ["_v"], forward=True, prefix="_b",
                        segment_ms=segment_ms)
    # ``_ams`` and ``_bms`` are the times before and after, ``_a_v`` and ``_b_v`` the values.
    share = (F.col(ms) - F.col("_ams")) / (F.col("_bms") - F.col("_ams"))
    line = F.col("_a_v") + (F.col("_b_v") - F.col("_a_v")) * share
    measured = F.col("_ams") == F.col(ms)
    close = F.col("_bms") - F.col("_ams") <= max_gap_ms
    return around.select(
        key, ms, F.when(measured, F.col("_a_v")).when(close, line).alias(value),
        F.when(measured, "measured").when(close, "interpolated").otherwise("gap").alias("kind"))

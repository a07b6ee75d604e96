"""Stream forms of rules and alerts: one timer per (device, rule) or alert, on event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from tidegauge.operators.rules import conditions, decisive
from tidegauge.streaming.state import LONG, Keyed, _run, _struct, _watermarked


class _Open(Keyed):
    """What is open at a key: since when, and how much of it has been told."""

    state_schema = _struct(since=LONG, done=LONG)

    def __init__(self, ms: str, seq: str):
        self.ms = ms
        self.order = [ms, seq]


class RuleTimer(_Open):
    """A hit per stretch, when the condition has held for its time: at a row or at the timer."""

    def _hit(self, key, since):
        return key[0], key[1], since, since + key[2]

    def take(self, key, rows, held):
        hold = key[2]
        since, done = held or (None, 0)
        hits = []
        for row in rows:
            now, holds = row[self.ms], row["holds"]
            if holds and since is None:
                since, done = now, 0
            if since is not None and not done and since + hold <= now:
                hits.append(self._hit(key, since))
                done = 1
            if not holds:
                since = None
        if since is None:
            return hits, None, None
        return hits, (since, done), None if done else since + hold

    def expire(self, key, held, watermark_ms):
        since, done = held
        return [] if done else [self._hit(key, since)], (since, 1), None


class AlertTimer(_Open):
    """Raises, repeats and clears the alert of a key; the timer stands at the next repeat."""

    def __init__(self, ms: str, seq: str, renotify_ms: int):
        super().__init__(ms, seq)
        self.every = renotify_ms

    def _repeats(self, since, done, upto):
        return [(since + n * self.every, "repeat", n)
                for n in range(done + 1, max(done, (upto - since) // self.every) + 1)]

    def take(self, key, rows, held):
        since, done = held or (None, 0)
        events = []
        for row in rows:
            now, raised = row[self.ms], row["mark"]
            clears = raised == "no"
            if since is not None:
                repeats = self._repeats(since, done, now - 1 if clears else now)
                events += repeats
                done += len(repeats)
                if clears:
                    events.append((now, "clear", done))
                    since = None
            elif raised == "yes":
                since, done = now, 0
                events.append((now, "raise", 0))
        out = [(key[0], *e) for e in events]
        if since is None:
            return out, None, None
        return out, (since, done), since + (done + 1) * self.every

    def expire(self, key, held, watermark_ms):
        since, done = held
        repeats = self._repeats(since, done, watermark_ms)
        done += len(repeats)
        return [(key[0], *e) for e in repeats], (since, done), since + (done + 1) * self.every


def rule_hits_stream(messages: DataFrame, rules: DataFrame, delay: str, key: str, ms: str, seq: str,
                     payload: str = "payload") -> DataFrame:
    """Stream form of ``rule_hits``: a hit comes with the row or the watermark that proves it."""
    checked = conditions(messages, rules, key, ms, seq, payload)
    schema = T.StructType([messages.schema[key], rules.schema["rule_id"],
                           T.StructField("since_ms", LONG), T.StructField("hit_ms", LONG)])
    return _run(_watermarked(checked, ms, delay), [key, "rule_id", "hold_ms"],
                RuleTimer(ms, seq), schema, True)


def alerts_stream(readings: DataFrame, delay: str, key: str, ms: str, seq: str, value: str,
                  raise_at: float, clear_at: float, renotify_ms: int) -> DataFrame:
    """Stream form of ``alerts``: repeats come as the watermark passes them."""
    raised = decisive(F.col(value), raise_at, clear_at)
    marked = readings.filter(F.col(value).isNotNull()).select(
        key, ms, seq, F.when(raised, "yes").when(~raised, "no").otherwise("").alias("mark"))
    schema = T.StructType([readings.schema[key], T.StructField("at_ms", LONG),
                           T.StructField("kind", T.StringType()), T.StructField("n", LONG)])
    return _run(_watermarked(marked, ms, delay), [key], AlertTimer(ms, seq, renotify_ms), schema, True)

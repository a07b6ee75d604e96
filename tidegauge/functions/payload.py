"""Payload text, clocks and hex identifiers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tidegauge.functions.mac import trimmed

# Fixed patterns: padded standard base64 (with a length that is a multiple of 4), hex digits.
BASE64_TEXT = "^[A-Za-z0-9+/]*={0,2}$"


def encode_payload(data: Column) -> Column:
    """Padded standard base64 on one line."""
    return F.translate(F.base64(data), "\r\n", "")


def decode_payload(text: Column) -> Column:
    """Decoded bytes: zero bytes for blank text, NULL for text that is no padded base64."""
    encoded = F.translate(trimmed(F.coalesce(text, F.lit(""))), "\r\n", "")
    valid = encoded.rlike(BASE64_TEXT) & (F.length(encoded) % 4 == 0)
    return F.when(valid, F.try_to_binary(encoded, F.lit("base64")))


def payload_len_ok(declared: Column, payload: Column) -> Column:
    return declared.isNull() | ((declared >= 0) & (declared == F.octet_length(payload)))


def coalesce_nonzero_ts(*candidates: Column) -> Column:
    """The first candidate that is neither NULL nor 0."""
    return F.coalesce(*[F.nullif(c, F.lit(0).cast("decimal(20,0)")) for c in candidates])


def fits_int64(value: Column) -> Column:
    return value <= F.lit(9223372036854775807).cast("decimal(20,0)")


# The last whole millisecond that a time in microseconds can hold, in the year 294247.
LAST_MS = 9223372036854775


def event_time(ms: Column) -> Column:
    """Epoch milliseconds as UTC wall time; later instants than a time can hold give the last one."""
    return F.timestamp_millis(F.when(ms > LAST_MS, F.lit(LAST_MS)).otherwise(ms)).cast("timestamp_ntz")


def epoch_us(time: Column) -> Column:
    """Microseconds of a UTC wall time: for times past the calendars of other tools."""
    return F.unix_micros(time.cast("timestamp"))


def created_at_or_now(created_ms: Column | None) -> Column:
    now = F.current_timestamp().cast("timestamp_ntz")
    return now if created_ms is None else F.coalesce(event_time(created_ms), now)


def hex_id(text: Column, digits: int = 64) -> Column:
    """Lower hex text of a fixed-width id, an 0x prefix allowed; NULL when malformed."""
    bare = F.lower(F.regexp_replace(text, "^0[xX]", ""))
    return F.when(bare.rlike(f"^[0-9a-f]{{{digits}}}$"), bare)

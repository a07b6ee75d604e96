"""MAC address forms and the three ways a message names its device."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed patterns: where a topic names its device.
DEVICE_TOPIC = "(?:^|/)devices/([^/]+)/telemetry$"
# Only the first "/devices/" of the topic counts; what follows "/telemetry" does not matter.
DEVICE_TOPIC_PREFIX = "^(?:(?!/devices/).)*/devices/([^/]*)/telemetry"

STRICT = r"^[:.-]*(?:[0-9A-Fa-f][:.-]*){12}\z"


# Blanks a text is trimmed of.
BLANKS = " \t\n\x0b\f\r"


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def is_hex12(text: Column) -> Column:
    return (F.length(text) == 12) & (F.translate(text, "0123456789abcdef", "") == "")


def colon_form(hex12: Column) -> Column:
    """aabbccddeeff -> aa:bb:cc:dd:ee:ff"""
    pairs = [F.substring(hex12, 1 + 2 * i, 2) for i in range(6)]
    return F.concat(pairs[0], *[p for pair in pairs[1:] for p in (F.lit(":"), pair)])


def mac_lenient(mac: Column) -> Column:
    """Colon form of a hex MAC; any other text comes back trimmed and in lower case."""
    text = F.lower(trimmed(mac))
    compact = F.translate(text, ":-", "")
    return F.when(is_hex12(compact), colon_form(compact)).otherwise(text)


def is_mac(text: Column) -> Column:
    """Exactly 12 hex digits, separators anywhere; one look at the text. NULL for NULL."""
    return text.rlike(STRICT)


def mac_strict(mac: Column) -> Column:
    """Colon form, NULL unless exactly 12 hex digits remain without separators."""
    compact = F.lower(F.translate(mac, ":-.", ""))
    return F.when(is_mac(mac), F.regexp_replace(compact, "(..)(?=.)", "$1:"))


def mac_compact(mac: Column) -> Column:
    """12 lower hex digits, '' when the text is no MAC; blanks anywhere are dropped."""
    compact = F.lower(F.translate(mac, ":-" + BLANKS, ""))
    return F.when(is_hex12(compact), compact).otherwise("")


def mac_from_topic(topic: Column) -> Column:
    return F.regexp_extract(topic, DEVICE_TOPIC, 1)


def mac_from_topic_prefix(topic: Column) -> Column:
    return F.regexp_extract(topic, DEVICE_TOPIC_PREFIX, 1)


def first_nonempty(*columns: Column) -> Column:
    """The first column that is neither NULL nor '', else NULL."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def topic_regex(topic_filter: str) -> str:
    """Regular expression of an MQTT topic filter: + is one level, a final # is the rest."""
    levels = topic_filter.split("/")
    rest = levels[-1] == "#"
    parts = ["[^/]*" if level == "+" else "\\Q" + level + "\\E"
             for level in (levels[:-1] if rest else levels)]
    return "^" + "/".join(parts) + ("(?:/.*)?$" if rest else "$")


def topic_matches(topic: Column, topic_filter: str) -> Column:
    return topic.rlike(topic_regex(topic_filter))

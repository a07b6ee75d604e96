"""Typed access to the top-level fields of a JSON text.

The text is parsed into a struct of VARIANT fields, which keeps each value's JSON type (the number
5 and the string "5" stay apart), and into a struct of strings, which is the cheapest way to the
values. Reading is strict or lenient by choice: ``*_wrong`` tells
that a field is present with a value of another type, ``*_value`` takes such a field as absent. A
missing key and a JSON null are both "absent". Of duplicate keys the last one counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidegauge.functions.mac import BLANKS

U64_MAX = "18446744073709551615"
_OPTIONS = {"allowSingleQuotes": "false"}


def parse_fields(df: DataFrame, text: str, strings: Sequence[str] = (),
                 numbers: Sequence[str] = (), ints: Sequence[str] = ()) -> DataFrame:
    """Add ``_object`` (the text is a JSON object), and per field ``_t_<field>``, its type name
    (NULL when absent), and ``_s_<field>``, its value as text, or ``_n_<field>``, its value as
    number: DECIMAL(20,0) for ``numbers``, which are unsigned, BIGINT for ``ints``."""
    fields = [*strings, *numbers, *ints]
    kinds = ", ".join(f"{f}: VARIANT" for f in fields)
    texts = ", ".join(f"{f} STRING" for f in fields)
    keep = [F.col(c) for c in df.columns]
    # The parser stops at the end of the first value. Read as the only element of an array, a text
    # with more behind its object is an error or has more elements.
    alone = F.concat(F.lit("["), F.col(text), F.lit("]"))
    parsed = df.select(
        *keep, F.from_json(alone, f"ARRAY<STRUCT<{kinds}>>", _OPTIONS).alias("_all"),
        F.from_json(text, texts, _OPTIONS).alias("_text"),
        F.btrim(text, F.lit(BLANKS)).endswith("}").alias("_closed"),
    ).withColumn("_json", F.try_element_at("_all", F.lit(1)))
    whole = (F.size("_all") == 1) & F.col("_json").isNotNull() & F.col("_closed")
    opened = parsed.select(
        *keep, F.coalesce(whole, F.lit(False)).alias("_object"),
        *[F.col(f"_text.{f}").alias(f"_s_{f}") for f in fields],
        *[F.schema_of_variant(F.col(f"_json.{f}")).alias(f"_t_{f}") for f in fields],
    )
    # A step of its own: the numbers are used several times and costly to read from text.
    return opened.select(
        *keep, "_object", *[f"_t_{f}" for f in fields], *[f"_s_{f}" for f in strings],
        *[_integer(f, "decimal(20,0)", "BIGINT", "DECIMAL(19,0)", "DECIMAL(20,0)") for f in numbers],
        *[_integer(f, "bigint", "BIGINT") for f in ints])


def _integer(field: str, as_type: str, *kinds: str) -> Column:
    value = F.when(F.col(f"_t_{field}").isin(*kinds), F.col(f"_s_{field}").try_cast(as_type))
    return value.alias(f"_n_{field}")


def _absent(field: str) -> Column:
    kind = F.col(f"_t_{field}")
    return kind.isNull() | (kind == "VOID")


def str_value(field: str) -> Column:
    """The string, '' when absent or of another type."""
    return F.when(F.col(f"_t_{field}") == "STRING", F.col(f"_s_{field}")).otherwise("")


def str_wrong(field: str) -> Column:
    return ~_absent(field) & (F.col(f"_t_{field}") != "STRING")


def _u64(field: str) -> Column:
    """The value, NULL unless it is an unsigned 64-bit integer."""
    number = F.col(f"_n_{field}")
    return F.when(number.between(0, F.lit(U64_MAX).cast("decimal(20,0)")), number)


def u64_value(field: str) -> Column:
    """The unsigned integer as DECIMAL(20,0), 0 when absent, negative or of another type."""
    return F.coalesce(_u64(field), F.lit(0).cast("decimal(20,0)"))


def u64_wrong(field: str) -> Column:
    return ~_absent(field) & _u64(field).isNull()


def int_value(field: str) -> Column:
    """The signed integer, NULL when absent or of another type."""
    return F.col(f"_n_{field}")


def int_wrong(field: str) -> Column:
    return ~_absent(field) & (F.col(f"_t_{field}") != "BIGINT")


def evaluated_once(df: DataFrame) -> DataFrame:
    """The same rows, with every column computed before what follows.

    Filters on a derived column are otherwise rewritten in terms of the raw text, which would
    parse each text a second time.
    """
    return df.select(F.inline(F.array(F.struct(*df.columns))))

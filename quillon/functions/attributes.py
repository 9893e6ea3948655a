"""Attributes, ids and times as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NO_SPAN, NONE = "0000000000000000", "none"


def attribute(attributes: Column | str, key: str, filled: bool = False) -> Column:
    """The first string value of a key; with ``filled`` the first that is not empty.  Else null."""
    col = F.col(attributes) if isinstance(attributes, str) else attributes
    ok = lambda a: (a["key"] == key) & a["value"]["string_value"].isNotNull() & (F.lit(not filled) | (a["value"]["string_value"] != ""))
    return F.get(F.filter(col, ok), F.lit(0))["value"]["string_value"]


def has_attribute(attributes: Column, key: str, value: str) -> Column:
    """Whether some attribute has this key and string value; never null."""
    return F.coalesce(F.exists(attributes, lambda a: (a["key"] == key) & (a["value"]["string_value"] == value)), F.lit(False))


def hex_id(raw: Column) -> Column:
    """Lower-case hex of id bytes of any length."""
    return F.lower(F.hex(raw))


def fixed_hex(number: Column) -> Column:
    """16 hex digits, so that texts are in the order of the numbers."""
    return F.lpad(F.lower(F.hex(number)), 16, "0")


def to_timestamp(nanos: Column) -> Column:
    """Spark's microsecond timestamp of a nanosecond time."""
    return F.timestamp_micros(F.floor(nanos / 1000))


def signed(text: Column) -> Column:
    """A 64-bit time from decimal text; from 2**63 on it is negative, as a signed 64-bit integer has it."""
    wide = text.try_cast("decimal(20,0)")
    half, full = F.lit(9223372036854775807).cast("decimal(20,0)"), F.lit("18446744073709551616").cast("decimal(20,0)")
    return F.when(wide > half, wide - full).otherwise(wide).try_cast("bigint")

"""Row keys: projections of the first element of an envelope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import SIGNALS
from .attributes import NO_SPAN, NONE, attribute, fixed_hex

SEPARATOR = "\u0000"


def first(signal: str) -> Column:
    """The first element of the first scope; null if either is missing."""
    column, elements, _ = SIGNALS[signal]
    return F.get(F.get(F.col(column), F.lit(0))[elements], F.lit(0))


def elements(signal: str) -> Column:
    """All elements of all scopes, in order."""
    column, name, _ = SIGNALS[signal]
    return F.flatten(F.transform(F.coalesce(F.col(column), F.array()), lambda s: F.coalesce(s[name], F.array())))


def _filled(c: Column, other: str) -> Column:
    return F.when(c.isNull() | (c == ""), F.lit(other)).otherwise(c)


def service() -> Column:
    return F.coalesce(attribute("resource.attributes", "service.name"), F.lit(""))


def head(signal: str) -> dict[str, Column]:
    """Head columns of a signal: service, time_unix_nano and its other key columns.

    A trace's time is the start of its first span; a log's the observed time
    of its first record, or its own time where that is 0; a metric's the time
    of the first point of its first metric.
    """
    x = first(signal)
    if signal == "traces":
        return {"service": service(), "time_unix_nano": F.coalesce(x["start_time_unix_nano"], F.lit(0)), "span_id": _filled(x["span_id"], NO_SPAN)}
    if signal == "logs":
        time = F.coalesce(F.nullif(x["observed_time_unix_nano"], F.lit(0)), x["time_unix_nano"], F.lit(0))
        log_id = F.concat_ws("_", F.coalesce(x["severity_number"], F.lit(0)).cast("string"), F.coalesce(x["span_id"], F.lit("")))
        return {"service": service(), "time_unix_nano": time, "trace_id": _filled(x["trace_id"], NONE), "log_id": log_id}
    return {"service": service(), "time_unix_nano": F.when(x["type"].isNotNull() & (x["type"] != ""), F.coalesce(F.get(x["points"], F.lit(0))["time_unix_nano"], F.lit(0))).otherwise(F.lit(0)).cast("bigint"), "metric_name": _filled(x["name"], NONE)}


def with_head(df: DataFrame, signal: str) -> DataFrame:
    return df.withColumns(head(signal))


#: Parts of a key after tenant and service, in order.
PARTS = {"traces": ("time_unix_nano", "span_id"), "logs": ("time_unix_nano", "trace_id", "log_id"), "metrics": ("metric_name", "time_unix_nano")}


def text_key(signal: str, tenant: Column | None = None) -> Column:
    """The key as one text: parts joined by NUL, the time as 16 hex digits."""
    part = lambda c: fixed_hex(F.col(c)) if c == "time_unix_nano" else F.col(c)
    return F.concat_ws(SEPARATOR, F.col("tenant_id") if tenant is None else tenant, "service", *map(part, PARTS[signal]))


def parse_key(key: Column, signal: str) -> dict[str, Column]:
    """The parts of a text key."""
    cells = F.split(key, SEPARATOR)
    time = lambda c: F.conv(c, 16, -10).cast("bigint")
    return {n: time(F.get(cells, F.lit(i))) if n == "time_unix_nano" else F.get(cells, F.lit(i)) for i, n in enumerate(("tenant_id", "service", *PARTS[signal]))}


def key_columns(signal: str) -> list[str]:
    return ["tenant_id", "service", *PARTS[signal]]

"""Requests as column expressions.

Head columns come first, as they reach the Parquet scan; conditions on nested
elements follow.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import keys
from ..functions.attributes import has_attribute
from ..functions.tenant import normal
from .requests import SIGNAL_OF, LogRequest, MetricRequest, Request, TraceRequest


def _all(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def rows(request: Request, nested: bool = True) -> Column:
    """What a row must be, without its tenant."""
    signal, parts = SIGNAL_OF[type(request)], []
    if request.service:
        parts.append(F.col("service") == request.service)
    if request.start_time > 0:
        parts.append(F.col("time_unix_nano") >= F.lit(request.start_time).cast("bigint"))
    if request.end_time > 0:
        parts.append(F.col("time_unix_nano") < F.lit(request.end_time).cast("bigint"))
    if isinstance(request, MetricRequest):
        if request.metric_name:
            parts.append(F.col("metric_name") == request.metric_name)
        if request.metric_type:
            parts.append(keys.first(signal)["type"] == request.metric_type)
    if isinstance(request, LogRequest) and request.severity > 0:
        parts.append(keys.first(signal)["severity_number"] == request.severity)
    if isinstance(request, (TraceRequest, LogRequest)) and request.trace_id:
        wanted = request.trace_id.lower()
        parts.append(F.exists(keys.elements(signal), lambda x: x["trace_id"] == wanted))
    parts += [has_attribute(F.col("resource.attributes"), k, v) for k, v in sorted(request.predicates.items())] if nested else []
    return _all(parts)


def whole(request: Request) -> Column:
    """rows(), and the tenant; no tenant is the default one."""
    return (F.col("tenant_id") == normal(request.tenant_id)) & rows(request)


def sure(predicate: Column) -> Column:
    """The predicate with null as false, so that its negation keeps such rows."""
    return F.coalesce(predicate, F.lit(False))

"""Read requests.  0 and empty mean: no such condition."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Request:
    """start_time is inclusive, end_time exclusive, both in nanoseconds."""

    tenant_id: str = ""
    service: str = ""
    start_time: int = 0
    end_time: int = 0
    predicates: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class TraceRequest(Request):
    trace_id: str = ""


@dataclass(frozen=True)
class LogRequest(Request):
    severity: int = 0
    trace_id: str = ""


@dataclass(frozen=True)
class MetricRequest(Request):
    metric_name: str = ""
    metric_type: str = ""


SIGNAL_OF = {TraceRequest: "traces", LogRequest: "logs", MetricRequest: "metrics"}

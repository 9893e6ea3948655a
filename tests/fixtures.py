"""Envelopes made by hand."""

from quillon.schema import envelope

NOW = 1_704_067_200_000_000_000
ID32 = b"1234567890abcdef1234567890abcdef".hex()
SPAN16 = b"abcd1234efgh5678".hex()


def av(v):
    out = dict.fromkeys(("string_value", "bool_value", "int_value", "double_value", "bytes_value", "json_value"))
    if v is not None:
        out["string_value" if isinstance(v, str) else "int_value"] = v
    return out


def attrs(pairs):
    return [{"key": k, "value": av(v)} for k, v in pairs]


def resource(service, *more):
    return {"attributes": attrs([("service.name", service), *more])}


def span(start=NOW, trace_id=ID32, span_id=SPAN16, parent=None, name="op", code=0):
    return {"trace_id": trace_id, "span_id": span_id, "parent_span_id": parent, "name": name, "kind": 1, "start_time_unix_nano": start, "end_time_unix_nano": start + 1_000_000, "attributes": [], "status": {"code": code, "message": None}}


def trace(service, *spans, more=(), scopes=None):
    scopes = [list(spans)] if scopes is None else scopes
    return {"resource": resource(service, *more), "scope_spans": [{"scope": {"name": "test-scope", "version": None}, "spans": s} for s in scopes]}


def log(service, severity=9, trace_id=None, span_id=None, observed=NOW, time=0, body="hello", more=()):
    record = {"time_unix_nano": time, "observed_time_unix_nano": observed, "severity_number": severity, "severity_text": None, "body": av(body), "trace_id": trace_id, "span_id": span_id, "attributes": []}
    return {"resource": resource(service, *more), "scope_logs": [{"scope": {"name": "s", "version": None}, "log_records": [record]}]}


def metric(service, name="cpu.usage", value=1.0, time=NOW, kind="gauge", more=()):
    point = {"time_unix_nano": time, "value_double": value, "value_int": None, "attributes": [], "exemplars": []}
    return {"resource": resource(service, *more), "scope_metrics": [{"scope": {"name": "s", "version": None}, "metrics": [{"name": name, "unit": None, "type": kind, "points": [point]}]}]}


def frame(spark, signal, rows):
    return spark.createDataFrame(rows, envelope(signal))

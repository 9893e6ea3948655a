"""OTLP in its binary form: protobuf payloads to request lines.

A reader of the wire format with a table of the fields that the engine keeps;
other fields are skipped.  It runs in Arrow batches on the executors, so that
imported payloads (such as those of framed logs) take the way of landed lines.
"""

from __future__ import annotations

import base64
import json
import struct

import pyarrow as pa
from pyspark.sql import DataFrame

#: Message -> field number -> (name in JSON, kind, repeated).  Fixed values of the public protocol.
#: Kinds: s text, x id, B bytes, b bool, i integer, e enumeration, n count, z zigzag, f fixed64, w fixed32, q signed fixed64, d double,
#: u count as text, pf, pd, pu packed ones, or a message.
FIELDS = {
    "Request:traces": {1: ("resourceSpans", "ResourceSpans", True)},
    "Request:logs": {1: ("resourceLogs", "ResourceLogs", True)},
    "Request:metrics": {1: ("resourceMetrics", "ResourceMetrics", True)},
    "ResourceSpans": {1: ("resource", "Resource", False), 2: ("scopeSpans", "ScopeSpans", True), 3: ("schemaUrl", "s", False)},
    "ResourceLogs": {1: ("resource", "Resource", False), 2: ("scopeLogs", "ScopeLogs", True), 3: ("schemaUrl", "s", False)},
    "ResourceMetrics": {1: ("resource", "Resource", False), 2: ("scopeMetrics", "ScopeMetrics", True), 3: ("schemaUrl", "s", False)},
    "Resource": {1: ("attributes", "KeyValue", True), 2: ("droppedAttributesCount", "n", False)},
    "KeyValue": {1: ("key", "s", False), 2: ("value", "AnyValue", False)},
    "AnyValue": {1: ("stringValue", "s", False), 2: ("boolValue", "b", False), 3: ("intValue", "i", False), 4: ("doubleValue", "d", False), 5: ("arrayValue", "ArrayValue", False), 6: ("kvlistValue", "KeyValueList", False), 7: ("bytesValue", "B", False)},
    "ArrayValue": {1: ("values", "AnyValue", True)},
    "KeyValueList": {1: ("values", "KeyValue", True)},
    "Scope": {1: ("name", "s", False), 2: ("version", "s", False), 3: ("attributes", "KeyValue", True), 4: ("droppedAttributesCount", "n", False)},
    "ScopeSpans": {1: ("scope", "Scope", False), 2: ("spans", "Span", True), 3: ("schemaUrl", "s", False)},
    "Span": {1: ("traceId", "x", False), 2: ("spanId", "x", False), 3: ("traceState", "s", False), 4: ("parentSpanId", "x", False), 5: ("name", "s", False), 6: ("kind", "e", False), 7: ("startTimeUnixNano", "f", False), 8: ("endTimeUnixNano", "f", False), 9: ("attributes", "KeyValue", True), 10: ("droppedAttributesCount", "n", False), 11: ("events", "Event", True), 12: ("droppedEventsCount", "n", False), 13: ("links", "Link", True), 14: ("droppedLinksCount", "n", False), 15: ("status", "Status", False), 16: ("flags", "w", False)},
    "Event": {1: ("timeUnixNano", "f", False), 2: ("name", "s", False), 3: ("attributes", "KeyValue", True), 4: ("droppedAttributesCount", "n", False)},
    "Link": {1: ("traceId", "x", False), 2: ("spanId", "x", False), 3: ("traceState", "s", False), 4: ("attributes", "KeyValue", True), 5: ("droppedAttributesCount", "n", False), 6: ("flags", "w", False)},
    "Status": {2: ("message", "s", False), 3: ("code", "e", False)},
    "ScopeLogs": {1: ("scope", "Scope", False), 2: ("logRecords", "LogRecord", True), 3: ("schemaUrl", "s", False)},
    "LogRecord": {1: ("timeUnixNano", "f", False), 2: ("severityNumber", "e", False), 3: ("severityText", "s", False), 5: ("body", "AnyValue", False), 6: ("attributes", "KeyValue", True), 7: ("droppedAttributesCount", "n", False), 8: ("flags", "w", False), 9: ("traceId", "x", False), 10: ("spanId", "x", False), 11: ("observedTimeUnixNano", "f", False), 12: ("eventName", "s", False)},
    "ScopeMetrics": {1: ("scope", "Scope", False), 2: ("metrics", "Metric", True), 3: ("schemaUrl", "s", False)},
    "Metric": {1: ("name", "s", False), 2: ("description", "s", False), 3: ("unit", "s", False), 5: ("gauge", "Numbers", False), 7: ("sum", "Numbers", False), 9: ("histogram", "Histograms", False), 10: ("exponentialHistogram", "Exponentials", False), 11: ("summary", "Summaries", False)},
    "Numbers": {1: ("dataPoints", "Number", True), 2: ("aggregationTemporality", "e", False), 3: ("isMonotonic", "b", False)},
    "Histograms": {1: ("dataPoints", "HistogramPoint", True), 2: ("aggregationTemporality", "e", False)},
    "Exponentials": {1: ("dataPoints", "ExponentialPoint", True), 2: ("aggregationTemporality", "e", False)},
    "Summaries": {1: ("dataPoints", "SummaryPoint", True)},
    "Number": {2: ("startTimeUnixNano", "f", False), 3: ("timeUnixNano", "f", False), 4: ("asDouble", "d", False), 5: ("exemplars", "Exemplar", True), 6: ("asInt", "q", False), 7: ("attributes", "KeyValue", True), 8: ("flags", "n", False)},
    "HistogramPoint": {2: ("startTimeUnixNano", "f", False), 3: ("timeUnixNano", "f", False), 4: ("count", "f", False), 5: ("sum", "d", False), 6: ("bucketCounts", "pf", False), 7: ("explicitBounds", "pd", False), 8: ("exemplars", "Exemplar", True), 9: ("attributes", "KeyValue", True), 10: ("flags", "n", False), 11: ("min", "d", False), 12: ("max", "d", False)},
    "ExponentialPoint": {1: ("attributes", "KeyValue", True), 2: ("startTimeUnixNano", "f", False), 3: ("timeUnixNano", "f", False), 4: ("count", "f", False), 5: ("sum", "d", False), 6: ("scale", "z", False), 7: ("zeroCount", "f", False), 8: ("positive", "Buckets", False), 9: ("negative", "Buckets", False), 10: ("flags", "n", False), 11: ("exemplars", "Exemplar", True), 12: ("min", "d", False), 13: ("max", "d", False), 14: ("zeroThreshold", "d", False)},
    "Buckets": {1: ("offset", "z", False), 2: ("bucketCounts", "pu", False)},
    "SummaryPoint": {2: ("startTimeUnixNano", "f", False), 3: ("timeUnixNano", "f", False), 4: ("count", "f", False), 5: ("sum", "d", False), 6: ("quantileValues", "Quantile", True), 7: ("attributes", "KeyValue", True), 8: ("flags", "n", False)},
    "Quantile": {1: ("quantile", "d", False), 2: ("value", "d", False)},
    "Exemplar": {2: ("timeUnixNano", "f", False), 3: ("asDouble", "d", False), 4: ("spanId", "x", False), 5: ("traceId", "x", False), 6: ("asInt", "q", False), 7: ("filteredAttributes", "KeyValue", True)},
}
#: The wire type of each kind; those that are not here have a length.
_WIRE = {"b": 0, "i": 0, "e": 0, "n": 0, "u": 0, "z": 0, "f": 1, "q": 1, "d": 1, "w": 5}
_ENVELOPE = {"traces": "ResourceSpans", "logs": "ResourceLogs", "metrics": "ResourceMetrics"}


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        value |= (b & 0x7F) << shift
        at += 1
        if b < 0x80:
            return value & (1 << 64) - 1, at
        shift += 7
        if shift > 63:
            raise ValueError("varint of more than 64 bits")


def _scalar(kind: str, raw):
    if kind == "s":
        return raw.decode()
    if kind == "x":
        return raw.hex()
    if kind == "B":
        return base64.b64encode(raw).decode()
    if kind == "b":
        return bool(raw)
    if kind in ("e", "n"):
        return raw
    if kind == "u":
        return str(raw)
    if kind == "z":
        return (raw >> 1) ^ -(raw & 1)
    if kind == "w":
        return struct.unpack("<I", raw)[0]
    if kind == "i":
        return str(raw - (1 << 64) if raw >= 1 << 63 else raw)
    return {"f": lambda: str(struct.unpack("<Q", raw)[0]), "q": lambda: str(struct.unpack("<q", raw)[0]), "d": lambda: struct.unpack("<d", raw)[0]}[kind]()


def _packed(kind: str, raw: bytes) -> list:
    out, at = [], 0
    while at < len(raw):
        if _WIRE[kind]:
            one, at = raw[at : at + 8], at + 8
        else:
            one, at = _varint(raw, at)
        out.append(_scalar(kind, one))
    return out


def _number(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes(out) + bytes([n])


def _raw(kind: str, value) -> bytes:
    """The bytes of a scalar, without its tag and length."""
    if kind in _PACK:
        return struct.pack(_PACK[kind], float(value) if kind == "d" else int(value))
    if kind == "z":
        return _number((int(value) << 1 ^ int(value) >> 63) & (1 << 64) - 1)
    if kind in ("b", "i", "e", "n", "u"):
        return _number(int(value) & (1 << 64) - 1)
    return {"s": str.encode, "x": bytes.fromhex, "B": base64.b64decode}[kind](value)


_PACK = {"f": "<Q", "q": "<q", "d": "<d", "w": "<I"}


def encode(value: dict, message: str) -> bytes:
    """A message from its JSON form, with enumerations as numbers; the inverse of ``decode``."""
    out = []
    for number, (name, kind, repeated) in FIELDS[message].items():
        if value.get(name) is None:
            continue
        for v in value[name] if repeated else [value[name]]:
            raw = encode(v, kind) if kind in FIELDS else b"".join(_raw(kind[1], x) for x in v) if kind[0] == "p" else _raw(kind, v)
            wire = _WIRE.get(kind, 2)
            out.append(_number(number << 3 | wire) + (_number(len(raw)) if wire == 2 else b"") + raw)
    return b"".join(out)


def payloads(lines: DataFrame, signal: str, value: str = "value") -> DataFrame:
    """One protobuf envelope (column payload) for each resource of request lines."""
    top = next(iter(FIELDS[f"Request:{signal}"].values()))[0]

    def run(batches):
        for b in batches:
            out = [encode(e, _ENVELOPE[signal]) for line in b.column(0).to_pylist() for e in json.loads(line)[top]]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["payload"])

    return lines.select(value).mapInArrow(run, "payload binary")


def decode(data: bytes, message: str) -> dict:
    """A message as its JSON form; ValueError (or IndexError, struct.error) if it is cut off or malformed."""
    out: dict = {}
    at, fields = 0, FIELDS[message]
    while at < len(data):
        tag, at = _varint(data, at)
        number, wire = tag >> 3, tag & 7
        if wire == 0:
            raw, at = _varint(data, at)
        elif wire in (1, 5):
            size = 8 if wire == 1 else 4
            raw, at = data[at : at + size], at + size
        elif wire == 2:
            size, at = _varint(data, at)
            raw, at = data[at : at + size], at + size
        else:
            raise ValueError(f"wire type {wire}")
        if at > len(data):
            raise ValueError("cut off")
        if number in fields:
            name, kind, repeated = fields[number]
            if kind[0] == "p" and wire in (2, _WIRE[kind[1]]):  # packed, or one by one
                out.setdefault(name, []).extend(_packed(kind[1], raw) if wire == 2 else [_scalar(kind[1], raw)])
                continue
            if wire != _WIRE.get(kind, 2):
                raise ValueError(f"field {number} of {message} has wire type {wire}")
            value = decode(raw, kind) if kind in FIELDS else _scalar(kind, raw)
            if repeated:
                out.setdefault(name, []).append(value)
            else:
                out[name] = value
    return out


def lines(payloads: DataFrame, signal: str, payload: str = "payload", request: bool = False, strict: bool = False) -> DataFrame:
    """Request lines (column value) of payloads that are requests or single envelopes.

    Malformed payloads are skipped, or with ``strict`` an error.
    """
    top = next(iter(FIELDS[f"Request:{signal}"].values()))[0]

    def run(batches):
        for b in batches:
            out = []
            for data in b.column(0).to_pylist():
                try:
                    out.append(json.dumps(decode(data, f"Request:{signal}") if request else {top: [decode(data, _ENVELOPE[signal])]}))
                except (ValueError, IndexError, struct.error, TypeError):
                    if strict:
                        raise
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])

    return payloads.select(payload).mapInArrow(run, "value string")

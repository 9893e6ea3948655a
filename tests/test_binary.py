"""Protobuf payloads, made by a small writer of the wire format."""

import struct

import pytest

from fixtures import NOW
from quillon.sources import framed_log, otlp_binary, otlp_json


def varint(n):
    n &= (1 << 64) - 1
    out = b""
    while n >= 0x80:
        out += bytes([n & 0x7F | 0x80])
        n >>= 7
    return out + bytes([n])


def put(number, value):
    """A field: bytes, text, integer, or ("f", fixed64) and ("d", double)."""
    if isinstance(value, tuple):
        return varint(number << 3 | 1) + struct.pack("<Q" if value[0] == "f" else "<d", value[1])
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    data = value.encode() if isinstance(value, str) else value
    return varint(number << 3 | 2) + varint(len(data)) + data


def attribute(key, value):
    return put(1, put(1, key) + put(2, value))


RESOURCE = put(1, attribute("service.name", put(1, "svc")) + attribute("n", put(3, -5)) + attribute("l", put(5, put(1, put(1, "x")))) + attribute("raw", put(7, b"\x00\x01")))
SPAN = put(1, b"\xab" * 16) + put(2, b"\x01" * 8) + put(5, "op") + put(6, 2) + put(7, ("f", NOW)) + put(8, ("f", NOW + 5)) + put(111, b"an unknown field that is skipped") + put(15, put(3, 2)) + varint(114 << 3 | 5) + b"\0\0\0\0"
TRACE = RESOURCE + put(2, put(1, put(1, "scope")) + put(2, SPAN) + put(2, SPAN))
LOG = RESOURCE + put(2, put(2, put(2, 17) + put(5, put(1, "boom")) + put(9, b"\xcd" * 16) + put(11, ("f", NOW))))
POINT = put(3, ("f", NOW)) + put(4, ("d", 1.5)) + put(5, put(3, ("d", 9.0)) + put(4, b"\x02" * 8) + put(5, b"\xab" * 16))
METRIC = RESOURCE + put(2, put(2, put(1, "cpu") + put(3, "s") + put(5, put(1, POINT))))


def envelopes(spark, signal, *payloads, **more):
    df = spark.createDataFrame([(bytearray(p),) for p in payloads], "payload binary")
    return otlp_json.envelopes(otlp_binary.lines(df, signal, **more), signal).collect()


def test_signals(spark):
    t = envelopes(spark, "traces", TRACE)[0]
    values = {a.key: a.value for a in t.resource.attributes}
    assert values["service.name"].string_value == "svc" and values["n"].int_value == -5 and bytes(values["raw"].bytes_value) == b"\0\1" and "x" in values["l"].json_value
    s = t.scope_spans[0].spans
    assert len(s) == 2 and (s[0].trace_id, s[0].kind, s[0].start_time_unix_nano, s[0].status.code) == ("ab" * 16, 2, NOW, 2)
    r = envelopes(spark, "logs", LOG)[0].scope_logs[0].log_records[0]
    assert (r.severity_number, r.body.string_value, r.observed_time_unix_nano, r.trace_id) == (17, "boom", NOW, "cd" * 16)
    m = envelopes(spark, "metrics", METRIC)[0].scope_metrics[0].metrics[0]
    assert (m.name, m.type, m.points[0].value_double, m.points[0].exemplars[0].span_id) == ("cpu", "gauge", 1.5, "02" * 8)


def test_requests_and_malformed_payloads(spark):
    assert len(envelopes(spark, "traces", put(1, TRACE) + put(1, TRACE), request=True)) == 2
    assert len(envelopes(spark, "traces", TRACE, TRACE[:-3], b"\xff", b"")) == 2  # the empty payload is an empty envelope
    with pytest.raises(Exception, match="cut off|wire type"):
        envelopes(spark, "traces", TRACE[:-3], strict=True)


def test_a_framed_log_is_imported(spark, tmp_path):
    framed_log.append(str(tmp_path / "000001.wal"), [TRACE, TRACE])
    rows = otlp_json.envelopes(otlp_binary.lines(framed_log.tolerant(spark, str(tmp_path)), "traces"), "traces")
    assert rows.count() == 2

"""Whole records: JSON, protobuf and the store keep all fields; replay of framed logs."""

import json

from fixtures import NOW
from quillon.operators.replay import replay
from quillon.operators.store import Store
from quillon.plans.requests import TraceRequest
from quillon.sources import framed_log, otlp_binary, otlp_json

TIME, ID, SHORT = str(NOW), "0a" * 16, "0b" * 8
ATTRS = [{"key": "k", "value": {"intValue": "-7"}}, {"key": "l", "value": {"arrayValue": {"values": [{"stringValue": "x"}]}}}]
RESOURCE = {"attributes": [{"key": "service.name", "value": {"stringValue": "s"}}], "droppedAttributesCount": 2}
SCOPE = {"name": "n", "version": "1", "attributes": ATTRS, "droppedAttributesCount": 1}
SPAN = {"traceId": ID, "spanId": SHORT, "traceState": "a=b", "parentSpanId": SHORT, "name": "op", "kind": 2, "startTimeUnixNano": TIME, "endTimeUnixNano": TIME, "attributes": ATTRS, "droppedAttributesCount": 3, "events": [{"timeUnixNano": TIME, "name": "e", "attributes": ATTRS, "droppedAttributesCount": 1}], "droppedEventsCount": 4, "links": [{"traceId": ID, "spanId": SHORT, "traceState": "c=d", "attributes": ATTRS, "droppedAttributesCount": 6, "flags": 257}], "droppedLinksCount": 5, "status": {"message": "m", "code": 2}, "flags": 4294967295}
RECORD = {"timeUnixNano": TIME, "severityNumber": 9, "severityText": "INFO", "body": {"stringValue": "b"}, "attributes": ATTRS, "droppedAttributesCount": 1, "flags": 1, "traceId": ID, "spanId": SHORT, "observedTimeUnixNano": TIME, "eventName": "ev"}
EXEMPLAR = {"timeUnixNano": TIME, "asInt": "-3", "spanId": SHORT, "traceId": ID, "filteredAttributes": ATTRS}
HISTOGRAM = {"startTimeUnixNano": TIME, "timeUnixNano": TIME, "count": "6", "sum": 2.5, "bucketCounts": ["1", "2", "3"], "explicitBounds": [0.5, 1.5], "exemplars": [EXEMPLAR], "attributes": ATTRS, "flags": 1, "min": 0.25, "max": 9.0}
EXPONENTIAL = {"attributes": ATTRS, "startTimeUnixNano": TIME, "timeUnixNano": TIME, "count": "9", "sum": 1.0, "scale": -2, "zeroCount": "4", "positive": {"offset": -5, "bucketCounts": ["1", "300"]}, "negative": {"offset": 3, "bucketCounts": ["2"]}, "flags": 1, "min": -1.0, "max": 2.0, "zeroThreshold": 0.125}
SUMMARY = {"startTimeUnixNano": TIME, "timeUnixNano": TIME, "count": "5", "sum": 4.0, "quantileValues": [{"quantile": 0.5, "value": 1.0}, {"quantile": 0.99, "value": 3.0}], "attributes": ATTRS}
METRICS = [
    {"name": "g", "description": "d", "unit": "1", "gauge": {"dataPoints": [{"timeUnixNano": TIME, "asInt": "-12", "attributes": ATTRS, "flags": 1}]}},
    {"name": "c", "sum": {"dataPoints": [{"startTimeUnixNano": TIME, "timeUnixNano": TIME, "asDouble": 1.5}], "aggregationTemporality": 2, "isMonotonic": True}},
    {"name": "h", "histogram": {"dataPoints": [HISTOGRAM], "aggregationTemporality": 1}},
    {"name": "e", "exponentialHistogram": {"dataPoints": [EXPONENTIAL], "aggregationTemporality": 2}},
    {"name": "s", "summary": {"dataPoints": [SUMMARY]}},
]
REQUESTS = {
    "traces": {"resourceSpans": [{"resource": RESOURCE, "scopeSpans": [{"scope": SCOPE, "spans": [SPAN], "schemaUrl": "u"}], "schemaUrl": "v"}]},
    "logs": {"resourceLogs": [{"resource": RESOURCE, "scopeLogs": [{"scope": SCOPE, "logRecords": [RECORD]}]}]},
    "metrics": {"resourceMetrics": [{"resource": RESOURCE, "scopeMetrics": [{"scope": SCOPE, "metrics": METRICS}]}]},
}


def test_messages_are_their_own_inverse():
    for signal, request in REQUESTS.items():
        data = otlp_binary.encode(request, f"Request:{signal}")
        assert otlp_binary.decode(data, f"Request:{signal}") == request
    one_by_one = b"".join(bytes([6 << 3 | 1]) + int(n).to_bytes(8, "little") for n in (4, 5))
    assert otlp_binary.decode(one_by_one, "HistogramPoint") == {"bucketCounts": ["4", "5"]}


def test_all_fields_are_stored(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/s")
    lines = {s: spark.createDataFrame([(json.dumps(r),)], "value string") for s, r in REQUESTS.items()}
    for s, df in lines.items():
        again = otlp_binary.lines(otlp_binary.payloads(df, s), s, strict=True)
        by_json, by_binary = (otlp_json.envelopes(x, s).collect() for x in (df, again))
        assert by_json == by_binary
        store.write(s, otlp_json.envelopes(again, s), "t")
        assert [r.asDict(True) for r in store.table(s).select(*by_json[0].__fields__).collect()] == [r.asDict(True) for r in by_json]
    row = store.table("traces").first()
    span = row.scope_spans[0].spans[0]
    assert (row.schema_url, row.scope_spans[0].schema_url, row.resource.dropped_attributes_count, row.scope_spans[0].scope.dropped_attributes_count) == ("v", "u", 2, 1)
    assert (span.trace_state, span.flags, span.events[0].name, span.links[0].flags, span.dropped_links_count) == ("a=b", 4294967295, "e", 257, 5)
    record = store.table("logs").first().scope_logs[0].log_records[0]
    assert (record.flags, record.event_name, record.dropped_attributes_count) == (1, "ev", 1)
    m = {x.name: x for x in store.table("metrics").first().scope_metrics[0].metrics}
    assert [m[k].type for k in "gchse"] == ["gauge", "sum", "histogram", "summary", ""]
    assert (m["c"].temporality, m["c"].monotonic, m["g"].description, m["g"].points[0].value_int) == (2, True, "d", -12)
    h, e, s = (m[k].points[0] for k in "hes")
    assert (h["count"], h.bucket_counts, h.explicit_bounds, h.min, h.max, h.exemplars[0].value_int, h.value_double) == (6, [1, 2, 3], [0.5, 1.5], 0.25, 9.0, -3, 2.5)
    assert (e.scale, e.zero_count, e.positive.offset, e.positive.bucket_counts, e.negative.bucket_counts, e.zero_threshold) == (-2, 4, -5, [1, 300], [2], 0.125)
    assert [(q.quantile, q.value) for q in s.quantiles] == [(0.5, 1.0), (0.99, 3.0)]


def test_replay_goes_on_where_it_ended(spark, tmp_path):
    store, path = Store(spark, f"{tmp_path}/s"), f"{tmp_path}/logs"
    (tmp_path / "logs").mkdir()
    payload = lambda name: otlp_binary.encode({"resource": RESOURCE, "scopeSpans": [{"spans": [SPAN | {"name": name}]}]}, "ResourceSpans")
    framed_log.append(f"{path}/1.wal", [payload("a"), payload("b")])
    ends = replay(store, "traces", path, "t")
    assert store.read(TraceRequest("t")).count() == 2 and list(ends.values()) == [len(open(f"{path}/1.wal", "rb").read())]
    assert replay(store, "traces", path, "t") == ends and store.read(TraceRequest("t")).count() == 2
    framed_log.append(f"{path}/1.wal", [payload("c")])
    framed_log.append(f"{path}/2.wal", [payload("d")])
    with open(f"{path}/2.wal", "ab") as f:
        f.write(framed_log.frame(payload("e"))[:-3])  # a writer is not done yet
    assert len(replay(store, "traces", path, "t")) == 2
    assert sorted(r.scope_spans[0].spans[0].name for r in Store(spark, f"{tmp_path}/s").read(TraceRequest("t")).collect()) == ["a", "b", "c", "d"]

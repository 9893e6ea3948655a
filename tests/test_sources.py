"""Request lines, framed logs, streams and configuration."""

import json

import pytest

from fixtures import ID32, NOW, frame, span, trace
from quillon import config
from quillon.functions.tenant import Resolver
from quillon.operators import silver
from quillon.operators.store import Store
from quillon.plans.requests import LogRequest, MetricRequest, TraceRequest
from quillon.sources import framed_log, otlp_json
from quillon.streaming.ingest import start, start_ingest
from quillon.streaming.windows import error_rates, sampled_traces


def attr(k, **v):
    return {"key": k, "value": v}


RESOURCE = {"attributes": [attr("service.name", stringValue="svc"), attr("tenant.id", stringValue="t1"), attr("n", intValue="42"), attr("list", arrayValue={"values": [{"stringValue": "x"}]})]}
TRACES = {"resourceSpans": [{"resource": RESOURCE, "scopeSpans": [{"scope": {"name": "sc"}, "spans": [{"traceId": "ABCD" * 8, "spanId": "AB" * 8, "name": "op", "kind": "SPAN_KIND_SERVER", "startTimeUnixNano": str(NOW), "endTimeUnixNano": str(NOW + 5), "status": {"code": 2}}, {"traceId": "ff", "spanId": "01", "kind": 3, "startTimeUnixNano": 7}]}]}, {"resource": {"attributes": []}, "scopeSpans": []}]}
LOGS = {"resourceLogs": [{"resource": RESOURCE, "scopeLogs": [{"logRecords": [{"timeUnixNano": str(NOW), "severityNumber": "SEVERITY_NUMBER_WARN", "body": {"stringValue": "b"}}, {"observedTimeUnixNano": "5", "severityNumber": 17}]}]}]}
METRICS = {"resourceMetrics": [{"resource": RESOURCE, "scopeMetrics": [{"metrics": [{"name": "g", "gauge": {"dataPoints": [{"timeUnixNano": str(NOW), "asInt": "3", "exemplars": [{"traceId": "AA", "spanId": "BB", "asDouble": 1.5}]}]}}, {"name": "h", "histogram": {"dataPoints": [{"timeUnixNano": "1", "sum": 2.5}]}}, {"name": "e", "exponentialHistogram": {"dataPoints": []}}]}]}]}


def lines(spark, *values):
    return spark.createDataFrame([(v if v is None or isinstance(v, str) else json.dumps(v),) for v in values], "value string")


def test_traces(spark):
    got = otlp_json.envelopes(lines(spark, TRACES, "{broken", None, "[]", {"resourceSpans": None}), "traces").collect()
    assert len(got) == 2 and got[1].scope_spans == []
    s = got[0].scope_spans[0].spans
    assert (s[0].trace_id, s[0].span_id, s[0].kind, s[0].start_time_unix_nano, s[0].status.code) == ("abcd" * 8, "ab" * 8, 2, NOW, 2)
    assert (s[1].kind, s[1].start_time_unix_nano, s[1].parent_span_id) == (3, 7, None)
    values = {a.key: a.value for a in got[0].resource.attributes}
    assert values["n"].int_value == 42 and json.loads(values["list"].json_value) == {"values": [{"stringValue": "x"}]}


def test_logs_and_metrics(spark):
    record = otlp_json.envelopes(lines(spark, LOGS), "logs").first().scope_logs[0].log_records
    assert [(r.severity_number, r.observed_time_unix_nano) for r in record] == [(13, None), (17, 5)]
    m = otlp_json.envelopes(lines(spark, METRICS), "metrics").first().scope_metrics[0].metrics
    assert [(x.name, x.type) for x in m] == [("g", "gauge"), ("h", "histogram"), ("e", "")]
    assert m[0].points[0].value_int == 3 and m[0].points[0].exemplars[0].trace_id == "aa" and m[1].points[0].value_double == 2.5


def test_malformed_lines(spark, tmp_path):
    df = lines(spark, TRACES, "{broken", {"resourceLogs": []}, " ")
    assert otlp_json.malformed(df, "traces").count() == 2
    df.where("value <> ' '").coalesce(1).write.text(f"{tmp_path}/in")
    assert otlp_json.read(spark, f"{tmp_path}/in", "traces").count() == 2
    with pytest.raises(ValueError):
        otlp_json.read(spark, f"{tmp_path}/in", "traces", strict=True)


def test_streams_of_three_signals(spark, tmp_path):
    for signal, request in (("traces", TRACES), ("logs", LOGS), ("metrics", METRICS)):
        lines(spark, request, "{broken").coalesce(1).write.text(f"{tmp_path}/landing/{signal}")
    with Store(spark, f"{tmp_path}/store") as store:
        for q in start_ingest(store, f"{tmp_path}/landing", f"{tmp_path}/checkpoint", once=True):
            q.awaitTermination()
        assert store.count(TraceRequest("t1"))["count"] == 1 and store.count(TraceRequest())["count"] == 1
        assert store.count(LogRequest("t1", severity=13))["count"] == 1
        assert store.count(MetricRequest("t1", "svc", metric_name="g", start_time=NOW, end_time=NOW + 1))["count"] == 1
        # a restart reads only what is new
        lines(spark, TRACES).coalesce(1).write.mode("append").text(f"{tmp_path}/landing/traces")
        start(store, "traces", f"{tmp_path}/landing/traces", f"{tmp_path}/checkpoint/traces", once=True).awaitTermination()
        assert store.count(TraceRequest("t1"))["count"] == 2


def test_one_batch_or_many(spark, tmp_path):
    rows = [trace(f"s{i % 3}", span(NOW + i)) for i in range(12)]
    by = Resolver("attribute_based", ("service.name",), "none")
    one, many = Store(spark, f"{tmp_path}/one", by), Store(spark, f"{tmp_path}/many", by)
    one.write_traces(frame(spark, "traces", rows))
    for k in range(3):
        many.write_traces(frame(spark, "traces", rows[k::3]))
    read = lambda s: sorted(map(str, s.table("traces").select("tenant_id", "service", "time_unix_nano", "span_id", "scope_spans").collect()))
    assert read(one) == read(many)


def test_export_and_read_again(spark, tmp_path):
    df = frame(spark, "traces", [trace("s", span(), span(NOW + 1, parent="ab"), more=[("n", 5)])])
    otlp_json.write_traces(df, f"{tmp_path}/out")
    back = otlp_json.read(spark, f"{tmp_path}/out", "traces").first()
    assert [(s.trace_id, s.parent_span_id, s.start_time_unix_nano) for s in back.scope_spans[0].spans] == [(ID32, None, NOW), (ID32, "ab", NOW + 1)]
    assert [a.value.int_value for a in back.resource.attributes] == [None, 5]


def test_framed_logs(spark, tmp_path):
    a, b = tmp_path / "000001.wal", tmp_path / "000002.wal"
    framed_log.append(str(a), [b"one", b"two"])
    size = framed_log.append(str(a), [b"three"])
    framed_log.append(str(b), [b"four", b"five", b"six"])
    (tmp_path / "000000.wal.tombstone").write_bytes(b"junk")
    assert size == 3 * 8 + 11
    read = lambda df: sorted(bytes(r.payload) for r in df.collect())
    assert read(framed_log.strict(spark, str(tmp_path))) == sorted([b"one", b"two", b"three", b"four", b"five", b"six"])
    assert read(framed_log.tolerant(spark, str(tmp_path), {"000001.wal": 22})) == sorted([b"three", b"four", b"five", b"six"])
    data = bytearray(b.read_bytes())
    data[20] ^= 1  # in "five"
    b.write_bytes(bytes(data))
    a.write_bytes(a.read_bytes()[:-2])
    assert read(framed_log.tolerant(spark, str(tmp_path))) == sorted([b"one", b"two", b"four", b"six"])
    assert read(framed_log.tolerant(spark, str(tmp_path), stop=True)) == sorted([b"one", b"two", b"four"])
    with pytest.raises(Exception, match="bad record"):
        framed_log.strict(spark, str(tmp_path)).collect()
    with pytest.raises(ValueError):
        framed_log.append(str(a), [b"fine", b""])
    assert a.read_bytes().count(b"fine") == 0


def test_configuration(tmp_path):
    assert config.load(env={}).resolver == Resolver("attribute_based", ("tenant.id", "tenant_id", "k8s.namespace.name"), "default")
    path = tmp_path / "c.json"
    path.write_text(json.dumps({"data_dir": "/d", "http_address": "h:1", "tenant_resolution": {"strategy": "static", "default": "solo"}, "other": 1}))
    got = config.load(str(path), {"QUILLON_HTTP_ADDR": "e:2", "QUILLON_RETENTION_DAYS": "3"})
    assert (got.data_dir, got.http_address, got.retention_days, got.resolver) == ("/d", "e:2", 3, Resolver("static", (), "solo"))


def _stream(spark, tmp_path, make):
    rows = [trace("a", span(NOW, "t1", "1", code=2)), trace("a", span(NOW + 10**9, "t1", "2")), trace("b", span(NOW + 2 * 10**9, "t2", "3")), trace("z", span(NOW + 10**12, "t9", "9"))]
    otlp_json.write_traces(frame(spark, "traces", rows), f"{tmp_path}/in")
    from pyspark.sql import functions as F

    df = otlp_json.stream(spark, f"{tmp_path}/in", "traces")
    df = df.select(F.lit("t").alias("tenant_id"), F.get(F.col("resource.attributes"), F.lit(0))["value"]["string_value"].alias("service"), "resource", F.lit(0).cast("bigint").alias("ingest_seq"), "scope_spans")
    q = make(silver.spans(df)).writeStream.format("memory").queryName(f"out_{make.__name__}").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    return [tuple(r) for r in spark.sql(f"SELECT * FROM out_{make.__name__}").collect()]


def test_windowed_stream(spark, tmp_path):
    got = _stream(spark, tmp_path, error_rates)
    assert sorted(r[1:] for r in got) == [("t", "a", 2, 1), ("t", "b", 1, 0)]


def test_sampling_stream(spark, tmp_path):
    got = _stream(spark, tmp_path, sampled_traces)
    assert [r[:4] for r in got] == [("t", "t1", 2, 1)]

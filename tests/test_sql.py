"""SQL functions, the trace index, an ingest-only store, and the command line."""

import pytest

from fixtures import NOW, frame, log, metric, span, trace
from quillon import __main__ as cli
from quillon.operators.store import IngestStore, Store
from quillon.plans.requests import TraceRequest
from quillon.sources import framed_log, otlp_binary, otlp_json
from quillon.sql import register


def test_functions(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/s")
    spans = [span(NOW, "aa", "1"), span(NOW, "aa", "2", "1"), span(NOW, "aa", "3", "2"), span(NOW, "aa", "4", "gone"), span(NOW, "bb", "9")]
    store.write_traces(frame(spark, "traces", [trace("front", *spans, more=[("env", "prod")])]), "t")
    store.write_logs(frame(spark, "logs", [log("s", 17, "aa", "2", body="boom"), log("s")]), "t")
    m = metric("s", "lat")
    m["scope_metrics"][0]["metrics"][0]["points"][0]["exemplars"] = [{"time_unix_nano": NOW, "value_double": 2.5, "trace_id": "aa", "span_id": "3"}]
    store.write_metrics(frame(spark, "metrics", [m]), "t")
    register(store)
    rows = lambda q: sorted(tuple(r) for r in spark.sql(q).collect())
    assert rows("SELECT span_id, depth, path FROM trace_tree('t', 'AA')") == [("1", 0, "1"), ("2", 1, "1/2"), ("3", 2, "1/2/3"), ("4", 0, "4")]
    assert rows("SELECT span_id, service, exemplar_value FROM exemplar_link('t', 'lat')") == [("3", "front", 2.5)]
    assert rows("SELECT body, severity_number FROM correlated_logs('t', 'aa')") == [("boom", 17)]
    assert rows("SELECT count(*) FROM traces WHERE resource_filter(resource, 'env', 'prod')") == [(1,)]
    assert rows("SELECT count(*) FROM traces WHERE resource_filter(resource, 'env', 'x')") == [(0,)]


def test_deep_trees_and_cycles(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/s", index=False)
    chain = [span(NOW, "cc", str(i), str(i - 1) if i else None) for i in range(200)]
    round_ = [span(NOW, "cc", "x", "y"), span(NOW, "cc", "y", "x"), span(NOW, "cc", "0", "7")]  # a cycle, and a root again
    store.write_traces(frame(spark, "traces", [trace("s", *chain, *round_)]), "t")
    register(store)
    rows = spark.sql("SELECT span_id, max(depth) AS depth FROM trace_tree('t', 'cc') GROUP BY 1").collect()
    assert {r.span_id: r.depth for r in rows if r.span_id != "0"} == {str(i): i for i in range(1, 200)}


def test_dump_shows_every_record(spark, tmp_path, capsys):
    payload = otlp_binary.encode({"resource": {"attributes": [{"key": "service.name", "value": {"stringValue": "s"}}]}, "scopeSpans": [{"spans": [{"name": "a"}, {"name": "b"}]}]}, "ResourceSpans")
    framed_log.append(f"{tmp_path}/2.wal", [payload] * 1500)
    framed_log.append(f"{tmp_path}/10.wal", [b"\xff"])
    assert cli.main(["dump", str(tmp_path)]) == 0
    lines = capsys.readouterr().out.splitlines()
    assert len(lines) == 1502 and lines[-1] == "1501 records" and lines[-2].endswith("\ts\t2")
    assert [f.rsplit("/", 1)[1] for f in framed_log.discover(spark, str(tmp_path))] == ["2.wal", "10.wal"]


def test_index_is_rebuilt(spark, tmp_path):
    plain = Store(spark, f"{tmp_path}/s", index=False)
    for day in ("2024-01-01", "2024-01-02"):
        plain.write_traces(frame(spark, "traces", [trace("s", span(NOW, "aa", "1")), trace("s", span(NOW, "bb", "2"))]), "t", ingest_date=day)
    store = Store(spark, f"{tmp_path}/s")
    store.rebuild_index()
    assert store.trace_index().count() == 4
    assert store.read_trace_by_id("t", "aa").count() == plain.read_trace_by_id("t", "aa").count() == 2
    store.rebuild_index()
    assert store.trace_index().count() == 4


def test_ingest_only(spark, tmp_path):
    store = IngestStore(spark, f"{tmp_path}/s")
    store.write_traces(frame(spark, "traces", [trace("s", span())]), "t")
    with pytest.raises(PermissionError):
        store.read(TraceRequest("t"))
    assert Store(spark, f"{tmp_path}/s").read(TraceRequest("t")).count() == 1


def test_command_line(spark, tmp_path, capsys):
    assert cli.main([]) == 2
    assert cli.main(["send", f"{tmp_path}/landing"]) == 0
    assert otlp_json.read(spark, f"{tmp_path}/landing", "traces").first().scope_spans[0].spans[0].name == "test-span"

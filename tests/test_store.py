"""The store: writes, reads, deletes, retention and compaction."""

from datetime import date

import pytest

from fixtures import ID32, NOW, frame, log, metric, span, trace
from quillon.functions.tenant import Resolver
from quillon.operators.files import Folder
from quillon.operators.maintenance import compact, expire, sweep
from quillon.operators.manifest import Conflict, Manifest
from quillon.operators.store import Store
from quillon.plans.requests import LogRequest, MetricRequest, TraceRequest
from quillon.server import answer

BY_SERVICE = Resolver("attribute_based", ("service.name",), "none")


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/store")


def test_empty(store):
    assert store.read(TraceRequest()).count() == 0
    assert store.read_trace_by_id("", ID32).count() == 0
    assert store.delete(LogRequest()) == 0
    assert compact(store, "traces") == 0 and expire(store, date(2024, 1, 1)) == []


def test_three_signals_of_one_tenant(spark, store):
    store.write_traces(frame(spark, "traces", [trace("s", span())]), "t")
    store.write_logs(frame(spark, "logs", [log("s")]), "t")
    store.write_metrics(frame(spark, "metrics", [metric("s")]), "t")
    for r in (TraceRequest("t"), LogRequest("t"), MetricRequest("t", start_time=1)):
        assert store.count(r) == {"count": 1, "tenant": "t"}


def test_isolation_and_odd_names(spark, store):
    for t in ("tenant-a", "a/b", "..", "x=y%", "42"):
        store.write_traces(frame(spark, "traces", [trace("s", span())]), t)
        assert [r.tenant_id for r in store.read(TraceRequest(t)).collect()] == [t]
    assert store.read(TraceRequest()).count() == 0
    assert store.tenants().count() == 5


def test_resolved_tenants(spark, store):
    rows = [trace("s", span(NOW + i), more=[("tenant.id", f"t{i % 5}")]) for i in range(20)] + [trace("s", span())]
    store.write_traces(frame(spark, "traces", rows))
    assert [store.count(TraceRequest(f"t{i}"))["count"] for i in range(5)] == [4] * 5
    assert store.count(TraceRequest(""))["count"] == 1


def test_rows_are_kept_or_the_latest(spark, store):
    for name in ("old", "new"):
        store.write_traces(frame(spark, "traces", [trace("s", span(name=name))]), "t")
    assert store.read(TraceRequest("t")).count() == 2
    got = store.read(TraceRequest("t"), dedup=True).collect()
    assert [r.scope_spans[0].spans[0].name for r in got] == ["new"]
    assert store.read(TraceRequest("t"), as_of=0).count() == 1


def test_trace_by_id(spark, store):
    rows = [trace("s", span(NOW + i, trace_id="0a" * 16), span(trace_id="bb")) for i in range(15)]
    store.write_traces(frame(spark, "traces", rows), "t", ingest_date="2024-01-01")
    store.write_traces(frame(spark, "traces", rows), "t", ingest_date="2024-01-02")
    assert store.read_trace_by_id("t", "0A" * 16).count() == 30
    assert store.read_trace_by_id("t", "bb").count() == 30  # not the first span
    assert store.read_trace_by_id("other", "bb").count() == 0
    with pytest.raises(ValueError):
        store.read_trace_by_id("t", "")
    before = store.table("traces").count()
    assert compact(store, "traces", target=1 << 20) >= 0
    assert store.read_trace_by_id("t", "bb").count() == 30 and store.table("traces").count() == before


def test_delete_reaches_all_data(spark, store):
    for day in ("2024-01-01", "2024-01-02"):
        store.write_traces(frame(spark, "traces", [trace(s, span(NOW)) for s in ("a", "b", "c")] + [{"resource": None, "scope_spans": None}]), "t/1", ingest_date=day)
    store.write_traces(frame(spark, "traces", [trace("b", span())]), "other")
    assert store.delete_traces(TraceRequest("t/1", "b")) == 2
    assert store.read(TraceRequest("t/1", "b")).count() == 0
    assert store.read(TraceRequest("t/1")).count() == 6
    assert store.read(TraceRequest("other")).count() == 1
    assert Store(spark, store.root).read(TraceRequest("t/1", "b")).count() == 0
    # by a nested condition, which is null for the row without scopes: that row stays
    assert store.delete_traces(TraceRequest("t/1", trace_id=ID32)) == 4
    assert store.read(TraceRequest("t/1")).count() == 2
    assert store.delete_traces(TraceRequest("t/1")) == 2
    assert store.read(TraceRequest("t/1")).count() == 0


def test_delete_of_logs_and_metrics(spark, store):
    store.write_logs(frame(spark, "logs", [log("s", 17), log("s", 9)]), "t")
    store.write_metrics(frame(spark, "metrics", [metric("s"), metric("s", "x")]), "t")
    assert store.delete_logs(LogRequest("t", severity=17)) == 1 and store.read(LogRequest("t")).count() == 1
    assert store.delete_metrics(MetricRequest("t", metric_name="x")) == 1 and store.read(MetricRequest("t")).count() == 1


def test_retention(spark, store):
    for day in ("2024-01-01", "2024-01-08", "2024-01-09"):
        store.write_logs(frame(spark, "logs", [log("s", observed=1)]), "t", ingest_date=day)
    gone = expire(store, date(2024, 1, 15), days=7)
    assert gone == ["logs/tenant_id=t/ingest_date=2024-01-01"]
    assert store.read(LogRequest("t")).count() == 2


def test_compaction_keeps_rows(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s", BY_SERVICE)
    for k in range(3):
        store.write_traces(frame(spark, "traces", [trace(s, span(NOW + k)) for s in ("a", "b")]), ingest_date="2024-01-01")
    rows = lambda: sorted(map(str, store.table("traces").drop("ingest_row").collect()))
    files = lambda: sum(n for n, _ in store.manifest("traces").snapshot().live.values())
    before, many = rows(), files()
    assert compact(store, "traces") == 2
    assert rows() == before and files() == 2 < many
    assert compact(store, "traces") == 0
    assert store.read(TraceRequest("a", "a")).count() == 3
    assert sweep(store, date(2024, 1, 2))["compacted"] == 0


def test_appends_during_a_compaction_or_delete_stay(spark, tmp_path):
    store, other = (Store(spark, f"file://{tmp_path}/s", BY_SERVICE) for _ in range(2))
    for k in range(3):
        store.write_traces(frame(spark, "traces", [trace(s, span(NOW + k)) for s in ("a", "b")]), ingest_date="2024-01-01")
    reader = store.read(TraceRequest("a"))  # of the state before
    append = lambda: other.write_traces(frame(spark, "traces", [trace("a", span(NOW + 9))] * 5), ingest_date="2024-01-01")
    assert compact(store, "traces", before_commit=append) == 2
    assert store.read(TraceRequest("a")).count() == 8 and reader.count() == 3
    assert store.read(TraceRequest("b")).count() == 3
    # a delete that another compaction crosses is done again, on what is there then
    state = store.manifest("traces").snapshot()
    real, calls = store.put, []

    def put(*args):
        if not calls:
            calls.append(compact(other, "traces"))
        return real(*args)

    store.put = put
    assert store.delete_traces(TraceRequest("a", "a", NOW + 9)) == 5 and calls == [1]
    assert store.read(TraceRequest("a")).count() == 3
    assert store.read(TraceRequest("a"), as_of=state.version).count() == 8  # what was there then
    with pytest.raises(Conflict):
        store.manifest("traces").commit(remove=list(state.live))


def test_sweep_deletes_what_nobody_needs(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s", BY_SERVICE)
    for k in range(2):
        store.write_logs(frame(spark, "logs", [log("a", observed=NOW + k)]), ingest_date="2024-01-01")
    store.folder.write("logs/c=lost/tenant_id=a/ingest_date=2024-01-01/x.parquet", "of a writer that died")
    files = lambda: [p for p, _ in store.folder.files("logs")]
    assert sweep(store, date(2024, 1, 2))["deleted"] == 0 and len(files()) == 4  # may still be read
    assert store.vacuum(grace=0) == 2 + 2 and len(files()) == 2  # both old directories, which held nothing else
    assert store.vacuum(grace=0, orphans=0) == 1 and len(files()) == 1
    assert store.read(LogRequest("a")).count() == 2


def test_tombstones_are_stored(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    for t in ("t", "u"):
        store.write_logs(frame(spark, "logs", [log("s", 17), log("s", 9), log("s", 9)]), t, ingest_date="2024-01-01")
    store.bury("logs", store.read(LogRequest("t", severity=9)))
    again = Store(spark, store.root)
    assert again.count(LogRequest("t"))["count"] == 1 and again.count(LogRequest("u"))["count"] == 3
    again.write_logs(frame(spark, "logs", [log("s", 9)]), "t", ingest_date="2024-01-01")  # written later: seen
    assert again.count(LogRequest("t"))["count"] == 2
    assert again.purge("logs") == 1 and again.table("logs").count() == 5 and again.count(LogRequest("t"))["count"] == 2
    assert again.manifest("logs_tombstones").snapshot().live == {} and again.purge("logs") == 0
    assert sweep(again, date(2024, 1, 2), grace=0)["deleted"] > 0 and again.count(LogRequest("u"))["count"] == 3


def test_commits_are_exclusive_and_written_down(spark, tmp_path):
    folder = Folder(spark, f"file://{tmp_path}/f")
    m = Manifest(folder, "t")
    assert [m.commit({f"c={i}/tenant_id=x": [1, 10]}, tag=f"b-{i}") for i in range(45)] == list(range(45))
    assert m.commit({"c=again": [1, 1]}, tag="b-7") == 7
    assert not folder.create("_log/t/00000000000000000044.json", "{}")
    assert m.commit(remove=["c=0/tenant_id=x"], marks={"f": 3}) == 45
    assert len(m.snapshot().live) == 44 and len(m.snapshot(44).live) == 45 and len(m.snapshot(9).live) == 10
    assert m.forget(10) == 20 + 0 and len(m.snapshot().live) == 44 and m.snapshot().marks == {"f": 3}
    with pytest.raises(ValueError):
        m.snapshot(9)
    folder.create("_log/t/00000000000000000046.json", "")  # a writer that died before it wrote
    folder.fs.setTimes(folder._path("_log/t/00000000000000000046.json"), 1000, 1000)
    assert m.commit({"c=z": [1, 1]}) == 47 and len(m.snapshot().live) == 45


def test_wide_partitions_are_cut_into_ranges(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s", index=False)
    rows = [trace(f"s{i % 7}", span(NOW + i, trace_id=f"{i:032x}")) for i in range(400)]
    for k in range(12):
        store.write_traces(frame(spark, "traces", rows[k::12]), "t", ingest_date="2024-01-01")
    store.write_traces(frame(spark, "traces", rows[:1]), "u", ingest_date="2024-01-01")
    store.write_traces(frame(spark, "traces", rows[:1]), "u", ingest_date="2024-01-01")
    size = sum(b for _, b in store.manifest("traces").snapshot().live.values())
    assert compact(store, "traces", target=size // 4) == 2
    assert store.table("traces").count() == 402
    files = [p for p, _ in store.folder.files("traces") if "tenant_id=t/" in p]
    live = [d for d in store.manifest("traces").snapshot().live if "tenant_id=t/" in d]
    kept = sorted(f for f in files if any(f"traces/{d}/" in f for d in live))
    assert len(kept) > 1
    spans = []
    for f in kept:
        r = spark.read.parquet(f"file://{tmp_path}/s/{f}").selectExpr("min(struct(service, time_unix_nano)) AS a", "max(struct(service, time_unix_nano)) AS b").first()
        spans.append((tuple(r.a), tuple(r.b)))
    assert all(x[1] <= y[0] for x, y in zip(sorted(spans), sorted(spans)[1:]))  # ranges that do not overlap
    assert compact(store, "traces", target=size // 4) == 0


def test_a_named_write_happens_once(spark, store):
    df = frame(spark, "traces", [trace("s", span())])
    assert store.write_traces(df, "t", tag="b-0") == store.write_traces(df, "t", tag="b-0")
    assert store.read(TraceRequest("t")).count() == 1


def test_policy_comes_first(spark, store):
    store.write_traces(frame(spark, "traces", [trace("a", span()), trace("b", span())]), "t")
    policy = [{"principal": "p", "signals": ["traces"], "where": [{"attr": "service", "op": "==", "value": "a"}]}]
    assert store.read(TraceRequest("t"), policy=policy, principal="p").count() == 1
    assert store.read(TraceRequest("t", "b"), policy=policy, principal="p").count() == 0


def test_routes(spark, store):
    store.write_traces(frame(spark, "traces", [trace("a", span()), trace("b", span())]), "t")
    store.write_metrics(frame(spark, "metrics", [metric("a", "m")]), "t")
    assert answer(store, "/v1/traces?tenant=t&service=a") == (200, {"count": 1, "tenant": "t"})
    assert answer(store, f"/v1/traces/{ID32}?tenant=t") == (200, {"trace_id": ID32, "count": 2})
    assert answer(store, "/v1/traces/?tenant=t")[0] == 400
    assert answer(store, "/v1/logs") == (200, {"count": 0, "tenant": "default"})
    assert answer(store, "/v1/metrics?tenant=t&metric=m") == (200, {"count": 1, "tenant": "t"})
    assert answer(store, "/other")[0] == 404


def test_reads_prune_and_push(spark, store):
    store.write_traces(frame(spark, "traces", [trace("a", span())]), "t", ingest_date="2024-01-01")
    df = store.read(TraceRequest("t", "a", NOW, NOW + 1)).select("span_id")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(service,a)" in plan and "GreaterThanOrEqual(time_unix" in plan
    assert "isnotnull(tenant_id" in plan.partition("PartitionFilters: ")[2].partition("]")[0]
    assert "parquet" not in store.read(TraceRequest("u"))._jdf.queryExecution().executedPlan().toString()  # no directory of another tenant
    assert "scope_spans" not in plan and "resource" not in plan

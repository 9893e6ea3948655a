"""Tenants, keys and predicates on envelopes made by hand."""

import pytest
from pyspark.sql import functions as F

from fixtures import ID32, NOW, SPAN16, frame, log, metric, resource, span, trace
from quillon.functions import keys
from quillon.functions.attributes import signed
from quillon.functions.tenant import CONFIG_DEFAULT, Resolver
from quillon.plans import acl
from quillon.plans.predicates import rows, whole
from quillon.plans.requests import LogRequest, MetricRequest, TraceRequest

TWO = Resolver("attribute_based", ("tenant.id", "k8s.namespace.name"), "fallback")


@pytest.mark.parametrize(
    "resolver, more, tenant",
    [
        (Resolver(), [("tenant.id", "x")], "default"),
        (TWO, [("tenant.id", "team-payments")], "team-payments"),
        (TWO, [("k8s.namespace.name", "prod-checkout")], "prod-checkout"),
        (TWO, [], "fallback"),
        (Resolver("static", (), "solo"), [("tenant.id", "other")], "solo"),
        (Resolver("attribute_based", ("tenant.id",), "fallback"), [("tenant.id", 42)], "fallback"),
        (Resolver("attribute_based"), [("k8s.namespace.name", "production")], "production"),
        (Resolver("attribute_based"), [], "default"),
        (CONFIG_DEFAULT, [("tenant_id", "legacy-team")], "legacy-team"),
        (CONFIG_DEFAULT, [("service.namespace", "not-configured")], "default"),
        (TWO, [("tenant.id", ""), ("k8s.namespace.name", "second")], "second"),
        (TWO, [("tenant.id", 7), ("tenant.id", "later")], "later"),
    ],
)
def test_resolver(spark, resolver, more, tenant):
    df = frame(spark, "traces", [trace("svc", span(), more=more)])
    assert resolver.resolve(df).first().tenant_id == tenant


def test_resolver_without_resource(spark):
    df = frame(spark, "traces", [{"resource": None, "scope_spans": None}])
    assert TWO.resolve(df).first().tenant_id == "fallback"


def test_batch_keeps_all_rows(spark):
    r = Resolver("attribute_based", ("tenant.id",), "unassigned")
    df = frame(spark, "traces", [trace("s", span(), more=[("tenant.id", t)] if t else []) for t in ("t1", "t2", "t1", None)])
    assert {x.tenant_id: x["count"] for x in r.batch(df).groupBy("tenant_id").count().collect()} == {"t1": 2, "t2": 1, "unassigned": 1}


def heads(spark, signal, rows_):
    return [r.asDict() for r in keys.with_head(frame(spark, signal, rows_), signal).drop("resource", f"scope_{ {'traces': 'spans'}.get(signal, signal)}").collect()]


def test_trace_head(spark):
    got = heads(spark, "traces", [trace("a", span(5), span(1)), trace("b", scopes=[[], [span(9)]]), trace("c", scopes=[])])
    assert [(x["service"], x["time_unix_nano"], x["span_id"]) for x in got] == [("a", 5, SPAN16), ("b", 0, "0" * 16), ("c", 0, "0" * 16)]


def test_log_head(spark):
    got = heads(spark, "logs", [log("a", 13, None, None, NOW), log("a", 9, ID32, SPAN16, 0, 77)])
    assert [(x["time_unix_nano"], x["trace_id"], x["log_id"]) for x in got] == [(NOW, "none", "13_"), (77, ID32, f"9_{SPAN16}")]


def test_metric_head(spark):
    got = heads(spark, "metrics", [metric("a", "m", time=3), metric("a", "h", kind="", time=4), {"resource": resource("z"), "scope_metrics": []}])
    assert [(x["metric_name"], x["time_unix_nano"]) for x in got] == [("m", 3), ("h", 0), ("none", 0)]


def test_key_text(spark):
    df = keys.with_head(frame(spark, "traces", [trace("svc", span(255)), trace("svc", span(256))]), "traces").withColumn("tenant_id", F.lit("t1"))
    got = [r.k for r in df.select(keys.text_key("traces").alias("k")).orderBy("k").collect()]
    assert got[0].split("\0") == ["t1", "svc", "00000000000000ff", SPAN16]
    back = spark.createDataFrame([(got[1],)], "k string").select(*(c.alias(n) for n, c in keys.parse_key(F.col("k"), "traces").items())).first()
    assert (back.tenant_id, back.service, back.time_unix_nano, back.span_id) == ("t1", "svc", 256, SPAN16)


def test_times_from_2_63_are_negative(spark):
    df = spark.createDataFrame([("9223372036854775807",), ("9223372036854775808",), ("18446744073709551615",), ("x",), (None,)], "t string")
    assert [r[0] for r in df.select(signed(F.col("t"))).collect()] == [2**63 - 1, -(2**63), -1, None, None]


def count(spark, signal, envelopes, request):
    df = keys.with_head(frame(spark, signal, envelopes), signal).withColumn("tenant_id", F.lit("default"))
    return df.where(whole(request)).count()


def test_bounds(spark):
    two = [trace("s", span(NOW)), trace("s", span(NOW + 10**9))]
    for start, end, n in ((NOW, NOW + 1, 1), (NOW + 1, 0, 1), (0, NOW, 0), (NOW, NOW + 10**9, 1), (0, 0, 2), (NOW - 1, NOW, 0)):
        assert count(spark, "traces", two, TraceRequest(start_time=start, end_time=end)) == n


def test_trace_predicate(spark):
    envelopes = [trace(s, span()) for s in ("svc-a", "svc-b", "svc-c")] + [trace("svc-b", scopes=[[span()], [span(trace_id="ff")]])]
    assert count(spark, "traces", envelopes, TraceRequest(service="svc-b")) == 2
    assert count(spark, "traces", envelopes, TraceRequest(trace_id="FF")) == 1
    assert count(spark, "traces", envelopes, TraceRequest(tenant_id="other")) == 0


def test_log_predicate(spark):
    envelopes = [log("s", 9), log("s", 13, ID32), log("s", 17)]
    assert count(spark, "logs", envelopes, LogRequest(severity=13)) == 1
    assert count(spark, "logs", envelopes, LogRequest(severity=0)) == 3
    assert count(spark, "logs", envelopes, LogRequest(trace_id=ID32)) == 1


def test_metric_predicate(spark):
    envelopes = [metric("s", "g1"), metric("s", "s1", kind="sum"), metric("s", "h1", kind="histogram"), metric("s", "q1", kind="summary")]
    assert count(spark, "metrics", envelopes, MetricRequest()) == 4
    assert count(spark, "metrics", envelopes, MetricRequest(metric_type="gauge")) == 1
    assert count(spark, "metrics", envelopes, MetricRequest(metric_name="q1", start_time=1)) == 1


def test_attribute_predicates(spark):
    envelopes = [trace("s", span(), more=[("env", "prod"), ("zone", "a")]), trace("s", span(), more=[("env", "prod")]), trace("s", span(), more=[("env", 1)])]
    assert count(spark, "traces", envelopes, TraceRequest(predicates={"env": "prod", "zone": "a"})) == 1
    df = keys.with_head(frame(spark, "traces", envelopes), "traces")
    assert df.where(rows(TraceRequest(predicates={"env": "prod"}))).count() == 2


def test_acl(spark):
    df = keys.with_head(frame(spark, "traces", [trace("a", span(), more=[("env", "prod")]), trace("b", span())]), "traces").withColumn("tenant_id", F.col("service"))
    policy = [
        {"principal": "p", "signals": ["traces"], "where": [{"attr": "tenant", "op": "in", "value": ["a", "b"]}, {"attr": "env", "op": "==", "value": "prod"}]},
        {"principal": "q", "signals": ["logs"], "where": "all"},
    ]
    assert [r.service for r in acl.restrict(df, policy, "p", "traces").collect()] == ["a"]
    assert acl.restrict(df, policy, "q", "traces").count() == 0
    assert acl.restrict(df, policy, "q", "logs").count() == 2
    assert acl.restrict(df, policy, "nobody", "traces").count() == 0
    with pytest.raises(ValueError):
        acl.condition({"attr": "x", "op": "like", "value": "y"})

"""The registered queries of the engine's own operators over the driver's tables, and their SQL."""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import keys
from .functions.attributes import attribute
from .functions.tenant import CONFIG_DEFAULT, Resolver
from .operators import analytics, mutation, silver
from .operators.maintenance import compact, expire
from .operators.store import Store
from .plans import acl
from .plans.predicates import rows, whole
from .plans.requests import SIGNAL_OF, LogRequest, MetricRequest, Request, TraceRequest
from . import sql
from .schema import SIGNALS
from .server import answer
from .session import shared_folder
from .sources import adapters, framed_log, otlp_binary, otlp_json
from .streaming.ingest import start

NANOS = 1_000_000_000
T0 = 1_704_067_200 * NANOS  # 2024-01-01
DAY = 86_400 * NANOS
TRACE = "00000000000000050000000000000003"
PRINCIPAL, POLICY = "oncall", [
    {"principal": "oncall", "signals": ["traces", "logs"], "where": [{"attr": "tenant", "op": "in", "value": ["tenant-1", "tenant-2"]}, {"attr": "service.name", "op": "==", "value": "svc-2"}]},
    {"principal": "oncall", "signals": ["traces"], "where": [{"attr": "service.namespace", "op": "==", "value": "group-7"}]},
    {"principal": "auditor", "signals": ["metrics"], "where": "all"},
]
HEAD = {"traces": ("tenant_id", "service", "time_unix_nano", "span_id"), "logs": ("tenant_id", "service", "time_unix_nano", "trace_id", "log_id"), "metrics": ("tenant_id", "service", "metric_name", "time_unix_nano")}
MAKE = {"traces": adapters.traces, "logs": adapters.logs, "metrics": adapters.metrics}

#: The adapter in SQL.
SIG = """WITH sig AS (SELECT event_id, user_id, event_type, value, 'tenant-' || (user_id % 4) AS tenant_id, 'svc-' || (user_id % 10) AS service,
  epoch_us(ts) * 1000 AS time_unix_nano, lpad(lower(hex(user_id)), 16, '0') || lpad(lower(hex(date_diff('day', DATE '2024-01-01', ts::DATE))), 16, '0') AS trace_id,
  lpad(lower(hex(event_id)), 16, '0') AS span_id, CASE event_type WHEN 'error' THEN 17 WHEN 'purchase' THEN 13 ELSE 9 END AS severity_number,
  CASE WHEN event_type IN ('click', 'view') THEN 'gauge' ELSE 'sum' END AS metric_type, ts::DATE AS day FROM events)
"""
SQL_HEAD = {"traces": "tenant_id, service, time_unix_nano, span_id", "logs": "tenant_id, service, time_unix_nano, trace_id, severity_number || '_' || span_id AS log_id", "metrics": "tenant_id, service, event_type AS metric_name, time_unix_nano"}


def _signal(spark: SparkSession, sf_dir: str, signal: str) -> DataFrame:
    return MAKE[signal](adapters.events(spark, sf_dir))


def _read(request: Request):
    signal = SIGNAL_OF[type(request)]
    return lambda spark, sf_dir: _signal(spark, sf_dir, signal).where(whole(request)).select(*HEAD[signal])


def _sql(signal: str, where: str) -> str:
    return f"{SIG}SELECT {SQL_HEAD[signal]} FROM sig WHERE {where}"


#: name: (request, the same condition in SQL)
READS = {
    "trace_scan_tenant": (TraceRequest("tenant-1"), "tenant_id = 'tenant-1'"),
    "trace_filter_service": (TraceRequest("tenant-1", "svc-5"), "tenant_id = 'tenant-1' AND service = 'svc-5'"),
    "trace_filter_time": (TraceRequest("tenant-1", "svc-5", T0 + 5 * DAY, T0 + 15 * DAY), f"tenant_id = 'tenant-1' AND service = 'svc-5' AND time_unix_nano >= {T0 + 5 * DAY} AND time_unix_nano < {T0 + 15 * DAY}"),
    "trace_filter_trace_id": (TraceRequest("tenant-1", trace_id=TRACE), f"tenant_id = 'tenant-1' AND trace_id = '{TRACE}'"),
    "log_filter_service": (LogRequest("tenant-2", "svc-6"), "tenant_id = 'tenant-2' AND service = 'svc-6'"),
    "log_filter_severity": (LogRequest("tenant-1", severity=17), "tenant_id = 'tenant-1' AND severity_number = 17"),
    "log_filter_time": (LogRequest("tenant-3", start_time=T0 + DAY, end_time=T0 + 4 * DAY), f"tenant_id = 'tenant-3' AND time_unix_nano >= {T0 + DAY} AND time_unix_nano < {T0 + 4 * DAY}"),
    "log_filter_trace_id": (LogRequest("tenant-1", trace_id=TRACE), f"tenant_id = 'tenant-1' AND trace_id = '{TRACE}'"),
    "metric_filter_name": (MetricRequest("tenant-0", metric_name="purchase"), "tenant_id = 'tenant-0' AND event_type = 'purchase'"),
    "metric_filter_type": (MetricRequest("tenant-0", metric_type="sum"), "tenant_id = 'tenant-0' AND metric_type = 'sum'"),
    "metric_filter_time": (MetricRequest("tenant-0", "svc-4", T0 + 2 * DAY, T0 + 9 * DAY), f"tenant_id = 'tenant-0' AND service = 'svc-4' AND time_unix_nano >= {T0 + 2 * DAY} AND time_unix_nano < {T0 + 9 * DAY}"),
    "attr_predicate": (TraceRequest("tenant-1", predicates={"service.namespace": "group-13"}), "tenant_id = 'tenant-1' AND event_id % 5 = 3 AND user_id = 13"),
}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traces of one tenant and service in a half-open time range."""
    return _read(READS["trace_filter_time"][0])(spark, sf_dir)


def trace_by_id(spark, sf_dir):
    df = _signal(spark, sf_dir, "traces").where(whole(TraceRequest("tenant-1", trace_id=TRACE)))
    return silver.spans(df).where(F.col("trace_id") == TRACE).select("tenant_id", "service", "trace_id", "span_id", "name", "start_time_unix_nano")


def count_by_tenant(spark, sf_dir):
    parts = [_signal(spark, sf_dir, s).groupBy("tenant_id").agg(F.count(F.lit(1)).alias("envelopes")).withColumn("signal", F.lit(s)) for s in HEAD]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _resolve(resolver: Resolver):
    def run(spark, sf_dir):
        df = adapters.events(spark, sf_dir).select("event_id", adapters.resource().alias("resource"))
        return resolver.resolve(df).select("event_id", "tenant_id")

    return run


def _keys(signal):
    def run(spark, sf_dir):
        df = _signal(spark, sf_dir, signal)
        df = df.select("tenant_id", *(c for c in df.columns if c not in ("service", "time_unix_nano", "span_id", "trace_id", "log_id", "metric_name", "tenant_id")))
        df = keys.with_head(df, signal)
        cells = F.split(keys.text_key(signal), keys.SEPARATOR)
        return df.select(*HEAD[signal], F.get(cells, F.lit(keys.PARTS[signal].index("time_unix_nano") + 2)).alias("time_hex"))

    return run


def ordered_scan(spark, sf_dir):
    """Trace keys of a tenant in their order, with their rank in it."""
    df = _signal(spark, sf_dir, "traces").where(F.col("tenant_id") == "tenant-1")
    w = Window.partitionBy("service").orderBy("time_unix_nano", "span_id")
    return df.select("service", "time_unix_nano", "span_id", F.row_number().over(w).cast("bigint").alias("position"))


def upsert_latest(spark, sf_dir):
    """Metric rows with times cut to days, so that keys are written many times."""
    df = _signal(spark, sf_dir, "metrics").withColumn("time_unix_nano", F.col("time_unix_nano") - F.pmod("time_unix_nano", F.lit(DAY)))
    point = F.get(keys.first("metrics")["points"], F.lit(0))
    return mutation.latest(df.withColumn("value", point["value_double"]).drop("resource", "scope_metrics"), "metrics").select(*HEAD["metrics"], "value", "ingest_seq")


_DELETE = TraceRequest("tenant-1", "svc-5", T0 + 5 * DAY, T0 + 15 * DAY)


def delete_by_predicate(spark, sf_dir):
    return mutation.without(_signal(spark, sf_dir, "traces"), (F.col("tenant_id") == "tenant-1") & rows(_DELETE)).select(*HEAD["traces"])


def tombstone_anti_join(spark, sf_dir):
    df = _signal(spark, sf_dir, "logs")
    return mutation.without_tombstones(df, df.where(keys.first("logs")["severity_number"] == 17), "logs").select(*HEAD["logs"])


def ttl_retained(spark, sf_dir):
    return mutation.retained(_signal(spark, sf_dir, "traces"), "2024-01-20").select(*HEAD["traces"])


def time_travel(spark, sf_dir):
    return mutation.as_of(_signal(spark, sf_dir, "metrics"), 2500).select(*HEAD["metrics"])


def _scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/quillon/{name}-{uuid.uuid4().hex}"


def _envelopes(spark, sf_dir, where: str = "true") -> DataFrame:
    return _signal(spark, sf_dir, "traces").where(where).select("resource", "scope_spans")


_TENANTS = Resolver("attribute_based", ("service.name",), "none")


def compaction_invariant(spark, sf_dir):
    """Rows of a store after four writes and a compaction of its many small files."""
    store = Store(spark, _scratch(spark, "compaction"), _TENANTS, index=False)
    for k in range(4):
        store.write_traces(_envelopes(spark, sf_dir, f"pmod(ingest_seq, 4) = {k}"), ingest_date="2024-02-01")
    compact(store, "traces")
    return store.table("traces").select(F.col("tenant_id"), "service", "time_unix_nano", "span_id")


def store_delete(spark, sf_dir):
    """Rows of a store after a delete of stored data and an expired day."""
    store = Store(spark, _scratch(spark, "delete"), _TENANTS, index=False)
    for day in ("2024-02-01", "2024-02-09"):
        store.write_traces(_envelopes(spark, sf_dir, f"pmod(ingest_seq, 2) = {int(day[-1]) % 2}" if day == "2024-02-01" else "pmod(ingest_seq, 2) = 0"), ingest_date=day)
    store.delete_traces(TraceRequest("svc-5", "svc-5", T0 + 5 * DAY, T0 + 15 * DAY))
    expire(store, date(2024, 2, 12))
    return store.table("traces").select("tenant_id", "service", "time_unix_nano", "span_id")


def _stored(spark, sf_dir, name: str, signal: str, resolver: Resolver = CONFIG_DEFAULT, index: bool = False) -> Store:
    """A store with the signal's envelopes, written in two parts on two days."""
    store = Store(spark, _scratch(spark, name), resolver, index=index)
    scopes = SIGNALS[signal][0]
    for k in (0, 1):
        store.write(signal, _signal(spark, sf_dir, signal).where(f"pmod(ingest_seq, 2) = {k}").select("resource", scopes), ingest_date=f"2024-02-0{k + 1}")
    return store


def store_read_traces(spark, sf_dir):
    return _stored(spark, sf_dir, "read", "traces", _TENANTS).read(TraceRequest("svc-5", "svc-5", T0 + 5 * DAY, T0 + 15 * DAY)).select(*HEAD["traces"])


def store_read_logs(spark, sf_dir):
    return _stored(spark, sf_dir, "read", "logs", _TENANTS).read(LogRequest("svc-3", severity=17, start_time=T0 + DAY)).select(*HEAD["logs"])


def store_read_metrics(spark, sf_dir):
    return _stored(spark, sf_dir, "read", "metrics", _TENANTS).read(MetricRequest("svc-4", metric_name="purchase", end_time=T0 + 12 * DAY)).select(*HEAD["metrics"])


def store_trace_by_id(spark, sf_dir):
    """A trace by the index of a store."""
    store = _stored(spark, sf_dir, "lookup", "traces", _TENANTS, index=True)
    return silver.spans(store.read_trace_by_id("svc-5", TRACE)).where(F.col("trace_id") == TRACE).select("service", "trace_id", "span_id", "name")


def index_rebuild(spark, sf_dir):
    """Days of each trace, from an index made of stored traces."""
    store = _stored(spark, sf_dir, "index", "traces", _TENANTS)
    store.rebuild_index()
    return store.trace_index().select("tenant_id", "trace_id", F.date_format("ingest_date", "yyyy-MM-dd").alias("day"))


def store_delete_logs(spark, sf_dir):
    store = _stored(spark, sf_dir, "delete", "logs", _TENANTS)
    store.delete_logs(LogRequest("svc-3", severity=17))
    return store.table("logs").select(*HEAD["logs"])


def store_delete_metrics(spark, sf_dir):
    store = _stored(spark, sf_dir, "delete", "metrics", _TENANTS)
    store.delete_metrics(MetricRequest("svc-4", metric_name="purchase"))
    return store.table("metrics").select(*HEAD["metrics"])


def store_tombstones(spark, sf_dir):
    """Logs of a tenant that stored tombstones do not hide."""
    store = _stored(spark, sf_dir, "tombstones", "logs", _TENANTS)
    store.bury("logs", store.read(LogRequest("svc-3", severity=17)))
    return store.read(LogRequest("svc-3")).select(*HEAD["logs"])


def concurrent_compaction(spark, sf_dir):
    """Rows of a store of which a part was appended by another one between the read and the commit of a compaction."""
    store = Store(spark, _scratch(spark, "concurrent"), _TENANTS, index=False)
    for k in range(2):
        store.write_traces(_envelopes(spark, sf_dir, f"pmod(ingest_seq, 3) = {k}"), ingest_date="2024-02-01")
    other = Store(spark, store.root, _TENANTS, index=False)
    compact(store, "traces", before_commit=lambda: other.write_traces(_envelopes(spark, sf_dir, "pmod(ingest_seq, 3) = 2"), ingest_date="2024-02-01"))
    return store.table("traces").select("tenant_id", "service", "time_unix_nano", "span_id")


def store_time_travel(spark, sf_dir):
    """A store as it was before a delete."""
    store = _stored(spark, sf_dir, "travel", "logs", _TENANTS)
    version = store.version("logs") - 1
    store.delete_logs(LogRequest("svc-3"))
    return store.read(LogRequest("svc-3"), as_of=version).select(*HEAD["logs"])


def otlp_binary_roundtrip(spark, sf_dir):
    """Traces as protobuf payloads of framed logs, read again and stored."""
    folder = _scratch(spark, "binary")
    otlp_json.write_traces(_envelopes(spark, sf_dir), f"{folder}/lines")
    logs = framed_log.framed(otlp_binary.payloads(spark.read.text(f"{folder}/lines"), "traces"))
    payloads = framed_log.records_of(logs).where("error is null")
    store = Store(spark, f"{folder}/store", _TENANTS, index=False)
    store.write_traces(otlp_json.envelopes(otlp_binary.lines(payloads, "traces", strict=True), "traces"), ingest_date="2024-02-01")
    return store.table("traces").select("tenant_id", "service", "time_unix_nano", "span_id")


def histogram_roundtrip(spark, sf_dir):
    """Histograms of values, one an event, as request lines, protobuf payloads and stored points; buckets summed by service."""
    e, scratch = adapters.events(spark, sf_dir), _scratch(spark, "histogram")
    time, value = F.col("time_unix_nano").cast("string"), F.col("value")
    bounds = F.array(F.lit(10.0), F.lit(50.0))
    counts = F.array(*(c.cast("int").cast("string") for c in (value <= 10, (value > 10) & (value <= 50), value > 50)))
    point = F.struct(time.alias("timeUnixNano"), F.lit("1").alias("count"), F.round(value * 100).alias("sum"), counts.alias("bucketCounts"), bounds.alias("explicitBounds"))
    data = F.struct(F.array(point).alias("dataPoints"), F.lit(2).alias("aggregationTemporality"))
    metric = F.struct(F.lit("sizes").alias("name"), data.alias("histogram"))
    name = F.struct(F.lit("service.name").alias("key"), F.struct(F.col("service").alias("stringValue")).alias("value"))
    one = F.struct(F.struct(F.array(name).alias("attributes")).alias("resource"), F.array(F.struct(F.array(metric).alias("metrics"))).alias("scopeMetrics"))
    lines = e.select(F.to_json(F.struct(F.array(one).alias("resourceMetrics"))).alias("value"))
    store = Store(spark, scratch, _TENANTS, index=False)
    store.write_metrics(otlp_json.envelopes(otlp_binary.lines(otlp_binary.payloads(lines, "metrics"), "metrics", strict=True), "metrics"), ingest_date="2024-02-01")
    p = silver.points(store.table("metrics"))
    total = lambda c, n: F.sum(c).cast("bigint").alias(n)
    return p.groupBy("tenant_id", "metric_type").agg(total("count", "points"), *(total(F.get("bucket_counts", F.lit(i)), f"bucket_{i}") for i in range(3)), total(F.size("explicit_bounds"), "bounds"), F.sum("value").alias("total"))


def http_counts(spark, sf_dir):
    """What the HTTP routes answer for a tenant of a store."""
    store = _stored(spark, sf_dir, "http", "traces", _TENANTS)
    urls = ("/v1/traces?tenant=svc-5", "/v1/traces?tenant=svc-5&service=svc-5", "/v1/traces?tenant=svc-5&service=svc-6", f"/v1/traces/{TRACE}?tenant=svc-5", "/v1/logs?tenant=svc-5", "/v1/metrics?tenant=svc-5")
    return spark.createDataFrame([(u, answer(store, u)[1]["count"]) for u in urls], "url string, n bigint")


def trace_tree_sql(spark, sf_dir):
    """A trace's tree by the SQL table function over a store."""
    store = Store(spark, _scratch(spark, "tree"), _TENANTS, index=False)
    e = adapters.with_parent(adapters.events(spark, sf_dir))
    store.write_traces(adapters.traces(e).select("resource", "scope_spans"), ingest_date="2024-02-01")
    sql.register(store)
    return spark.sql(f"SELECT span_id, parent_span_id, service, name, CAST(depth AS BIGINT) AS depth FROM trace_tree('svc-5', '{TRACE}')")


def stream_ingest_roundtrip(spark, sf_dir):
    """Envelopes written as request lines, streamed into a store, and read again."""
    folder = _scratch(spark, "stream")
    otlp_json.write_traces(_envelopes(spark, sf_dir), f"{folder}/landing")
    store = Store(spark, f"{folder}/store", CONFIG_DEFAULT, index=False)
    start(store, "traces", f"{folder}/landing", f"{folder}/checkpoint", once=True).awaitTermination()
    return store.table("traces").select(*HEAD["traces"])


def _spans(spark, sf_dir, parents: bool = False):
    e = adapters.events(spark, sf_dir)
    return silver.spans(adapters.traces(adapters.with_parent(e) if parents else e))


def trace_log_correlation(spark, sf_dir):
    logs = silver.log_records(_signal(spark, sf_dir, "logs")).where("severity_number = 17")
    return analytics.correlate(_spans(spark, sf_dir), logs).select("tenant_id", "trace_id", "span_id", "log_span_id", "span_name", "severity_number")


def service_graph(spark, sf_dir):
    return analytics.service_graph(_spans(spark, sf_dir, parents=True))


def span_tree(spark, sf_dir):
    return analytics.span_tree(_spans(spark, sf_dir, parents=True))


def _cents(spark, sf_dir):
    """Points with whole numbers as values, whose sums have no rounding."""
    return silver.points(_signal(spark, sf_dir, "metrics")).withColumn("value", F.round(F.col("value") * 100))


def metric_downsample(spark, sf_dir):
    return analytics.downsample(_cents(spark, sf_dir), "6 hours").select("tenant_id", "service", "metric_name", F.unix_micros("window_start").alias("window_us"), "points", "min_value", "max_value", "sum_value", "avg_value")


def metric_agg_by_attr(spark, sf_dir):
    by = F.coalesce(attribute("resource.attributes", "k8s.namespace.name"), F.lit("-"))
    return analytics.aggregate(_cents(spark, sf_dir), by, "namespace", T0 + DAY, T0 + 21 * DAY)


def exemplar_link(spark, sf_dir):
    return analytics.exemplars(silver.points(_signal(spark, sf_dir, "metrics")), _spans(spark, sf_dir)).select("tenant_id", "metric_name", "trace_id", "span_id", "span_service", "exemplar_value")


def acl_filter(spark, sf_dir):
    return acl.restrict(_signal(spark, sf_dir, "traces"), POLICY, PRINCIPAL, "traces").select(*HEAD["traces"])


def tail_sample(spark, sf_dir):
    return analytics.tail_sample(_spans(spark, sf_dir), slow_nanos=12 * 3600 * NANOS).select("tenant_id", "trace_id", "span_id", "name")


def log_search(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.struct(F.col("text").alias("string_value")).alias("body"))
    return analytics.search(docs, contains="License", pattern="(MIT|Apache) License").select("doc_id")


def resource_dimension(spark, sf_dir):
    dim, facts = analytics.resources(_signal(spark, sf_dir, "logs").select("tenant_id", "log_id", "resource"))
    return facts.join(dim, "resource_id").groupBy(attribute("resource.attributes", "service.name").alias("service")).agg(F.countDistinct("resource_id").alias("resources"), F.count(F.lit(1)).alias("envelopes"))


def queries() -> dict:
    out = {n: _read(r) for n, (r, _) in READS.items()}
    out |= {"tenant_resolve_fallback": _resolve(Resolver("attribute_based", (), "fallback")), "tenant_resolve_static": _resolve(Resolver("static", (), "solo")), "tenant_resolve_config": _resolve(CONFIG_DEFAULT)}
    out |= {f"sort_key_{s}": _keys(s) for s in HEAD}
    named = (trace_by_id, count_by_tenant, ordered_scan, upsert_latest, delete_by_predicate, tombstone_anti_join, ttl_retained, time_travel, compaction_invariant, store_delete, store_read_traces, store_read_logs, store_read_metrics, store_trace_by_id, index_rebuild, store_delete_logs, store_delete_metrics, store_tombstones, concurrent_compaction, store_time_travel, otlp_binary_roundtrip, histogram_roundtrip, http_counts, trace_tree_sql, stream_ingest_roundtrip, trace_log_correlation, service_graph, span_tree, metric_downsample, metric_agg_by_attr, exemplar_link, acl_filter, tail_sample, log_search, resource_dimension)
    return out | {f.__name__: f for f in named}


_RESOLVED = """CASE event_id % 5 WHEN 0 THEN 'team-' || user_id WHEN 1 THEN 'legacy-' || user_id WHEN 2 THEN 'ns-' || user_id {} ELSE '{}' END AS tenant_id FROM events"""
_TREE = SIG + """, par AS (SELECT *, lag(span_id) OVER (PARTITION BY trace_id ORDER BY time_unix_nano, event_id) AS parent_span_id,
  row_number() OVER (PARTITION BY trace_id ORDER BY time_unix_nano, event_id) AS n, first_value(span_id) OVER (PARTITION BY trace_id ORDER BY time_unix_nano, event_id) AS root FROM sig)
"""


def oracle_sql() -> dict[str, str]:
    out = {n: _sql(SIGNAL_OF[type(r)], w) for n, (r, w) in READS.items()}
    hexed = "lpad(lower(hex(time_unix_nano)), 16, '0') AS time_hex"
    out |= {f"sort_key_{s}": f"{SIG}SELECT {SQL_HEAD[s]}, {hexed} FROM sig" for s in HEAD}
    gone = f"tenant_id = 'tenant-1' AND service = 'svc-5' AND time_unix_nano >= {T0 + 5 * DAY} AND time_unix_nano < {T0 + 15 * DAY}"
    own = "SELECT service AS tenant_id, service, time_unix_nano, span_id FROM sig"
    cents = "round(value * 100)"
    # with the service as the tenant
    mine = {t: f"SELECT {h.replace('tenant_id', 'service AS tenant_id')} FROM sig" for t, h in SQL_HEAD.items()}
    late, one = f"time_unix_nano >= {T0 + DAY}", f"trace_id = '{TRACE}'"
    counts = lambda where: f"(SELECT count(*) FROM sig WHERE {where})"
    return out | {
        "store_read_traces": f"{SIG}{mine['traces']} WHERE {gone.removeprefix("tenant_id = 'tenant-1' AND ")}",
        "store_read_logs": f"{SIG}{mine['logs']} WHERE service = 'svc-3' AND severity_number = 17 AND {late}",
        "store_read_metrics": f"{SIG}{mine['metrics']} WHERE service = 'svc-4' AND event_type = 'purchase' AND time_unix_nano < {T0 + 12 * DAY}",
        "store_trace_by_id": f"{SIG}SELECT service, trace_id, span_id, event_type AS name FROM sig WHERE {one}",
        "index_rebuild": f"{SIG}SELECT DISTINCT service AS tenant_id, trace_id, CASE event_id % 2 WHEN 0 THEN '2024-02-01' ELSE '2024-02-02' END AS day FROM sig",
        "store_delete_logs": f"{SIG}{mine['logs']} WHERE NOT (service = 'svc-3' AND severity_number = 17)",
        "store_delete_metrics": f"{SIG}{mine['metrics']} WHERE NOT (service = 'svc-4' AND event_type = 'purchase')",
        "store_tombstones": f"{SIG}{mine['logs']} WHERE service = 'svc-3' AND severity_number <> 17",
        "concurrent_compaction": f"{SIG}{own}",
        "store_time_travel": f"{SIG}{mine['logs']} WHERE service = 'svc-3'",
        "otlp_binary_roundtrip": f"{SIG}{own}",
        "histogram_roundtrip": f"{SIG}SELECT service AS tenant_id, 'histogram' AS metric_type, count(*) AS points, count(*) FILTER (WHERE value <= 10) AS bucket_0, count(*) FILTER (WHERE value > 10 AND value <= 50) AS bucket_1, count(*) FILTER (WHERE value > 50) AS bucket_2, 2 * count(*) AS bounds, sum({cents}) AS total FROM sig GROUP BY service",
        "http_counts": f"""{SIG}SELECT u AS url, n FROM (VALUES ('/v1/traces?tenant=svc-5', {counts("service = 'svc-5'")}), ('/v1/traces?tenant=svc-5&service=svc-5', {counts("service = 'svc-5'")}), ('/v1/traces?tenant=svc-5&service=svc-6', 0), ('/v1/traces/{TRACE}?tenant=svc-5', {counts(one + " AND service = 'svc-5'")}), ('/v1/logs?tenant=svc-5', 0), ('/v1/metrics?tenant=svc-5', 0)) AS t(u, n)""",
        "trace_tree_sql": f"{_TREE}SELECT span_id, parent_span_id, service, event_type AS name, n - 1 AS depth FROM par WHERE {one} AND service = 'svc-5'",
        "tenant_resolve_fallback": "SELECT event_id, " + _RESOLVED.format("WHEN 3 THEN 'group-' || user_id", "fallback"),
        "tenant_resolve_static": "SELECT event_id, 'solo' AS tenant_id FROM events",
        "tenant_resolve_config": "SELECT event_id, " + _RESOLVED.format("", "default"),
        "trace_by_id": f"{SIG}SELECT tenant_id, service, trace_id, span_id, event_type AS name, time_unix_nano AS start_time_unix_nano FROM sig WHERE tenant_id = 'tenant-1' AND trace_id = '{TRACE}'",
        "count_by_tenant": f"{SIG}SELECT tenant_id, count(*) AS envelopes, signal FROM sig, (VALUES ('traces'), ('logs'), ('metrics')) AS s(signal) GROUP BY ALL",
        "ordered_scan": f"{SIG}SELECT service, time_unix_nano, span_id, row_number() OVER (PARTITION BY service ORDER BY time_unix_nano, span_id) AS position FROM sig WHERE tenant_id = 'tenant-1'",
        "upsert_latest": f"{SIG}SELECT tenant_id, service, metric_name, time_unix_nano, value, ingest_seq FROM (SELECT tenant_id, service, event_type AS metric_name, time_unix_nano - time_unix_nano % {DAY} AS time_unix_nano, value, event_id AS ingest_seq, row_number() OVER (PARTITION BY tenant_id, service, event_type, time_unix_nano // {DAY} ORDER BY event_id DESC) AS r FROM sig) WHERE r = 1",
        "delete_by_predicate": _sql("traces", f"NOT ({gone})"),
        "tombstone_anti_join": _sql("logs", "severity_number <> 17"),
        "ttl_retained": _sql("traces", "day >= DATE '2024-01-20'"),
        "time_travel": _sql("metrics", "event_id <= 2500"),
        "compaction_invariant": f"{SIG}{own}",
        "store_delete": f"{SIG}{own} WHERE event_id % 2 = 0 AND NOT (service = 'svc-5' AND time_unix_nano >= {T0 + 5 * DAY} AND time_unix_nano < {T0 + 15 * DAY})",
        "stream_ingest_roundtrip": f"{SIG}SELECT r.tenant_id, service, time_unix_nano, span_id FROM sig JOIN (SELECT event_id, {_RESOLVED.format('', 'default')}) r USING (event_id)",
        "trace_log_correlation": f"{SIG}SELECT a.tenant_id, a.trace_id, a.span_id, b.span_id AS log_span_id, a.event_type AS span_name, b.severity_number FROM sig a JOIN sig b ON a.tenant_id = b.tenant_id AND a.trace_id = b.trace_id WHERE b.severity_number = 17",
        "service_graph": f"{_TREE}SELECT c.tenant_id, p.service AS caller, c.service AS callee, count(*) AS calls, CAST(sum(CASE WHEN c.event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS errors, sum(CASE WHEN c.event_type = 'error' THEN 1 ELSE 0 END) / count(*) AS error_rate FROM par c JOIN par p ON p.tenant_id = c.tenant_id AND p.trace_id = c.trace_id AND p.span_id = c.parent_span_id GROUP BY ALL",
        "span_tree": f"{_TREE}SELECT tenant_id, trace_id, span_id, root AS root_span_id, n - 1 AS depth FROM par",
        "metric_downsample": f"{SIG}SELECT tenant_id, service, event_type AS metric_name, time_unix_nano // {DAY // 4} * {DAY // 4000} AS window_us, count(*) AS points, min({cents}) AS min_value, max({cents}) AS max_value, sum({cents}) AS sum_value, avg({cents}) AS avg_value FROM sig GROUP BY ALL",
        "metric_agg_by_attr": f"{SIG}SELECT tenant_id, event_type AS metric_name, CASE WHEN event_id % 5 = 2 THEN 'ns-' || user_id ELSE '-' END AS namespace, count(*) AS points, min({cents}) AS min_value, max({cents}) AS max_value, sum({cents}) AS sum_value FROM sig WHERE time_unix_nano >= {T0 + DAY} AND time_unix_nano < {T0 + 21 * DAY} GROUP BY ALL",
        "exemplar_link": f"{SIG}SELECT tenant_id, event_type AS metric_name, trace_id, span_id, service AS span_service, value AS exemplar_value FROM sig WHERE event_type = 'error'",
        "acl_filter": _sql("traces", "(tenant_id IN ('tenant-1', 'tenant-2') AND service = 'svc-2') OR (event_id % 5 = 3 AND user_id = 7)"),
        "tail_sample": f"{SIG}, t AS (SELECT tenant_id, trace_id FROM sig GROUP BY ALL HAVING max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) = 1 OR max(time_unix_nano) + 1000000 - min(time_unix_nano) >= {12 * 3600 * NANOS}) SELECT tenant_id, trace_id, span_id, event_type AS name FROM sig SEMI JOIN t USING (tenant_id, trace_id)",
        "log_search": "SELECT doc_id FROM documents WHERE contains(text, 'License') AND regexp_matches(text, '(MIT|Apache) License')",
        "resource_dimension": f"{SIG}SELECT service, count(DISTINCT CASE event_id % 5 WHEN 0 THEN 'a' || user_id WHEN 1 THEN 'b' || user_id WHEN 2 THEN 'c' || user_id WHEN 3 THEN 'd' || user_id ELSE '-' END) AS resources, count(*) AS envelopes FROM sig GROUP BY ALL",
    }

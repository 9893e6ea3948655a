"""Views of a store, and table functions over them, for Spark SQL.

``register(store)`` makes the views traces, logs, metrics, spans, log_records
and points, and the functions

* ``trace_tree(tenant, trace_id)``: spans of a trace with their depth and path, to any depth
  (spans on a cycle have no root and are not in it),
* ``exemplar_link(tenant, metric)``: spans that a metric's exemplars name,
* ``correlated_logs(tenant, trace_id)``: log records of a trace,
* ``resource_filter(resource, key, value)``: whether a resource has an attribute.

All are SQL functions: they are inlined into the query and optimised with it.
"""

from __future__ import annotations

from .operators import silver
from .operators.store import Store
from .schema import RESOURCE, SIGNALS

FUNCTIONS = (
    f"""CREATE OR REPLACE TEMPORARY FUNCTION resource_filter(r {RESOURCE}, k STRING, v STRING) RETURNS BOOLEAN
    RETURN coalesce(exists(r.attributes, a -> a.key = k AND a.value.string_value = v), false)""",
    """CREATE OR REPLACE TEMPORARY FUNCTION exemplar_link(tenant STRING, metric STRING)
    RETURNS TABLE (trace_id STRING, span_id STRING, service STRING, name STRING, exemplar_value DOUBLE)
    RETURN SELECT s.trace_id, s.span_id, s.service, s.name, e.exemplar_value FROM spans s JOIN
      (SELECT x.trace_id, x.span_id, x.value_double AS exemplar_value FROM points LATERAL VIEW explode(exemplars) t AS x WHERE tenant_id = tenant AND metric_name = metric) e
      ON s.tenant_id = tenant AND s.trace_id = e.trace_id AND s.span_id = e.span_id""",
    """CREATE OR REPLACE TEMPORARY FUNCTION correlated_logs(tenant STRING, id STRING)
    RETURNS TABLE (service STRING, severity_number INT, body STRING, span_id STRING, event_time_unix_nano BIGINT)
    RETURN SELECT service, severity_number, body.string_value, span_id, event_time_unix_nano FROM log_records WHERE tenant_id = tenant AND trace_id = lower(id)""",
    """CREATE OR REPLACE TEMPORARY FUNCTION trace_tree(tenant STRING, id STRING)
    RETURNS TABLE (span_id STRING, parent_span_id STRING, service STRING, name STRING, depth INT, path STRING)
    RETURN WITH RECURSIVE own AS (SELECT span_id, nullif(parent_span_id, '') AS parent_span_id, service, name FROM spans WHERE tenant_id = tenant AND trace_id = lower(id)),
      tree MAX RECURSION LEVEL 1000000 AS (SELECT span_id, parent_span_id, service, name, 0 AS depth, span_id AS path FROM own WHERE parent_span_id IS NULL OR parent_span_id NOT IN (SELECT span_id FROM own WHERE span_id IS NOT NULL)
        UNION ALL SELECT o.span_id, o.parent_span_id, o.service, o.name, t.depth + 1, concat(t.path, '/', o.span_id) FROM own o JOIN tree t ON o.parent_span_id = t.span_id WHERE instr(concat('/', t.path, '/'), concat('/', o.span_id, '/')) = 0)
      SELECT span_id, parent_span_id, service, name, depth, path FROM tree""",
)


def register(store: Store) -> None:
    """Views of the store as it is now; call again after writes that should be seen."""
    for signal in SIGNALS:
        store.table(signal).createOrReplaceTempView(signal)
    silver.spans(store.table("traces")).createOrReplaceTempView("spans")
    silver.log_records(store.table("logs")).createOrReplaceTempView("log_records")
    silver.points(store.table("metrics")).createOrReplaceTempView("points")
    for f in FUNCTIONS:
        store.spark.sql(f)

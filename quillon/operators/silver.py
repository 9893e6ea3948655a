"""One row per span, log record or data point, from envelopes.

Head columns of the envelope (tenant, service) stay beside those of the
element; columns that a query does not use are pruned from the nested scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def spans(traces: DataFrame) -> DataFrame:
    rows = traces.select("tenant_id", "service", "resource", "ingest_seq", F.explode("scope_spans").alias("s")).select("tenant_id", "service", "resource", "ingest_seq", F.col("s.scope.name").alias("scope_name"), F.explode("s.spans").alias("x"))
    return rows.select("tenant_id", "service", "resource", "ingest_seq", "scope_name", "x.*")


def log_records(logs: DataFrame) -> DataFrame:
    rows = logs.select("tenant_id", "service", "resource", "ingest_seq", F.explode("scope_logs").alias("s")).select("tenant_id", "service", "resource", "ingest_seq", F.col("s.scope.name").alias("scope_name"), F.explode("s.log_records").alias("x"))
    rows = rows.select("tenant_id", "service", "resource", "ingest_seq", "scope_name", "x.*")
    return rows.withColumn("event_time_unix_nano", F.coalesce(F.nullif("observed_time_unix_nano", F.lit(0)), "time_unix_nano", F.lit(0)))


def points(metrics: DataFrame) -> DataFrame:
    rows = metrics.select("tenant_id", "service", "resource", "ingest_seq", F.explode("scope_metrics").alias("s")).select("tenant_id", "service", "resource", "ingest_seq", F.explode("s.metrics").alias("m"))
    rows = rows.select("tenant_id", "service", "resource", "ingest_seq", F.col("m.name").alias("metric_name"), F.col("m.unit").alias("unit"), F.col("m.type").alias("metric_type"), F.explode("m.points").alias("x"))
    return rows.select("tenant_id", "service", "resource", "ingest_seq", "metric_name", "unit", "metric_type", "x.*").withColumn("value", F.coalesce("value_double", F.col("value_int").cast("double")))

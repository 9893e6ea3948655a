"""Windowed and sampled streams over spans and points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.attributes import to_timestamp


def error_rates(spans: DataFrame, width: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Calls and errors of each service in windows of event time; rows later than ``late`` are left out."""
    rows = spans.withColumn("ts", to_timestamp(F.col("start_time_unix_nano"))).withWatermark("ts", late)
    return rows.groupBy(F.window("ts", width).alias("w"), "tenant_id", "service").agg(F.count(F.lit(1)).alias("calls"), F.sum((F.coalesce("status.code", F.lit(0)) == 2).cast("bigint")).alias("errors")).select(F.col("w.start").alias("window_start"), "tenant_id", "service", "calls", "errors")


def sampled_traces(spans: DataFrame, quiet: str = "30 seconds", late: str = "1 minute", slow_nanos: int = 0) -> DataFrame:
    """Traces that are complete (quiet for a while) and have an error or are slow: tail-based sampling."""
    rows = spans.withColumn("ts", to_timestamp(F.col("start_time_unix_nano"))).withWatermark("ts", late)
    whole = rows.groupBy(F.session_window("ts", quiet).alias("w"), "tenant_id", "trace_id").agg(F.count(F.lit(1)).alias("spans"), F.max((F.coalesce("status.code", F.lit(0)) == 2).cast("int")).alias("error"), (F.max("end_time_unix_nano") - F.min("start_time_unix_nano")).alias("duration_nano"))
    wanted = (F.col("error") == 1) | (F.lit(slow_nanos > 0) & (F.col("duration_nano") >= slow_nanos))
    return whole.where(wanted).select("tenant_id", "trace_id", "spans", "error", "duration_nano", F.col("w.start").alias("first_seen"))

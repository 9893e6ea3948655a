"""The driver's ``events`` table as signals: one envelope per event."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.attributes import fixed_hex
from ..schema import ATTRIBUTES, EXEMPLAR, VALUE


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, user_id, event_type, value and the signal columns."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    day = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).cast("bigint")
    return e.select(
        "event_id", "user_id", "event_type", "value",
        F.concat(F.lit("tenant-"), (F.col("user_id") % 4).cast("string")).alias("tenant_id"),
        F.concat(F.lit("svc-"), (F.col("user_id") % 10).cast("string")).alias("service"),
        (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("time_unix_nano"),
        F.concat(fixed_hex(F.col("user_id")), fixed_hex(day)).alias("trace_id"),
        fixed_hex(F.col("event_id")).alias("span_id"),
        F.when(F.col("event_type") == "error", 17).when(F.col("event_type") == "purchase", 13).otherwise(9).alias("severity_number"),
        F.when(F.col("event_type").isin("click", "view"), "gauge").otherwise("sum").alias("metric_type"),
        F.to_date("ts").alias("day"),
    )


def with_parent(e: DataFrame) -> DataFrame:
    """parent_span_id: the event before it in its trace."""
    w = Window.partitionBy("trace_id").orderBy("time_unix_nano", "event_id")
    return e.withColumn("parent_span_id", F.lag("span_id").over(w))


def _text(key: str, value) -> "F.Column":
    null = lambda t: F.lit(None).cast(t)
    return F.struct(F.lit(key).alias("key"), F.struct(value.alias("string_value"), null("boolean").alias("bool_value"), null("bigint").alias("int_value"), null("double").alias("double_value"), null("binary").alias("bytes_value"), null("string").alias("json_value")).alias("value"))


def _number(key: str, value) -> "F.Column":
    null = lambda t: F.lit(None).cast(t)
    return F.struct(F.lit(key).alias("key"), F.struct(null("string").alias("string_value"), null("boolean").alias("bool_value"), value.cast("bigint").alias("int_value"), null("double").alias("double_value"), null("binary").alias("bytes_value"), null("string").alias("json_value")).alias("value"))


def resource() -> "F.Column":
    """service.name and, by event, what takes a tenant resolver to each of its steps."""
    kind, user = F.col("event_id") % 5, F.col("user_id")
    name = lambda p: F.concat(F.lit(p), user.cast("string"))
    more = (
        F.when(kind == 0, F.array(_text("tenant.id", name("team-"))))
        .when(kind == 1, F.array(_number("tenant.id", user), _text("tenant_id", name("legacy-"))))
        .when(kind == 2, F.array(_text("tenant.id", F.lit("")), _text("k8s.namespace.name", name("ns-"))))
        .when(kind == 3, F.array(_text("service.namespace", name("group-"))))
        .otherwise(F.array().cast(ATTRIBUTES))
    )
    return F.struct(F.concat(F.array(_text("service.name", F.col("service"))), more).alias("attributes"))


def _scope() -> "F.Column":
    return F.struct(F.lit("events").alias("name"), F.lit("1").alias("version"))


def traces(e: DataFrame) -> DataFrame:
    """Trace envelopes with head columns; e has parent_span_id or gets none."""
    parent = F.col("parent_span_id") if "parent_span_id" in e.columns else F.lit(None).cast("string")
    span = F.struct("trace_id", "span_id", parent.alias("parent_span_id"), F.col("event_type").alias("name"), F.lit(1).alias("kind"), F.col("time_unix_nano").alias("start_time_unix_nano"), (F.col("time_unix_nano") + 1_000_000).alias("end_time_unix_nano"), F.array(_text("event.type", F.col("event_type"))).alias("attributes"), F.struct(F.when(F.col("event_type") == "error", 2).otherwise(0).alias("code"), F.lit(None).cast("string").alias("message")).alias("status"))
    scopes = F.array(F.struct(_scope().alias("scope"), F.array(span).alias("spans")))
    return e.select("tenant_id", "service", "time_unix_nano", "span_id", resource().alias("resource"), scopes.alias("scope_spans"), F.col("event_id").alias("ingest_seq"), F.lit(0).cast("bigint").alias("ingest_row"), F.col("day").alias("ingest_date"))


def logs(e: DataFrame) -> DataFrame:
    body = F.struct(F.col("event_type").alias("string_value"), *(F.lit(None).cast(t).alias(n) for n, t in (("bool_value", "boolean"), ("int_value", "bigint"), ("double_value", "double"), ("bytes_value", "binary"), ("json_value", "string"))))
    record = F.struct(F.lit(0).cast("bigint").alias("time_unix_nano"), F.col("time_unix_nano").alias("observed_time_unix_nano"), "severity_number", F.lit(None).cast("string").alias("severity_text"), body.cast(VALUE).alias("body"), "trace_id", "span_id", F.array().cast(ATTRIBUTES).alias("attributes"))
    scopes = F.array(F.struct(_scope().alias("scope"), F.array(record).alias("log_records")))
    return e.select("tenant_id", "service", "time_unix_nano", "trace_id", F.concat_ws("_", F.col("severity_number").cast("string"), "span_id").alias("log_id"), resource().alias("resource"), scopes.alias("scope_logs"), F.col("event_id").alias("ingest_seq"), F.lit(0).cast("bigint").alias("ingest_row"), F.col("day").alias("ingest_date"))


def metrics(e: DataFrame) -> DataFrame:
    exemplar = F.struct(F.col("time_unix_nano"), F.col("value").alias("value_double"), "trace_id", "span_id", F.lit(None).cast("bigint").alias("value_int"), F.array().cast(ATTRIBUTES).alias("filtered_attributes"))
    exemplars = F.when(F.col("event_type") == "error", F.array(exemplar)).otherwise(F.array().cast(f"array<{EXEMPLAR}>"))
    point = F.struct("time_unix_nano", F.col("value").alias("value_double"), F.lit(None).cast("bigint").alias("value_int"), F.array().cast(ATTRIBUTES).alias("attributes"), exemplars.alias("exemplars"))
    metric = F.struct(F.col("event_type").alias("name"), F.lit("1").alias("unit"), F.col("metric_type").alias("type"), F.array(point).alias("points"))
    scopes = F.array(F.struct(_scope().alias("scope"), F.array(metric).alias("metrics")))
    return e.select("tenant_id", "service", "time_unix_nano", F.col("event_type").alias("metric_name"), resource().alias("resource"), scopes.alias("scope_metrics"), F.col("event_id").alias("ingest_seq"), F.lit(0).cast("bigint").alias("ingest_row"), F.col("day").alias("ingest_date"))

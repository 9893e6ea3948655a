"""OTLP in its JSON form: one export request per line.

64-bit integers are texts in this form, ids hex; a value that is an array or
a map is kept as its JSON text.  Enumerations may be numbers or names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.attributes import signed
from ..schema import SIGNALS

_VALUE = "struct<stringValue:string,boolValue:boolean,intValue:string,doubleValue:string,bytesValue:string,arrayValue:string,kvlistValue:string>"
_ATTRIBUTES = f"array<struct<key:string,value:{_VALUE}>>"
_RESOURCE = f"struct<attributes:{_ATTRIBUTES},droppedAttributesCount:string>"
_SCOPE = f"struct<name:string,version:string,attributes:{_ATTRIBUTES},droppedAttributesCount:string>"
_EVENT = f"struct<timeUnixNano:string,name:string,attributes:{_ATTRIBUTES},droppedAttributesCount:string>"
_LINK = f"struct<traceId:string,spanId:string,traceState:string,attributes:{_ATTRIBUTES},droppedAttributesCount:string,flags:string>"
_SPAN = f"struct<traceId:string,spanId:string,parentSpanId:string,name:string,kind:string,startTimeUnixNano:string,endTimeUnixNano:string,attributes:{_ATTRIBUTES},status:struct<code:string,message:string>,traceState:string,flags:string,events:array<{_EVENT}>,links:array<{_LINK}>,droppedAttributesCount:string,droppedEventsCount:string,droppedLinksCount:string>"
_LOG = f"struct<timeUnixNano:string,observedTimeUnixNano:string,severityNumber:string,severityText:string,body:{_VALUE},traceId:string,spanId:string,attributes:{_ATTRIBUTES},flags:string,eventName:string,droppedAttributesCount:string>"
_EXEMPLAR = f"struct<timeUnixNano:string,asDouble:double,traceId:string,spanId:string,asInt:string,filteredAttributes:{_ATTRIBUTES}>"
_BUCKETS = "struct<offset:string,bucketCounts:array<string>>"
_POINT = f"struct<timeUnixNano:string,asDouble:double,asInt:string,sum:double,attributes:{_ATTRIBUTES},exemplars:array<{_EXEMPLAR}>,startTimeUnixNano:string,flags:string,count:string,bucketCounts:array<string>,explicitBounds:array<double>,min:double,max:double,quantileValues:array<struct<quantile:double,value:double>>,scale:string,zeroCount:string,zeroThreshold:double,positive:{_BUCKETS},negative:{_BUCKETS}>"
_DATA = f"struct<dataPoints:array<{_POINT}>,aggregationTemporality:string,isMonotonic:boolean>"
KINDS_OF_DATA = ("gauge", "sum", "histogram", "exponentialHistogram", "summary")
_METRIC = f"struct<name:string,unit:string,description:string,{','.join(f'{k}:{_DATA}' for k in KINDS_OF_DATA)}>"
_SHAPE = {
    "traces": ("resourceSpans", f"array<struct<resource:{_RESOURCE},scopeSpans:array<struct<scope:{_SCOPE},spans:array<{_SPAN}>,schemaUrl:string>>,schemaUrl:string>>"),
    "logs": ("resourceLogs", f"array<struct<resource:{_RESOURCE},scopeLogs:array<struct<scope:{_SCOPE},logRecords:array<{_LOG}>,schemaUrl:string>>,schemaUrl:string>>"),
    "metrics": ("resourceMetrics", f"array<struct<resource:{_RESOURCE},scopeMetrics:array<struct<scope:{_SCOPE},metrics:array<{_METRIC}>,schemaUrl:string>>,schemaUrl:string>>"),
}
LEVELS = ("TRACE", "DEBUG", "INFO", "WARN", "ERROR", "FATAL")
KINDS = ("UNSPECIFIED", "INTERNAL", "SERVER", "CLIENT", "PRODUCER", "CONSUMER")
STATUS = ("UNSET", "OK", "ERROR")
TEMPORALITY = ("UNSPECIFIED", "DELTA", "CUMULATIVE")


def _enumeration(prefix: str, names: dict[str, int]):
    table = F.create_map(*(F.lit(x) for k, v in names.items() for x in (prefix + k, v)))
    return lambda c: F.coalesce(c.try_cast("int"), F.try_element_at(table, c))


def _severities() -> dict[str, int]:
    return {name + (str(k + 1) if k else ""): 4 * i + k + 1 for i, name in enumerate(LEVELS) for k in range(4)}


def _value(v: Column) -> Column:
    return F.when(v.isNotNull(), F.struct(v["stringValue"].alias("string_value"), v["boolValue"].alias("bool_value"), v["intValue"].try_cast("bigint").alias("int_value"), v["doubleValue"].try_cast("double").alias("double_value"), F.unbase64(v["bytesValue"]).alias("bytes_value"), F.coalesce(v["arrayValue"], v["kvlistValue"]).alias("json_value")))


def _attributes(a: Column) -> Column:
    return F.transform(a, lambda x: F.struct(x["key"].alias("key"), _value(x["value"]).alias("value")))


def _dropped(x: Column, what: str = "Attributes") -> Column:
    return x[f"dropped{what}Count"].try_cast("bigint").alias(f"dropped_{what.lower()}_count")


def _ids(x: Column, *names: tuple[str, str]) -> list[Column]:
    return [F.lower(x[a]).alias(b) for a, b in names]


def _resource(r: Column) -> Column:
    return F.struct(_attributes(r["attributes"]).alias("attributes"), _dropped(r))


def _scope(s: Column) -> Column:
    return F.struct(s["name"].alias("name"), s["version"].alias("version"), _attributes(s["attributes"]).alias("attributes"), _dropped(s))


def _span(x: Column) -> Column:
    kind, code = _enumeration("SPAN_KIND_", {k: i for i, k in enumerate(KINDS)}), _enumeration("STATUS_CODE_", {k: i for i, k in enumerate(STATUS)})
    event = lambda e: F.struct(signed(e["timeUnixNano"]).alias("time_unix_nano"), e["name"].alias("name"), _attributes(e["attributes"]).alias("attributes"), _dropped(e))
    link = lambda e: F.struct(*_ids(e, ("traceId", "trace_id"), ("spanId", "span_id")), e["traceState"].alias("trace_state"), _attributes(e["attributes"]).alias("attributes"), _dropped(e), e["flags"].try_cast("bigint").alias("flags"))
    head = (*_ids(x, ("traceId", "trace_id"), ("spanId", "span_id"), ("parentSpanId", "parent_span_id")), x["name"].alias("name"), kind(x["kind"]).alias("kind"), signed(x["startTimeUnixNano"]).alias("start_time_unix_nano"), signed(x["endTimeUnixNano"]).alias("end_time_unix_nano"))
    more = (x["traceState"].alias("trace_state"), x["flags"].try_cast("bigint").alias("flags"), F.transform(x["events"], event).alias("events"), F.transform(x["links"], link).alias("links"), _dropped(x), _dropped(x, "Events"), _dropped(x, "Links"))
    return F.struct(*head, _attributes(x["attributes"]).alias("attributes"), F.struct(code(x["status"]["code"]).alias("code"), x["status"]["message"].alias("message")).alias("status"), *more)


def _log(x: Column) -> Column:
    severity = _enumeration("SEVERITY_NUMBER_", _severities())
    head = (signed(x["timeUnixNano"]).alias("time_unix_nano"), signed(x["observedTimeUnixNano"]).alias("observed_time_unix_nano"), severity(x["severityNumber"]).alias("severity_number"), x["severityText"].alias("severity_text"), _value(x["body"]).alias("body"))
    return F.struct(*head, *_ids(x, ("traceId", "trace_id"), ("spanId", "span_id")), _attributes(x["attributes"]).alias("attributes"), x["flags"].try_cast("bigint").alias("flags"), x["eventName"].alias("event_name"), _dropped(x))


def _point(p: Column) -> Column:
    whole = lambda c, n: p[c].try_cast("bigint").alias(n)
    counts = lambda a: F.transform(a, lambda c: c.try_cast("bigint"))
    buckets = lambda c: F.when(p[c].isNotNull(), F.struct(p[c]["offset"].try_cast("int").alias("offset"), counts(p[c]["bucketCounts"]).alias("bucket_counts"))).alias(c)
    exemplar = lambda e: F.struct(signed(e["timeUnixNano"]).alias("time_unix_nano"), e["asDouble"].alias("value_double"), *_ids(e, ("traceId", "trace_id"), ("spanId", "span_id")), e["asInt"].try_cast("bigint").alias("value_int"), _attributes(e["filteredAttributes"]).alias("filtered_attributes"))
    head = (signed(p["timeUnixNano"]).alias("time_unix_nano"), F.coalesce(p["asDouble"], p["sum"]).alias("value_double"), whole("asInt", "value_int"), _attributes(p["attributes"]).alias("attributes"), F.transform(p["exemplars"], exemplar).alias("exemplars"))
    plain = (signed(p["startTimeUnixNano"]).alias("start_time_unix_nano"), whole("flags", "flags"), whole("count", "count"), counts(p["bucketCounts"]).alias("bucket_counts"), p["explicitBounds"].alias("explicit_bounds"), p["min"].alias("min"), p["max"].alias("max"), p["quantileValues"].alias("quantiles"))
    return F.struct(*head, *plain, p["scale"].try_cast("int").alias("scale"), whole("zeroCount", "zero_count"), p["zeroThreshold"].alias("zero_threshold"), buckets("positive"), buckets("negative"))


def _metric(x: Column) -> Column:
    first = lambda field: F.coalesce(*(x[k][field] for k in KINDS_OF_DATA))
    # an exponential histogram has all its fields, but no type in requests and keys
    kind = F.coalesce(*(F.when(x[k].isNotNull(), F.lit("" if k == "exponentialHistogram" else k)) for k in KINDS_OF_DATA), F.lit(""))
    temporality = _enumeration("AGGREGATION_TEMPORALITY_", {k: i for i, k in enumerate(TEMPORALITY)})
    return F.struct(x["name"].alias("name"), x["unit"].alias("unit"), kind.alias("type"), F.transform(first("dataPoints"), _point).alias("points"), x["description"].alias("description"), temporality(first("aggregationTemporality")).alias("temporality"), first("isMonotonic").alias("monotonic"))


_ELEMENT = {"traces": ("scopeSpans", "spans", _span), "logs": ("scopeLogs", "logRecords", _log), "metrics": ("scopeMetrics", "metrics", _metric)}


def envelopes(lines: DataFrame, signal: str, value: str = "value") -> DataFrame:
    """One row per resource of the requests in a text column; lines that are no request give none."""
    top, shape = _SHAPE[signal]
    scopes, inner, element = _ELEMENT[signal]
    column, elements, _ = SIGNALS[signal]
    request = F.from_json(F.col(value), T.StructType.fromDDL(f"{top} {shape}"), {"mode": "PERMISSIVE"})
    rows = lines.select(request.alias("r")).select(F.explode(f"r.{top}").alias("e"))
    scope = lambda s: F.struct(_scope(s["scope"]).alias("scope"), F.transform(s[inner], element).alias(elements), s["schemaUrl"].alias("schema_url"))
    return rows.select(_resource(F.col("e.resource")).alias("resource"), F.transform(F.col(f"e.{scopes}"), scope).alias(column), F.col("e.schemaUrl").alias("schema_url"))


def malformed(lines: DataFrame, signal: str, value: str = "value") -> DataFrame:
    """Lines that ``envelopes`` finds no request in."""
    top, shape = _SHAPE[signal]
    request = F.from_json(F.col(value), T.StructType.fromDDL(f"{top} {shape}"), {"mode": "PERMISSIVE"})
    return lines.where(F.col(value).isNull() | (F.trim(value) != "")).where(request.isNull() | request[top].isNull())


def read(spark: SparkSession, path: str, signal: str, strict: bool = False) -> DataFrame:
    """Envelopes of a folder of lines.  With ``strict`` a malformed line is an error, else it is skipped."""
    lines = spark.read.text(path)
    if strict and (bad := malformed(lines, signal).first()) is not None:
        raise ValueError(f"malformed line in {path}: {str(bad.value)[:200]}")
    return envelopes(lines, signal)


def stream(spark: SparkSession, path: str, signal: str, files: int = 1000) -> DataFrame:
    """The same as a stream of files that land in the folder."""
    return envelopes(spark.readStream.option("maxFilesPerTrigger", files).text(path), signal)


def _out_value(v: Column) -> Column:
    return F.struct(v["string_value"].alias("stringValue"), v["bool_value"].alias("boolValue"), v["int_value"].cast("string").alias("intValue"), v["double_value"].alias("doubleValue"), F.base64(v["bytes_value"]).alias("bytesValue"))


def write_traces(df: DataFrame, path: str) -> None:
    """Trace envelopes as lines of requests (a fixture generator and an export)."""
    attrs = lambda a: F.transform(a, lambda x: F.struct(x["key"].alias("key"), _out_value(x["value"]).alias("value")))
    span = lambda x: F.struct(x["trace_id"].alias("traceId"), x["span_id"].alias("spanId"), x["parent_span_id"].alias("parentSpanId"), x["name"].alias("name"), x["kind"].alias("kind"), x["start_time_unix_nano"].cast("string").alias("startTimeUnixNano"), x["end_time_unix_nano"].cast("string").alias("endTimeUnixNano"), attrs(x["attributes"]).alias("attributes"), x["status"].alias("status"))
    scope = lambda s: F.struct(s["scope"].alias("scope"), F.transform(s["spans"], span).alias("spans"))
    one = F.struct(F.struct(attrs(F.col("resource.attributes")).alias("attributes")).alias("resource"), F.transform("scope_spans", scope).alias("scopeSpans"))
    df.select(F.to_json(F.struct(F.array(one).alias("resourceSpans"))).alias("value")).write.mode("append").text(path)

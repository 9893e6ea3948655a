"""Row types.  A stored row is an envelope: one resource and its scopes."""

from __future__ import annotations

from pyspark.sql import types as T

VALUE = "struct<string_value:string,bool_value:boolean,int_value:bigint,double_value:double,bytes_value:binary,json_value:string>"
ATTRIBUTES = f"array<struct<key:string,value:{VALUE}>>"
RESOURCE = f"struct<attributes:{ATTRIBUTES},dropped_attributes_count:bigint>"
SCOPE = f"struct<name:string,version:string,attributes:{ATTRIBUTES},dropped_attributes_count:bigint>"
EVENT = f"struct<time_unix_nano:bigint,name:string,attributes:{ATTRIBUTES},dropped_attributes_count:bigint>"
LINK = f"struct<trace_id:string,span_id:string,trace_state:string,attributes:{ATTRIBUTES},dropped_attributes_count:bigint,flags:bigint>"
SPAN = f"struct<trace_id:string,span_id:string,parent_span_id:string,name:string,kind:int,start_time_unix_nano:bigint,end_time_unix_nano:bigint,attributes:{ATTRIBUTES},status:struct<code:int,message:string>,trace_state:string,flags:bigint,events:array<{EVENT}>,links:array<{LINK}>,dropped_attributes_count:bigint,dropped_events_count:bigint,dropped_links_count:bigint>"
LOG = f"struct<time_unix_nano:bigint,observed_time_unix_nano:bigint,severity_number:int,severity_text:string,body:{VALUE},trace_id:string,span_id:string,attributes:{ATTRIBUTES},flags:bigint,event_name:string,dropped_attributes_count:bigint>"
EXEMPLAR = f"struct<time_unix_nano:bigint,value_double:double,trace_id:string,span_id:string,value_int:bigint,filtered_attributes:{ATTRIBUTES}>"
BUCKETS = "struct<offset:int,bucket_counts:array<bigint>>"
#: A point of any kind: numbers have a value; histograms and summaries their sum as the value, and count, buckets or quantiles.
POINT = f"struct<time_unix_nano:bigint,value_double:double,value_int:bigint,attributes:{ATTRIBUTES},exemplars:array<{EXEMPLAR}>,start_time_unix_nano:bigint,flags:bigint,count:bigint,bucket_counts:array<bigint>,explicit_bounds:array<double>,min:double,max:double,quantiles:array<struct<quantile:double,value:double>>,scale:int,zero_count:bigint,zero_threshold:double,positive:{BUCKETS},negative:{BUCKETS}>"
METRIC = f"struct<name:string,unit:string,type:string,points:array<{POINT}>,description:string,temporality:int,monotonic:boolean>"

#: The scopes of each signal: column, elements, and what an element is.
SIGNALS = {"traces": ("scope_spans", "spans", SPAN), "logs": ("scope_logs", "log_records", LOG), "metrics": ("scope_metrics", "metrics", METRIC)}
#: Head columns, beside service and time_unix_nano, that make up a row's key.
KEYS = {"traces": ("span_id",), "logs": ("trace_id", "log_id"), "metrics": ("metric_name",)}
STORED = "ingest_seq bigint, ingest_row bigint, tenant_id string, ingest_date date"


def envelope(signal: str) -> T.StructType:
    """resource and scopes, as a source gives them."""
    column, elements, element = SIGNALS[signal]
    return T.StructType.fromDDL(f"resource {RESOURCE}, {column} array<struct<scope:{SCOPE},{elements}:array<{element}>,schema_url:string>>, schema_url string")


def stored(signal: str) -> T.StructType:
    """A stored row: head columns, the envelope, and where it came in."""
    head = ", ".join(f"{c} string" for c in KEYS[signal])
    return T.StructType([*T.StructType.fromDDL(f"service string, time_unix_nano bigint, {head}").fields, *envelope(signal).fields, *T.StructType.fromDDL(STORED).fields])

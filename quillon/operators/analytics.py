"""Analytics across spans, logs and metric points.

Inputs are rows of ``operators.silver``.  Joins are on (tenant, trace), which
a cluster spreads well; where one side is much smaller, adaptive execution
finds that out at run time, so nothing is broadcast by assumption here.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.attributes import attribute, has_attribute, to_timestamp
from ..session import cut


def correlate(spans: DataFrame, logs: DataFrame) -> DataFrame:
    """Every log record with every span of its trace: tenant, trace, span and log columns."""
    s = spans.select("tenant_id", "trace_id", "span_id", F.col("service").alias("span_service"), F.col("name").alias("span_name"), "start_time_unix_nano")
    g = logs.where(F.col("trace_id").isNotNull() & (F.col("trace_id") != "")).select("tenant_id", "trace_id", F.col("span_id").alias("log_span_id"), "severity_number", F.col("body.string_value").alias("body"), "event_time_unix_nano")
    return s.join(g, ["tenant_id", "trace_id"])


def service_graph(spans: DataFrame) -> DataFrame:
    """tenant_id, caller, callee, calls, errors, error_rate over spans and their parents."""
    child = spans.where(F.col("parent_span_id").isNotNull() & (F.col("parent_span_id") != "")).select("tenant_id", "trace_id", F.col("parent_span_id").alias("span_id"), F.col("service").alias("callee"), (F.coalesce("status.code", F.lit(0)) == 2).cast("bigint").alias("error"))
    parent = spans.select("tenant_id", "trace_id", "span_id", F.col("service").alias("caller"))
    edges = child.join(parent, ["tenant_id", "trace_id", "span_id"]).groupBy("tenant_id", "caller", "callee")
    return edges.agg(F.count(F.lit(1)).alias("calls"), F.sum("error").alias("errors")).withColumn("error_rate", F.col("errors") / F.col("calls"))


#: Spans of a trace up to which one task orders it alone.
SMALL_TRACE = 100_000


def span_tree(spans: DataFrame, small: int = SMALL_TRACE) -> DataFrame:
    """tenant_id, trace_id, span_id, root_span_id, depth (0 at roots) of every span.

    A span whose parent is missing is a root; spans on a cycle get a null root
    and depth.  Of repeated span ids one row counts.  Traces of up to
    ``small`` spans are ordered by a task each, after one shuffle; of larger
    ones no task holds a whole trace.
    """
    key = ["tenant_id", "trace_id", "span_id"]
    base = spans.select(*key, F.nullif("parent_span_id", F.lit("")).alias("up"))
    sizes = base.groupBy("tenant_id", "trace_id").agg(F.count(F.lit(1)).alias("n"))
    most = sizes.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    if most <= small:
        return _small_trees(base)
    wide = sizes.where(F.col("n") > small).select("tenant_id", "trace_id")
    both = ["tenant_id", "trace_id"]
    return _small_trees(base.join(wide, both, "left_anti")).unionByName(_large_trees(base.join(wide, both, "left_semi"), most.bit_length() + 1))


def _small_trees(base: DataFrame) -> DataFrame:
    def run(table: pa.Table) -> pa.Table:
        ids, ups = table.column("span_id").to_pylist(), table.column("up").to_pylist()
        place = {}
        for i, x in enumerate(ids):
            if x not in place or ups[i] is not None and (ups[place[x]] is None or ups[i] < ups[place[x]]):  # the least parent of a repeated span
                place[x] = i
        rows = np.array(list(place.values()))
        number = {x: i for i, x in enumerate(place)}
        n = len(rows)
        at = np.array([number.get(ups[r], i) if ups[r] is not None else i for i, r in enumerate(rows)])
        root = np.array([ups[r] is None or ups[r] not in number for r in rows], bool)
        depth = (~root).astype(np.int64)
        for _ in range(n.bit_length()):  # each round doubles how far up a span has looked
            depth, at = depth + depth[at], at[at]
        open_ = ~root[at]
        span, top = [ids[r] for r in rows], [None if o else ids[rows[a]] for o, a in zip(open_, at)]
        one = lambda c: pa.array([table.column(c)[0].as_py()] * n, pa.string())
        return pa.table([one("tenant_id"), one("trace_id"), pa.array(span, pa.string()), pa.array(top, pa.string()), pa.array(depth, mask=open_)], names=["tenant_id", "trace_id", "span_id", "root_span_id", "depth"])

    return base.groupBy("tenant_id", "trace_id").applyInArrow(run, "tenant_id string, trace_id string, span_id string, root_span_id string, depth bigint")


def _large_trees(spans: DataFrame, rounds: int) -> DataFrame:
    """Each round doubles how far up a span has looked, so so many rounds reach the root of every trace of 2**rounds spans."""
    key = ["tenant_id", "trace_id", "span_id"]
    base = spans.groupBy(*key).agg(F.min("up").alias("up"))
    there = base.select("tenant_id", "trace_id", F.col("span_id").alias("up"), F.lit(True).alias("there"))
    state = base.join(there, ["tenant_id", "trace_id", "up"], "left").select(*key, F.when(F.col("there"), F.col("up")).alias("up"))
    # at: the furthest ancestor seen, depth steps above; open while it is no root
    state = state.select(*key, F.coalesce("up", "span_id").alias("at"), F.when(F.col("up").isNull(), 0).otherwise(1).cast("bigint").alias("depth"), F.col("up").isNotNull().alias("open"))
    for _ in range(rounds):
        state = cut(state)
        if state.where("open").isEmpty():
            break
        above = state.select("tenant_id", "trace_id", F.col("span_id").alias("at"), F.col("at").alias("next"), F.col("depth").alias("more"), F.col("open").alias("still"))
        moved = state.where("open").join(above, ["tenant_id", "trace_id", "at"]).select(*key, F.col("next").alias("at"), (F.col("depth") + F.col("more")).alias("depth"), F.col("still").alias("open"))
        state = state.where("not open").unionByName(moved)
    return state.select(*key, F.when(~F.col("open"), F.col("at")).alias("root_span_id"), F.when(~F.col("open"), F.col("depth")).alias("depth"))


def downsample(points: DataFrame, width: str, by: tuple[str, ...] = ()) -> DataFrame:
    """count, min, max, sum and mean of each series in windows of a width; ``by`` are resource attributes."""
    extra = {a: attribute("resource.attributes", a) for a in by}
    rows = points.select("tenant_id", "service", "metric_name", *(c.alias(a) for a, c in extra.items()), F.window(to_timestamp(F.col("time_unix_nano")), width).alias("w"), "value")
    stats = (F.count("value").alias("points"), F.min("value").alias("min_value"), F.max("value").alias("max_value"), F.sum("value").alias("sum_value"), F.avg("value").alias("avg_value"))
    return rows.groupBy("tenant_id", "service", "metric_name", *(f"`{a}`" for a in extra), F.col("w.start").alias("window_start")).agg(*stats)


def aggregate(points: DataFrame, by: Column, name: str, start: int = 0, end: int = 0) -> DataFrame:
    """Points of each metric in a half-open time range, by any expression over resource attributes."""
    rows = points.where(F.lit(start <= 0) | (F.col("time_unix_nano") >= F.lit(start))).where(F.lit(end <= 0) | (F.col("time_unix_nano") < F.lit(end)))
    return rows.groupBy("tenant_id", "metric_name", by.alias(name)).agg(F.count("value").alias("points"), F.min("value").alias("min_value"), F.max("value").alias("max_value"), F.sum("value").alias("sum_value"))


def exemplars(points: DataFrame, spans: DataFrame) -> DataFrame:
    """Metric points with the spans that their exemplars name."""
    e = points.select("tenant_id", "metric_name", "time_unix_nano", F.explode("exemplars").alias("e")).select("tenant_id", "metric_name", "time_unix_nano", F.col("e.trace_id").alias("trace_id"), F.col("e.span_id").alias("span_id"), F.col("e.value_double").alias("exemplar_value"))
    return e.join(spans.select("tenant_id", "trace_id", "span_id", F.col("service").alias("span_service"), F.col("name").alias("span_name")), ["tenant_id", "trace_id", "span_id"])


def tail_sample(spans: DataFrame, slow_nanos: int = 0, keep_percent: int = 0) -> DataFrame:
    """All spans of traces with an error, of slow ones, and of a share of the others chosen by trace id."""
    error = F.max((F.coalesce("status.code", F.lit(0)) == 2).cast("int")) == 1
    slow = (F.max("end_time_unix_nano") - F.min("start_time_unix_nano") >= slow_nanos) & F.lit(slow_nanos > 0)
    lucky = F.pmod(F.xxhash64("trace_id"), F.lit(100)) < keep_percent
    kept = spans.groupBy("tenant_id", "trace_id").agg(error.alias("error"), slow.alias("slow")).where(F.col("error") | F.col("slow") | lucky)
    return spans.join(kept.select("tenant_id", "trace_id"), ["tenant_id", "trace_id"], "left_semi")


def search(logs: DataFrame, contains: str | None = None, pattern: str | None = None, attributes: dict[str, str] | None = None) -> DataFrame:
    """Log records whose body has a text, fits a pattern, and whose own attributes have values."""
    body, out = F.col("body.string_value"), logs
    if contains is not None:
        out = out.where(body.contains(contains))
    if pattern is not None:
        out = out.where(body.rlike(pattern))
    for k, v in sorted((attributes or {}).items()):
        out = out.where(has_attribute(F.col("attributes"), k, v))
    return out


def resources(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(dimension of distinct resources, rows with resource_id in place of resource)."""
    keyed = df.withColumn("resource_id", F.sha2(F.to_json("resource"), 256))
    return keyed.groupBy("resource_id").agg(F.any_value("resource").alias("resource")), keyed.drop("resource")

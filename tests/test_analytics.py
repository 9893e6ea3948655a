"""Analytics over rows made by hand, and every registered query against its SQL."""

import os

import pytest
from pyspark.sql import functions as F

from fixtures import ID32, NOW, frame, log, metric, span, trace
from quillon import queries
from quillon.functions import keys
from quillon.operators import analytics, mutation, silver

SF = "/root/testdata/sf0.001"


def rows(spark, signal, envelopes):
    df = keys.with_head(frame(spark, signal, envelopes), signal)
    return df.withColumns({"tenant_id": F.lit("t"), "ingest_seq": F.monotonically_increasing_id(), "ingest_row": F.lit(0)})


def spans(spark, *envelopes):
    return silver.spans(rows(spark, "traces", envelopes))


def test_silver_takes_every_element(spark):
    assert spans(spark, trace("s", scopes=[[span(), span()], [], [span()]]), trace("s", scopes=[])).count() == 3
    assert silver.points(rows(spark, "metrics", [metric("s"), metric("s")])).count() == 2
    got = silver.log_records(rows(spark, "logs", [log("s", observed=0, time=4), log("s", observed=6, time=4)]))
    assert sorted(r.event_time_unix_nano for r in got.collect()) == [4, 6]


@pytest.mark.parametrize("small", [100_000, 10, 0])
def test_span_tree(spark, small):
    chain = [span(NOW + i, "x", str(i), str(i - 1) if i else None) for i in range(40)]
    odd = [span(NOW, "y", "a", "missing"), span(NOW, "y", "b", "a"), span(NOW, "y", "c", "d"), span(NOW, "y", "d", "c"), span(NOW, "y", "e", "")]
    got = {(r.trace_id, r.span_id): (r.root_span_id, r.depth) for r in analytics.span_tree(spans(spark, trace("s", *chain), trace("s", *odd)), small).collect()}
    assert all(got["x", str(i)] == ("0", i) for i in range(40))
    assert {k[1]: v for k, v in got.items() if k[0] == "y"} == {"a": ("a", 0), "b": ("a", 1), "c": (None, None), "d": (None, None), "e": ("e", 0)}
    assert analytics.span_tree(spans(spark, trace("s", span())).limit(0), small).count() == 0


def test_service_graph(spark):
    df = spans(spark, trace("front", span(NOW, "x", "1")), trace("back", span(NOW, "x", "2", "1", code=2), span(NOW, "x", "3", "1")), trace("db", span(NOW, "x", "4", "2"), span(NOW, "other", "5", "1")))
    got = sorted((r.caller, r.callee, r.calls, r.errors, r.error_rate) for r in analytics.service_graph(df).collect())
    assert got == [("back", "db", 1, 0, 0.0), ("front", "back", 2, 1, 0.5)]


def test_correlation(spark):
    logs = silver.log_records(rows(spark, "logs", [log("s", trace_id=ID32), log("s"), log("s", trace_id="ff")]))
    assert analytics.correlate(spans(spark, trace("s", span())), logs).count() == 1


def test_tail_sample(spark):
    df = spans(spark, trace("s", span(NOW, "bad", "1", code=2), span(NOW, "bad", "2")), trace("s", span(NOW, "ok", "3")), trace("s", span(NOW, "slow", "4"), span(NOW + 10**10, "slow", "5")))
    assert {r.trace_id for r in analytics.tail_sample(df).collect()} == {"bad"}
    assert {r.trace_id for r in analytics.tail_sample(df, slow_nanos=10**9).collect()} == {"bad", "slow"}
    assert analytics.tail_sample(df, keep_percent=100).count() == 5


def test_downsample_and_attributes(spark):
    envelopes = [metric("s", value=float(i), time=NOW + i * 60 * 10**9, more=[("host", f"h{i % 2}")]) for i in range(6)]
    p = silver.points(rows(spark, "metrics", envelopes))
    got = analytics.downsample(p, "3 minutes", by=("host",)).collect()
    assert sorted((r.host, r.points, r.sum_value) for r in got) == [("h0", 1, 4.0), ("h0", 2, 2.0), ("h1", 1, 1.0), ("h1", 2, 8.0)]


def test_search(spark):
    logs = silver.log_records(rows(spark, "logs", [log("s", body="disk full"), log("s", body="disk ok"), log("s", body=None)]))
    assert analytics.search(logs, contains="disk", pattern="fu+ll").count() == 1
    assert analytics.search(logs, attributes={"k": "v"}).count() == 0


def test_resources(spark):
    dim, facts = analytics.resources(rows(spark, "traces", [trace("a", span()), trace("a", span()), trace("b", span())]))
    assert dim.count() == 2 and facts.join(dim, "resource_id").count() == 3


def test_latest_both_ways(spark):
    df = rows(spark, "metrics", [metric("s", "m", float(i), NOW + i % 3) for i in range(10)]).coalesce(1)
    a, b = (sorted(map(str, f(df, "metrics").collect())) for f in (mutation.latest, mutation.latest_by_window))
    assert a == b and len(a) == 3


def test_negation_keeps_nulls(spark):
    df = spark.createDataFrame([(1,), (None,)], "x int")
    assert mutation.without(df, F.col("x") == 1).count() == 1
    assert mutation.without(df, F.col("x") == 2).count() == 2


@pytest.mark.skipif(not os.path.isdir(SF), reason="tables absent")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("events", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(queries.oracle_sql()[name])
    got = queries.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    show = lambda r: tuple(round(v, 9) if isinstance(v, float) else v for v in r)
    assert sorted(map(repr, map(show, got.select(cols).collect()))) == sorted(map(repr, map(show, want.select(*cols).fetchall())))


def test_every_query_has_sql():
    assert set(queries.queries()) == set(queries.oracle_sql())

"""The store: one Parquet table per signal, partitioned by tenant and day of arrival.

Reads are plans over the directories that the table's manifest names; tenant
and day prune them, service and time reach the scan.  Writes, deletes,
retention and compaction are commits to the manifest (see operators.manifest):
they may run beside each other and beside readers.
"""

from __future__ import annotations

import time
import uuid
from dataclasses import replace
from datetime import datetime, timezone
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema
from ..functions import keys
from ..functions.keys import key_columns
from ..functions.tenant import CONFIG_DEFAULT, Resolver, normal
from ..plans import acl
from ..plans.predicates import rows, sure, whole
from ..plans.requests import SIGNAL_OF, LogRequest, MetricRequest, Request, TraceRequest
from .files import Folder
from .manifest import Conflict, Manifest, Snapshot
from .mutation import latest

#: How rows lie in a file: what reads filter by comes first.
ORDER = {"traces": ("service", "time_unix_nano", "span_id"), "logs": ("service", "time_unix_nano", "trace_id"), "metrics": ("service", "metric_name", "time_unix_nano")}
PLACE = ("tenant_id", "ingest_date")
_INDEX = "tenant_id string, trace_id string, ingest_date date"


def place_of(directory: str) -> tuple[str, str]:
    """Tenant and day (or an empty text) of a partition's directory."""
    parts = dict(p.split("=", 1) for p in directory.split("/"))
    return unquote(parts["tenant_id"]), parts.get("ingest_date", "")


class Store:
    """Open with a root folder that all executors reach; also a context manager."""

    def __init__(self, spark: SparkSession, root: str, resolver: Resolver = CONFIG_DEFAULT, index: bool = True) -> None:
        self.spark, self.root, self.resolver, self.index = spark, root.rstrip("/"), resolver, index
        self.folder = Folder(spark, self.root)
        self.queries: list = []

    def __enter__(self) -> Store:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        """Stop the streams that this store started, after what they have read."""
        for q in self.queries:
            if q.isActive:
                q.processAllAvailable()
                q.stop()
        self.queries = []

    # tables

    def manifest(self, table: str) -> Manifest:
        return Manifest(self.folder, table)

    def table(self, signal: str, snapshot: Snapshot | None = None, tenant: str | None = None) -> DataFrame:
        """All rows of a signal, or those of a tenant; without any, an empty frame of the same columns."""
        state = snapshot or self.manifest(signal).snapshot()
        return self._frame(signal, schema.stored(signal), [d for d in state.live if tenant is None or place_of(d)[0] == tenant])

    def trace_index(self, tenant: str | None = None) -> DataFrame:
        """(tenant_id, trace_id, ingest_date): on which days a trace has envelopes."""
        dirs = [d for d in self.manifest("trace_index").snapshot().live if tenant is None or place_of(d)[0] == tenant]
        return self._frame("trace_index", T.StructType.fromDDL(_INDEX), dirs)

    def _frame(self, name: str, fields, dirs: list[str]) -> DataFrame:
        if not dirs:
            return self.spark.createDataFrame([], fields)
        top = f"{self.root}/{name}"
        return self.spark.read.schema(fields).option("basePath", top).parquet(*(f"{top}/{d}" for d in dirs)).select(*fields.names)

    def tenants(self, signal: str = "traces") -> DataFrame:
        """Tenants with rows, from the manifest alone."""
        names = {place_of(d)[0] for d in self.manifest(signal).snapshot().live}
        return self.spark.createDataFrame([(t,) for t in sorted(names)], "tenant_id string")

    # writes

    def version(self, signal: str) -> int:
        """The number of the next write of a signal."""
        return self.manifest(signal).snapshot().version + 1

    def write(self, signal: str, envelopes: DataFrame, tenant: str | None = None, ingest_date: str | None = None, tag: str | None = None, marks: dict[str, int] | None = None) -> int:
        """Append envelopes; without a tenant it is resolved from their resources.  Returns the number of the commit.

        ``tag`` names a write, as streams do with their batch: if a write of
        that name is there already, nothing is written again.  As rows are
        seen with the commit that has the tag, they are there exactly once.
        ``marks`` are places in a source, recorded with the rows up to them.
        """
        state = self.manifest(signal).snapshot()
        if tag and tag in state.tags:
            return state.tags[tag]
        if "schema_url" not in envelopes.columns:
            envelopes = envelopes.withColumn("schema_url", F.lit(None).cast("string"))
        whose = F.lit(normal(tenant)) if tenant is not None else self.resolver.column()
        day = ingest_date or datetime.now(timezone.utc).date().isoformat()
        rows_ = keys.with_head(envelopes, signal).withColumns({"tenant_id": whose, "ingest_seq": F.lit(state.version + 1).cast("bigint"), "ingest_row": F.monotonically_increasing_id(), "ingest_date": F.lit(day).cast("date")}).select(*schema.stored(signal).names)
        # a rebalance gathers a small partition's rows and splits a large one's, by size and not by key
        add = self.put(signal, rows_.hint("rebalance", *PLACE).sortWithinPartitions(*PLACE, *ORDER[signal]), PLACE)
        if signal == "traces" and self.index:  # from what was written, so that the source is read once; before the traces are seen
            self.manifest("trace_index").commit(self._index(self._frame("traces", schema.stored("traces"), list(add))))
        return self.manifest(signal).commit(add, tag=tag, marks=marks)

    def put(self, table: str, rows_: DataFrame, by: tuple[str, ...]) -> dict[str, list[int]]:
        """Write rows into a directory of their own; its partitions with (files, bytes), for a commit."""
        name = f"c={uuid.uuid4().hex}"
        rows_.write.partitionBy(*by).parquet(f"{self.root}/{table}/{name}")
        out: dict[str, list[int]] = {}
        for path, size in self.folder.files(f"{table}/{name}"):
            at = out.setdefault(path.removeprefix(f"{table}/").rpartition("/")[0], [0, 0])
            at[0] += 1
            at[1] += size
        return out

    def _tables(self) -> list[str]:
        return self.folder.names("_log")

    def forget_versions(self, keep: int = 1000) -> int:
        """Drop old commits from the logs, once the whole state is written down elsewhere."""
        return sum(self.manifest(t).forget(keep) for t in self._tables())

    def vacuum(self, grace: float = 3600.0, orphans: float = 86_400.0) -> int:
        """Delete directories that went out of the tables ``grace`` seconds ago, and those no commit has named for ``orphans``; how many.

        Readers of an older snapshot, and reads of the past, have so long.
        """
        n, now = 0, time.time()
        for table in self._tables():
            state = self.manifest(table).snapshot()
            old = [d for d, at in state.gone.items() if at <= now - grace]
            for d in old:
                self.folder.delete(f"{table}/{d}")
            if old:
                self.manifest(table).commit(forget=old)
            top = lambda ds: {d.partition("/")[0] for d in ds}
            used = top(state.live) | top(set(state.gone) - set(old))
            lost = [c for c in self.folder.names(table) if c not in used and (c in top(old) or self.folder.newest(f"{table}/{c}") <= now - orphans)]
            for c in lost:
                self.folder.delete(f"{table}/{c}")
            n += len(old) + len(lost)
        return n

    def write_traces(self, envelopes: DataFrame, tenant: str | None = None, **more) -> int:
        return self.write("traces", envelopes, tenant, **more)

    def write_logs(self, envelopes: DataFrame, tenant: str | None = None, **more) -> int:
        return self.write("logs", envelopes, tenant, **more)

    def write_metrics(self, envelopes: DataFrame, tenant: str | None = None, **more) -> int:
        return self.write("metrics", envelopes, tenant, **more)

    def _index(self, traces: DataFrame) -> dict[str, list[int]]:
        ids = traces.select("tenant_id", "ingest_date", F.explode(F.array_distinct(F.transform(keys.elements("traces"), lambda s: s["trace_id"]))).alias("trace_id")).where("trace_id is not null").distinct()
        sorted_ = ids.select("tenant_id", "trace_id", "ingest_date").hint("rebalance", "tenant_id").sortWithinPartitions("tenant_id", "trace_id")
        return self.put("trace_index", sorted_, ("tenant_id",))

    def rebuild_index(self) -> None:
        """Make the trace index anew from the traces that are stored; writes may go on meanwhile."""
        old = list(self.manifest("trace_index").snapshot().live)
        self.manifest("trace_index").commit(self._index(self.table("traces")), remove=old)

    # reads

    def read(self, request: Request, dedup: bool = False, policy: list[dict] | None = None, principal: str = "", as_of: int | None = None) -> DataFrame:
        """Rows of a request.  All of them by default; with ``dedup`` the last written of each key.

        A policy restricts what the principal sees before anything else.
        ``as_of`` reads the table as it was after that commit, with rows that
        were deleted since, as long as ``vacuum`` keeps them.
        """
        signal = SIGNAL_OF[type(request)]
        df = self.table(signal, None if as_of is None else self.manifest(signal).snapshot(as_of), normal(request.tenant_id))
        df = self.visible(df, signal, normal(request.tenant_id), as_of)
        if policy is not None:
            df = acl.restrict(df, policy, principal, signal)
        if dedup:
            df = latest(df.where(F.col("tenant_id") == normal(request.tenant_id)), signal)
        return df.where(whole(request))

    read_traces = read_logs = read_metrics = read

    def read_trace_by_id(self, tenant: str, trace_id: str) -> DataFrame:
        """Envelopes with a span of the trace, in any scope; an empty id is an error.

        With an index, the days it names (at most as many as retention keeps)
        prune the partitions that are scanned.
        """
        if not trace_id:
            raise ValueError("trace id is empty")
        df = self.table("traces", tenant=normal(tenant))
        if self.index:
            found = self.trace_index(normal(tenant)).where((F.col("tenant_id") == normal(tenant)) & (F.col("trace_id") == trace_id.lower()))
            df = df.where(F.col("ingest_date").isin([r[0] for r in found.select("ingest_date").distinct().collect()]))
        return df.where(whole(TraceRequest(tenant_id=tenant, trace_id=trace_id)))

    def count(self, request: Request) -> dict:
        """What the HTTP routes answer: count and tenant."""
        return {"count": self.read(request).count(), "tenant": normal(request.tenant_id)}

    # deletes

    def bury(self, signal: str, rows_: DataFrame) -> int:
        """Store tombstones for the keys of some rows: what was written of them up to now is not read again."""
        seq = F.lit(self.manifest(signal).snapshot().version).cast("bigint").alias("upto")
        keyed = rows_.select(*key_columns(signal), seq).distinct()
        add = self.put(f"{signal}_tombstones", keyed.hint("rebalance", "tenant_id").sortWithinPartitions(*key_columns(signal)), ("tenant_id",))
        return self.manifest(f"{signal}_tombstones").commit(add)

    def visible(self, df: DataFrame, signal: str, tenant: str, as_of: int | None = None) -> DataFrame:
        """Rows of a tenant that no tombstone hides, of those from before a commit; without tombstones the same plan."""
        table = f"{signal}_tombstones"
        dirs = [d for d in self.manifest(table).snapshot().live if place_of(d)[0] == tenant]
        if not dirs:
            return df
        fields = T.StructType([*(schema.stored(signal)[c] for c in key_columns(signal)), T.StructField("upto", T.LongType())])
        stones = self._frame(table, fields, dirs)
        hidden = (stones if as_of is None else stones.where(F.col("upto") < as_of)).groupBy(*key_columns(signal)).agg(F.max("upto").alias("upto"))
        on = [df[c].eqNullSafe(hidden[c]) for c in key_columns(signal)]
        return df.join(hidden, [*on, df["ingest_seq"] <= hidden["upto"]], "left_anti")

    def purge(self, signal: str) -> int:
        """Delete the rows that tombstones hide, and those tombstones; in how many partitions."""
        table = f"{signal}_tombstones"
        old, state = list(self.manifest(table).snapshot().live), self.manifest(signal).snapshot()
        tenants = {place_of(d)[0] for d in old}
        dirs = [d for d in state.live if place_of(d)[0] in tenants]
        if dirs:
            parts = [self.visible(self._frame(signal, schema.stored(signal), [d for d in dirs if place_of(d)[0] == t]), signal, t) for t in sorted({place_of(d)[0] for d in dirs})]
            rest = reduce(DataFrame.unionByName, parts)
            self.manifest(signal).commit(self.put(signal, rest.hint("rebalance", *PLACE).sortWithinPartitions(*PLACE, *ORDER[signal]), PLACE), remove=dirs)
        if old:
            self.manifest(table).commit(remove=old)
        return len({place_of(d) for d in dirs})

    def delete(self, request: Request) -> int:
        """Delete the rows of a request that are stored now; how many they were."""
        signal = SIGNAL_OF[type(request)]
        return self.rewrite(signal, rows(replace(request, tenant_id=normal(request.tenant_id))), normal(request.tenant_id))

    def delete_traces(self, request: TraceRequest) -> int:
        return self.delete(request)

    def delete_logs(self, request: LogRequest) -> int:
        return self.delete(request)

    def delete_metrics(self, request: MetricRequest) -> int:
        return self.delete(request)

    def rewrite(self, signal: str, gone: Column, tenant: str | None = None, attempts: int = 5) -> int:
        """Rewrite the partitions, of a tenant or all, that hold rows that are ``gone``.

        If another commit replaces one of them meanwhile, it is done again.
        """
        for _ in range(attempts):
            state = self.manifest(signal).snapshot()
            df = self.table(signal, state, tenant)
            hit = {(r.tenant_id, str(r.ingest_date)): r.n for r in df.where(sure(gone)).groupBy(*PLACE).agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each day of a tenant
            if not hit:
                return 0
            old = [d for d in state.live if place_of(d) in hit]
            rest = self._frame(signal, schema.stored(signal), old).where(~sure(gone))
            add = self.put(signal, rest.hint("rebalance", *PLACE).sortWithinPartitions(*PLACE, *ORDER[signal]), PLACE)
            try:
                self.manifest(signal).commit(add, remove=old)
            except Conflict:
                continue
            return sum(hit.values())
        raise Conflict(f"{signal} was rewritten by others {attempts} times")

    def sort_keys(self, signal: str) -> DataFrame:
        """Keys of all rows in their order."""
        return self.table(signal).select(keys.text_key(signal).alias("key")).orderBy("key")


class IngestStore(Store):
    """A store that takes writes only: what lands is durable, and every read is refused."""

    def read(self, *_, **__):
        raise PermissionError("this store is for ingestion only")

    read_traces = read_logs = read_metrics = read_trace_by_id = count = read
